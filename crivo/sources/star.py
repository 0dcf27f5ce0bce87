"""Credit-domain tables derived from the star-schema and event tables.

The mapping is plain projection over the source tables, so Catalyst prunes each scan to the
columns a query touches. Row counts grow with ``orders``, ``events`` and ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by_remainder(key: Column, values: tuple) -> Column:
    """Value picked by ``key % len(values)``; the last value is the remaining case."""
    rest = key % len(values)
    choice = F.when(rest == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:-1], start=1):
        choice = choice.when(rest == i, F.lit(value))
    return choice.otherwise(F.lit(values[-1]))


def personal_number(key: Column) -> Column:
    """Eleven digits derived from a key."""
    number = (key * 7919 + F.lit(12345678901)) % F.lit(100000000000)
    return F.lpad(number.cast("string"), 11, "0")


def raw_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """One loan proposal per order, before any derived feature."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    return (
        orders.join(customer, F.col("o_custkey") == c)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            o.alias("proposta_id"),
            personal_number(c).alias("cliente_id"),
            (F.lit(18) + (c * 7) % 53).cast("int").alias("idade"),
            (F.lit(1200) + (c * 131) % 18801).cast("double").alias("renda"),
            (F.lit(300) + (c * 37 + o * 13) % 651).cast("int").alias("score"),
            F.col("o_totalprice").alias("ticket"),
            _by_remainder(o, (6, 12, 24, 36, 48, 60, 84, 120)).alias("prazo_meses"),
            ((F.lit(800) + (o * 17) % 1201).cast("double") / F.lit(100.0)).alias("taxa_juros_aa"),
            (F.lit(1) + c % 119).cast("int").alias("tempo_cliente_meses"),
            (F.lit(1) + c % 5).cast("int").alias("qtd_produtos"),
            _by_remainder(o, ("CDC", "Imobiliário", "Cartão", "Pessoal")).alias("tipo_credito"),
            F.when(F.col("n_regionkey") == 0, "Norte")
            .when(F.col("n_regionkey") == 1, "Nordeste")
            .when(F.col("n_regionkey") == 2, "Centro-Oeste")
            .when(F.col("n_regionkey") == 3, "Sudeste")
            .otherwise("Sul")
            .alias("regiao"),
            _by_remainder(c, ("SP", "RJ", "MG", "RS", "BA", "PR")).alias("uf"),
            _by_remainder(c, ("Masculino", "Feminino")).alias("genero"),
            _by_remainder(c, ("Solteiro", "Casado", "Divorciado", "Viúvo")).alias("estado_civil"),
            _by_remainder(c + 1, ("Fundamental", "Médio", "Superior", "Pós-Graduação")).alias(
                "escolaridade"
            ),
            _by_remainder(c + 2, ("Pequeno", "Médio", "Grande", "Metrópole")).alias(
                "porte_municipio"
            ),
            (((o * F.lit(2654435761)) % 1000003).cast("double") / F.lit(1000003.0)).alias("u"),
        )
        .withColumn(
            "qtd_atrasos_12m",
            F.when(F.col("score") < 500, F.col("proposta_id") % 6)
            .when(F.col("score") < 700, F.col("proposta_id") % 3)
            .when(F.col("proposta_id") % 100 == 0, 1)
            .otherwise(0)
            .cast("int"),
        )
    )


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals with installment, commitment ratio ``perc``, risk ``p``, label and ``sn``."""
    i = F.col("taxa_juros_aa") / 12 / 100
    growth = F.pow(1 + i, F.col("prazo_meses"))
    share = F.col("parcela_mensal") / F.col("renda")

    def unit(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    return (
        raw_proposals(spark, folder)
        .withColumn("parcela_mensal", F.col("ticket") * (i * growth) / (growth - 1))
        .withColumn("perc", share * 100)
        .withColumn(
            "p",
            F.pow(
                0.40 * ((950 - F.col("score")) / F.lit(650.0))
                + 0.30 * unit(share)
                + 0.20 * F.least(F.col("qtd_atrasos_12m") / F.lit(5.0), F.lit(1.0))
                + 0.10 * unit((60 - F.col("tempo_cliente_meses")) / F.lit(60.0)),
                F.lit(2.0),
            ),
        )
        .withColumn("inadimplente", F.when(F.col("u") < F.col("p"), 1).otherwise(0))
        .withColumn("sn", (F.col("score") - 300) / F.lit(650.0))
    )


def _address(user: Column) -> Column:
    return F.concat(
        F.lit("10.0."),
        F.floor(user / 256).cast("int").cast("string"),
        F.lit("."),
        (user % 256).cast("string"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """API requests, one per event."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        _address(F.col("user_id")).alias("ip"),
        F.when(kind == "click", "/api/v1/predict")
        .when(kind == "purchase", "/api/v1/predict/batch")
        .when(kind == "signup", "/api/v1/auth/login")
        .when(kind == "error", "/api/v1/auth/token")
        .otherwise("/api/v1/metrics")
        .alias("endpoint"),
    )


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    """Audit log rows, one per event."""
    kind, user, eid = F.col("event_type"), F.col("user_id"), F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("ts").cast("date").alias("event_date"),
        F.when(kind == "click", "prediction_success")
        .when(kind == "purchase", "batch_prediction")
        .when(kind == "signup", "login_success")
        .when(kind == "view", "data_access")
        .when(eid % 3 == 0, "login_failed")
        .when(eid % 3 == 1, "unauthorized_access")
        .otherwise("system_error")
        .alias("event_type"),
        F.when((kind == "error") & (eid % 3 == 0), "warning")
        .when(kind == "error", "error")
        .when((kind == "click") & (F.col("value") > 100), "warning")
        .otherwise("info")
        .alias("severity"),
        F.when(user % 10 != 0, user.cast("string")).alias("user_id"),
        F.when(user % 4 == 1, "admin")
        .when(user % 4 == 2, "analyst")
        .when(user % 4 == 3, "operator")
        .alias("username"),
        _address(user).alias("ip_address"),
        F.col("props").alias("details_json"),
    )


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data, one row per customer."""
    c, segment = F.col("c_custkey"), F.col("c_mktsegment")

    def four(x: Column) -> Column:
        return F.lpad((x % 10000).cast("string"), 4, "0")

    return table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("Ana "), _by_remainder(c, ("da ", "de ", "")), segment).alias("nome"),
        F.when(c % 50 == 0, "123")
        .when(c % 51 == 0, "")
        .otherwise(personal_number(c))
        .alias("cpf"),
        F.when(c % 40 == 0, "invalid-email")
        .when(c % 41 == 0, "a@example.com")
        .otherwise(F.concat(F.lower(segment), F.lit("."), c.cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.concat(
            F.lit("("), (11 + c % 80).cast("string"), F.lit(") 9"), four(c * 31), F.lit("-"),
            four(c * 17),
        ).alias("telefone"),
        F.when(
            c % 2 == 0,
            F.concat((10000 + c).cast("string"), F.lit("-"), (c % 10).cast("string")),
        )
        .otherwise((100000 + c).cast("string"))
        .alias("conta"),
        F.lpad(
            ((c * 104729 + F.lit(4000000000000000)) % F.lit(10000000000000000)).cast("string"),
            16, "0",
        ).alias("cartao"),
        (F.lit(500) + (c * 977) % 1600000).cast("double").alias("renda"),
    )
