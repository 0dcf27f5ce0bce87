"""Seeded loan tables.

Every draw is a function of (row id, name of the draw, seed), so a table is the same however it
is partitioned and a lost task rebuilds the same rows. Each generator is one narrow projection
over a table of ids.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions import features as X
from crivo.functions import scorecards as S
from crivo.functions.common import clip, lookup
from crivo.operators.encoding import impute_score_median

# The distributions of the generated columns.
MONTHS = tuple(f"2022{m:02d}" for m in range(1, 13))
MONTH_SHARES = (0.06, 0.07, 0.08, 0.09, 0.10, 0.09, 0.09, 0.09, 0.09, 0.09, 0.08, 0.07)
INCOMES = (500, 1000, 2000, 3000, 5000, 8000, 12000, 20000)
INCOME_SHARES = (0.05, 0.10, 0.15, 0.20, 0.25, 0.15, 0.07, 0.03)
TICKETS = (1000, 5000, 10000, 20000, 50000, 100000, 200000)
TICKET_SHARES = (0.20, 0.30, 0.25, 0.15, 0.07, 0.02, 0.01)
TERMS = (6, 12, 24, 36, 48, 60, 84, 120)
PRODUCTS = ("CDC", "Imobiliário", "Cartão", "Pessoal")
REGIONS = ("Norte", "Nordeste", "Centro-Oeste", "Sudeste", "Sul")
REGION_INCOME = {"Sudeste": 1.2, "Sul": 1.15, "Centro-Oeste": 1.0, "Nordeste": 0.85}
REGION_INCOME_REST = 0.80
PRODUCT_VALUE_RANGES = {
    "Imobiliário": (80_000, 500_000), "Cartão": (500, 15_000), "Pessoal": (3_000, 30_000),
    "CDC": (1_000, 50_000),
}
PRODUCT_TERMS = {
    "Imobiliário": (180, 240, 360), "Pessoal": (24, 36, 48), "CDC": (6, 12, 18, 24, 36, 48),
    "Cartão": (6, 12, 18, 24, 36, 48),
}
TERM_BY_PRODUCT = {"CDC": 36, "Cartão": 6, "Imobiliário": 240, "Pessoal": 24}
TERM_RANGE_BY_PRODUCT = {
    "CDC": (12, 60), "Cartão": (1, 12), "Imobiliário": (120, 420), "Pessoal": (12, 48),
}
RATE_BY_PRODUCT = {"CDC": 2.5, "Cartão": 8.0, "Imobiliário": 0.8, "Pessoal": 2.8}
TICKET_SCALE = {"CDC": 0.5, "Cartão": 0.2, "Imobiliário": 3.0, "Pessoal": 0.5}
MISSING = "Não Informado"


class Draws:
    """Random columns keyed by the row id; each draw has a name of its own."""

    def __init__(self, key: str, seed: int):
        self.key, self.seed = key, seed

    def uniform(self, name: str, low: float = 0.0, high: float = 1.0) -> Column:
        h = F.xxhash64(F.col(self.key), F.lit(name), F.lit(self.seed))
        u = F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)
        return u if (low, high) == (0.0, 1.0) else F.lit(low) + u * F.lit(high - low)

    def integer(self, name: str, low: int, high: int) -> Column:
        """Whole number in [low, high)."""
        return (F.lit(low) + F.floor(self.uniform(name) * (high - low))).cast("int")

    def normal(self, name: str, mean: float = 0.0, sd: float = 1.0) -> Column:
        radius = F.sqrt(-2.0 * F.log(1.0 - self.uniform(f"{name}/r")))
        return mean + sd * radius * F.cos(self.uniform(f"{name}/a") * (2 * math.pi))

    def exponential(self, name: str, mean: float) -> Column:
        return -mean * F.log(1.0 - self.uniform(name))

    def choice(self, name: str, values: Sequence, shares: Sequence[float] | None = None) -> Column:
        shares = shares or [1 / len(values)] * len(values)
        u, upto, out = self.uniform(name), 0.0, None
        for value, share in zip(values[:-1], shares):
            upto += share
            hit = u < upto
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out.otherwise(F.lit(values[-1]))

    def flag(self, name: str, p: Column | float) -> Column:
        return F.when(self.uniform(name) < p, 1).otherwise(0)

    def binomial(self, name: str, n: int, p: Column) -> Column:
        total = F.lit(0)
        for i in range(n):
            total = total + self.flag(f"{name}/{i}", p)
        return total


def _by(key: Column, choices: Mapping[str, Column]) -> Column:
    out = None
    for value, column in choices.items():
        out = F.when(key == value, column) if out is None else out.when(key == value, column)
    return out


def make_ids(spark: SparkSession, n: int, start: int = 1, partitions: int | None = None) -> DataFrame:
    return spark.range(start, start + n, 1, partitions)


def make_portfolio(ids: DataFrame, seed: int = 42) -> DataFrame:
    """The main 22-column table; the label follows the weighted scorecard."""
    d = Draws("id", seed)
    base = ids.select(
        "id",
        d.integer("score", 300, 950).alias("score"),
        d.choice("renda", INCOMES, INCOME_SHARES).alias("renda"),
        d.integer("idade", 18, 70).alias("idade"),
        d.integer("tempo", 1, 120).alias("tempo_cliente_meses"),
        d.integer("produtos", 1, 6).alias("qtd_produtos"),
        d.choice("ticket", TICKETS, TICKET_SHARES).alias("ticket"),
        d.choice("prazo", TERMS).alias("prazo_meses"),
        d.uniform("taxa", 8.0, 20.0).alias("taxa_juros_aa"),
        d.choice("tipo", PRODUCTS).alias("tipo_credito"),
        d.choice("regiao", REGIONS).alias("regiao"),
        d.choice("genero", ("Masculino", "Feminino")).alias("genero"),
        d.choice("civil", ("Solteiro", "Casado", "Divorciado", "Viúvo")).alias("estado_civil"),
        d.choice("escola", ("Fundamental", "Médio", "Superior", "Pós-Graduação")).alias(
            "escolaridade"
        ),
        d.choice("uf", ("SP", "RJ", "MG", "RS", "BA", "PR")).alias("uf"),
        d.choice("porte", ("Pequeno", "Médio", "Grande", "Metrópole")).alias("porte_municipio"),
    )
    low, middle, high = (
        d.choice("atraso/baixo", (0, 1, 2, 3, 4, 5), (0.2, 0.2, 0.2, 0.2, 0.1, 0.1)),
        d.choice("atraso/medio", (0, 1, 2), (0.6, 0.3, 0.1)),
        d.choice("atraso/alto", (0, 1), (0.99, 0.01)),
    )
    late = F.when(F.col("score") < 500, low).when(F.col("score") < 700, middle).otherwise(high)
    rows = X.with_features(base).drop("faixa_etaria").withColumn("qtd_atrasos_12m", late)
    risk = S.scorecard_weighted(
        "score", "perc_comprometimento_renda", "qtd_atrasos_12m", "tempo_cliente_meses"
    )
    return rows.withColumn("inadimplente", d.flag("inadimplente", risk))


def make_portfolio_large(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Fourteen narrow-typed columns with skewed months, tiers, outliers and missing categories."""
    d = Draws("id", seed)
    rows = ids.select(
        "id",
        d.choice("mes", MONTHS, MONTH_SHARES).alias("mes_referencia"),
        clip(d.normal("score", 650, 120), 300, 950).cast("int").alias("score_credito"),
        clip(d.normal("idade", 38, 12), 18, 75).cast("int").alias("idade"),
        clip(d.exponential("tempo", 24.0), 1, 200).cast("int").alias("tempo_relacionamento"),
        d.choice("tipo", PRODUCTS, (0.45, 0.15, 0.15, 0.25)).alias("tipo_produto"),
        d.choice("regiao", ("Sudeste", "Sul", "Nordeste", "Centro-Oeste", "Norte"),
                 (0.45, 0.20, 0.20, 0.10, 0.05)).alias("regiao"),
        d.choice("canal", ("App", "Agência", "Parceiro", "Internet Banking"),
                 (0.45, 0.25, 0.20, 0.10)).alias("canal_aquisicao"),
    )
    score, product = F.col("score_credito"), F.col("tipo_produto")
    tiers = (
        F.when(score > 750, d.choice("qtd/a", (1, 2, 3, 4, 5), (0.1, 0.2, 0.3, 0.25, 0.15)))
        .when(score > 600, d.choice("qtd/b", (1, 2, 3, 4, 5), (0.3, 0.35, 0.2, 0.1, 0.05)))
        .otherwise(d.choice("qtd/c", (1, 2, 3, 4, 5), (0.6, 0.25, 0.1, 0.04, 0.01)))
    )
    factor = F.coalesce(lookup(F.col("regiao"), REGION_INCOME), F.lit(REGION_INCOME_REST))
    surcharge = F.coalesce(lookup(product, {"Cartão": 0.05, "Pessoal": 0.02}), F.lit(0.0))
    rate = F.lit(0.30) - score / F.lit(950.0) * 0.25 + surcharge + d.normal("taxa", 0.0, 0.02)
    rows = rows.withColumns(
        {
            "renda_mensal": clip(
                (score * 15 + d.normal("renda", 0.0, 3000.0)) * factor, 1_200, 35_000
            ).cast("int"),
            "qtd_produtos_ativos": tiers.cast("tinyint"),
            "valor": _by(product, {
                p: d.integer(f"valor/{p}", *bounds) for p, bounds in PRODUCT_VALUE_RANGES.items()
            }),
            "prazo": _by(product, {
                p: d.choice(f"prazo/{p}", terms) for p, terms in PRODUCT_TERMS.items()
            }).cast("smallint"),
            "taxa": F.round(clip(rate, 0.015, 0.35), 4).cast("float"),
        }
    )
    risk = S.scorecard_additive(
        "score_credito", "renda_mensal", "valor", "prazo", "tipo_produto", "tempo_relacionamento",
        "qtd_produtos_ativos", "mes_referencia", noise=d.normal("ruido", 0.0, 0.01),
    )
    risk = F.when(d.uniform("fora") < 0.02, d.uniform("risco", 0.5, 0.9)).otherwise(risk)
    lost = d.uniform("falta") < 0.05
    return rows.select(
        F.col("id").alias("cliente_id"), "mes_referencia", "score_credito", "renda_mensal", "idade",
        "tempo_relacionamento", "qtd_produtos_ativos", "tipo_produto", "valor", "prazo", "taxa",
        F.when(lost, MISSING).otherwise(F.col("canal_aquisicao")).alias("canal_aquisicao"),
        F.when(lost, MISSING).otherwise(F.col("regiao")).alias("regiao"),
        d.flag("inadimplente", risk).cast("tinyint").alias("inadimplente"),
    )


def make_minimal(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Six columns with income outliers and NULL scores."""
    d = Draws("id", seed)
    income = clip(d.normal("renda", 10_500, 3_500), 800, 150_000)
    return ids.select(
        "id",
        d.choice("mes", MONTHS).alias("mes"),
        F.when(d.uniform("sem score") >= 0.05, clip(d.normal("score", 650, 80), 300, 950)).alias(
            "score"
        ),
        (income * F.when(d.uniform("fora") < 0.02, 4).otherwise(1)).alias("renda"),
        d.flag("inadimplente", 0.0639).alias("inadimplente"),
        clip(d.normal("ticket", 60_224, 22_000), 1_000, 500_000).alias("ticket"),
    )


def make_base(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Id, month, score and income: what ``enrich_portfolio`` starts from without a table."""
    d = Draws("id", seed)
    return ids.select(
        "id",
        d.choice("mes", tuple(int(m) for m in MONTHS[:6])).alias("mes"),
        F.round(clip(d.normal("score", 680, 80), 300, 950)).cast("int").alias("score"),
        F.round(F.exp(math.log(3500) + 0.8 * d.normal("renda")), 2).alias("renda"),
    )


def _demographics(rows: DataFrame, d: Draws) -> DataFrame:
    age = clip(d.normal("idade", 40, 15), 18, 80).cast("int")
    return rows.withColumn("idade", age).withColumn(
        "tempo_relacionamento",
        clip((F.col("idade") - 18) * 0.6 + d.exponential("tempo", 3.0), 0, 40).cast("int"),
    )


def _categories(rows: DataFrame, d: Draws) -> DataFrame:
    return rows.withColumns(
        {
            "tipo_produto": d.choice("tipo", ("CDC", "Cartão", "Imobiliário", "Pessoal"),
                                     (0.35, 0.25, 0.10, 0.30)),
            "regiao": d.choice("regiao", ("Sudeste", "Sul", "Nordeste", "Centro-Oeste", "Norte"),
                               (0.42, 0.15, 0.28, 0.08, 0.07)),
            "canal": d.choice("canal", ("App", "Agência", "Parceiro", "Internet Banking"),
                              (0.40, 0.30, 0.15, 0.15)),
            "valor_renda_ratio": d.uniform("razao", 0.3, 1.5),
        }
    )


def _ticket() -> Column:
    scale = lookup(F.col("tipo_produto"), TICKET_SCALE)
    raw = F.col("renda") * F.col("prazo") * F.col("valor_renda_ratio") * scale
    return F.round(clip(raw, 1_000, 500_000), 2)


def _outcome(rows: DataFrame, d: Draws, lgd: Column) -> DataFrame:
    rows = rows.withColumn(
        "dias_atraso",
        F.when(F.col("inadimplente") == 1, d.integer("dias", 91, 360)).otherwise(0),
    ).withColumn("lgd", lgd)
    return rows.withColumns(
        {
            "perda_esperada": F.col("ticket") * F.col("inadimplente") * F.col("lgd"),
            "provisao_stage": S.ifrs9_stage("dias_atraso", "score"),
        }
    )


def enrich_portfolio(df: DataFrame, seed: int = 42, variant: str = "demo") -> DataFrame:
    """Demographics, product, term, rate, ticket, label, delay, loss and stage for a base table.

    ``demo`` fills missing scores and draws terms from ranges; ``windows`` varies a fixed term
    and rate per product. Needs columns id, score, renda.
    """
    d = Draws("id", seed)
    if variant not in ("demo", "windows"):
        raise ValueError(f"unknown variant {variant!r}")
    rows = impute_score_median(df) if variant == "demo" else df
    rows = _demographics(rows, d)
    rows = rows.withColumn(
        "score", clip(F.col("score") + (F.col("idade") - 40) * 1.5, 300, 950).cast("int")
    )
    chance = F.col("tempo_relacionamento") / F.lit(40.0) * 0.5 + F.col("score") / F.lit(950.0) * 0.5
    rows = rows.withColumn(
        "qtd_produtos_ativos",
        F.least(F.greatest(d.binomial("produtos", 10, chance), F.lit(1)), F.lit(10)),
    )
    rows = _categories(rows, d)
    product = F.col("tipo_produto")
    base_rate = lookup(product, RATE_BY_PRODUCT)
    if variant == "demo":
        term = _by(product, {
            p: d.integer(f"prazo/{p}", *bounds) for p, bounds in TERM_RANGE_BY_PRODUCT.items()
        })
        rate = base_rate + X.risk_factor("score") * base_rate * 0.5 + d.normal("taxa") * base_rate * 0.1
    else:
        shifted = lookup(product, TERM_BY_PRODUCT) + d.integer("prazo", -6, 7)
        term = F.least(F.greatest(shifted, F.lit(1)), F.lit(420))
        rate = base_rate + d.normal("taxa", 0.0, 0.3)
    rows = rows.withColumns({"prazo": term, "taxa": F.round(clip(rate, 0.5, 15.0), 2)})
    rows = rows.withColumn("ticket", _ticket())
    risk = S.scorecard_multiplicative("score", "renda", "valor_renda_ratio", "tipo_produto")
    rows = rows.withColumn("inadimplente", d.flag("inadimplente", risk))
    lgd = F.round(clip(S.lgd_base("tipo_produto") + d.normal("lgd", 0.0, 0.05), 0.2, 0.9), 3)
    return _outcome(rows, d, lgd)


def make_flat(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Fixed term, rate and loss per product; the label follows the simple scorecard."""
    d = Draws("id", seed)
    rows = _categories(_demographics(make_base(ids, seed), d), d)
    rows = rows.withColumns(
        {
            "qtd_produtos_ativos": d.integer("produtos", 1, 11),
            "prazo": lookup(F.col("tipo_produto"), TERM_BY_PRODUCT),
            "taxa": lookup(F.col("tipo_produto"), RATE_BY_PRODUCT),
        }
    )
    rows = rows.withColumn("ticket", _ticket()).withColumn(
        "inadimplente", d.flag("inadimplente", S.scorecard_simple("score"))
    )
    return _outcome(rows, d, S.lgd_base("tipo_produto"))
