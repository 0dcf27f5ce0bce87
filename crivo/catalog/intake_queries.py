"""Validation, typing, encoding and sampling over proposals, drafts and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo import constants as K
from crivo.catalog.dirty import BATCHES, DRAFTS, UPLOADS, batches, drafts, uploads
from crivo.catalog.fixture_sql import PROP
from crivo.catalog.scalar_queries import _BAND, _code_sql
from crivo.functions import decisions as D
from crivo.functions import features as X
from crivo.functions import ingest as I
from crivo.operators import encoding as E
from crivo.operators import reports as R
from crivo.operators import sampling as S
from crivo.operators import validation as V
from crivo.sources.star import proposals, raw_proposals

KEY = ["proposta_id"]


def _validated(spark, folder):
    return V.validate_proposals(V.normalize_aliases(drafts(spark, folder)))


def normalize_aliases(spark, folder):
    return V.normalize_aliases(drafts(spark, folder)).select(
        "proposta_id", *(c for c in K.ALIASES.values())
    )


def validate_proposals(spark, folder):
    return _validated(spark, folder).select(
        "proposta_id", "uf", "qtd_atrasos_12m", F.array_join("errors", ";").alias("erros")
    )


def _checks_sql() -> str:
    names = {v: k for k, v in K.ALIASES.items()}
    parts = []
    for c, (low, closed, high) in K.RANGES.items():
        x = names.get(c, c)
        x = f"coalesce({x}, 0)" if c == "qtd_atrasos_12m" else x
        parts.append(
            f"CASE WHEN {x} IS NULL THEN '{c}_missing' WHEN NOT ({x} {'>=' if closed else '>'} {low} "
            f"AND {x} <= {high}) THEN '{c}_range' END"
        )
    for c, allowed in K.ENUM_RULES.items():
        x, values = names.get(c, c), ", ".join(repr(v) for v in allowed)
        parts.append(
            f"CASE WHEN {x} IS NULL THEN '{c}_missing' WHEN {x} NOT IN ({values}) THEN '{c}_enum' END"
        )
    channels = ", ".join(repr(v) for v in K.CHANNELS)
    parts.append(f"CASE WHEN canal_aquisicao NOT IN ({channels}) THEN 'canal_aquisicao_enum' END")
    states = ", ".join(repr(v) for v in K.STATES)
    parts.append(f"CASE WHEN uf IS NULL THEN 'uf_missing' WHEN upper(uf) NOT IN ({states}) THEN 'uf_enum' END")
    return "concat_ws(';', " + ", ".join(parts) + ")"


_CHECKED = DRAFTS + f", checked AS (SELECT *, {_checks_sql()} AS erros FROM drafts)"


def split_valid(spark, folder):
    valid, bad = V.split_valid(_validated(spark, folder))
    return valid.select("proposta_id", F.lit("valid").alias("part")).unionByName(
        bad.select("proposta_id", F.lit("quarantine").alias("part"))
    )


def error_rows(spark, folder):
    _, bad = V.split_valid(_validated(spark, folder))
    return V.error_rows(bad)


def batch_results_with_errors(spark, folder):
    valid, bad = V.split_valid(_validated(spark, folder))
    risk = F.round(X.risk_factor("score") * 0.9, 6)
    good = D.batch_result(valid.withColumn("p", risk), "p")
    return R.batch_summary(good.unionByName(V.error_rows(bad)))


def check_batch_size(spark, folder):
    rows = batches(spark, folder)
    known = rows.select("batch_id").unionByName(
        rows.select((F.col("batch_id") + 1_000_000).alias("batch_id"))
    )
    return V.check_batch_size(rows, "batch_id", known)


def batch_counters(spark, folder):
    rows = batches(spark, folder).withColumn("ok", F.col("proposta_id") % 13 != 0)
    return R.batch_counters(rows, "batch_id")


def check_required_columns(spark, folder):
    rows = proposals(spark, folder).drop("taxa_juros_aa")
    report = V.check_required_columns(rows).withColumn("ok", F.col("ok").cast("int"))
    full = V.check_required_columns(proposals(spark, folder)).withColumn(
        "ok", F.col("ok").cast("int")
    )
    return report.unionByName(full)


def resolve_columns(spark, folder):
    rows = proposals(spark, folder).withColumnsRenamed({"inadimplente": "bad", "ticket": "amount"})
    return V.resolve_columns(rows, KEY)


def check_feature_contract(spark, folder):
    table = E.feature_table(raw_proposals(spark, folder), KEY)
    return V.check_feature_contract(table, K.FEATURE_ORDER, K.ENCODED_COLUMNS[:7])


def coerce_csv(spark, folder):
    return I.coerce_csv(uploads(spark, folder)).select("cliente_id", *K.CSV_NUMBERS, *K.CSV_TEXTS)


def map_enums(spark, folder):
    return I.map_enums(uploads(spark, folder)).select(
        "cliente_id", "genero", "escolaridade", "tipo_produto", "canal_aquisicao"
    )


_NUM = r"regexp_extract({c}, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
_INT = r"regexp_extract({c}, '^\s*([+-]?[0-9]+)', 1)"


def _number_sql(c: str, kind: str, default) -> str:
    text, target = (_INT, "int") if kind == "int" else (_NUM, "double")
    return f"coalesce(nullif(try_cast({text.format(c=c)} AS {target}), 0), {default}) AS {c}"


def _contains(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _rules(x: str, rules, rest: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {_contains(x, parts)} THEN '{value}'" for parts, value in rules
    ) + f" ELSE '{rest}' END"


def _or(c: str, default: str) -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


_LOW = f"lower({_or('escolaridade', 'Superior')})"
_SCHOOL = (
    f"CASE WHEN contains({_LOW}, 'fundamental') THEN 'Fundamental' "
    f"WHEN {_contains(_LOW, ('médio', 'medio'))} THEN 'Médio' "
    f"WHEN contains({_LOW}, 'superior') AND NOT {_contains(_LOW, ('pós', 'pos'))} THEN 'Superior' "
    f"WHEN {_contains(_LOW, ('pós', 'pos', 'gradua'))} THEN 'Pós-Graduação' ELSE 'Superior' END"
)


# --- encoding ---------------------------------------------------------------------------------
def fit_label_encoder(spark, folder):
    return E.fit_label_encoder(X.with_features(raw_proposals(spark, folder)), K.ENCODED_COLUMNS)


def fit_label_encoder_wide(spark, folder):
    """The range-partitioned ranking, on a column with one value per customer."""
    rows = raw_proposals(spark, folder)
    return E.fit_label_encoder(rows, ["cliente_id", "uf"])


def encode_labels(spark, folder):
    rows = X.with_features(raw_proposals(spark, folder))
    seen = rows.filter("genero = 'Masculino' AND uf <> 'RJ'")
    encoder = E.fit_label_encoder(seen, K.ENCODED_COLUMNS, fold=True)
    out = E.encode_labels(rows, encoder, K.ENCODED_COLUMNS, fold=True, literal=True)
    return out.select("proposta_id", *(f"{c}_encoded" for c in K.ENCODED_COLUMNS))


def encode_labels_joined(spark, folder):
    """The join path for encoders too large for a literal."""
    rows = raw_proposals(spark, folder)
    encoder = E.fit_label_encoder(rows, ["cliente_id"])
    out = E.encode_labels(rows, encoder, ["cliente_id"])
    return out.select("proposta_id", "cliente_id_encoded")


_SEEN = (
    PROP + f""", seen AS (SELECT *, {_BAND.format(x="idade")} AS faixa_etaria FROM prop
 WHERE genero = 'Masculino' AND uf <> 'RJ'), rows_ AS (SELECT *, {_BAND.format(x="idade")} AS faixa_etaria FROM prop)"""
    + "".join(
        f", enc_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
        f"(SELECT DISTINCT translate({c}, '{X.ACCENTED}', '{X.PLAIN}') AS v FROM seen))"
        for c in K.ENCODED_COLUMNS
    )
)


def feature_table(spark, folder):
    table = E.feature_table(raw_proposals(spark, folder), KEY)
    exact = ("idade", "renda", "score", "ticket", "prazo_meses", "taxa_juros_aa",
             "tempo_cliente_meses", "qtd_produtos", "qtd_atrasos_12m", "alto_comprometimento")
    coded = [f"{c}_encoded" for c in K.ENCODED_COLUMNS]
    return table.select(
        *KEY, *exact, F.round("parcela_mensal", 4).alias("parcela_mensal"),
        F.round("perc_comprometimento_renda", 6).alias("perc_comprometimento_renda"),
        F.round("fator_risco", 8).alias("fator_risco"), *coded,
    )


def impute_score_median(spark, folder):
    rows = raw_proposals(spark, folder).withColumn(
        "score",
        F.when(F.col("proposta_id") % 20 == 0, None)
        .when(F.col("proposta_id") % 21 == 0, F.lit(float("nan")))
        .otherwise(F.col("score") + F.lit(0.5)),
    )
    return E.impute_score_median(rows).select("proposta_id", "score")


# --- samples ----------------------------------------------------------------------------------
def _hash_sql(seed: int) -> str:
    return f"substr(md5(concat_ws('|', '{seed}', cast(proposta_id AS varchar))), 1, 15)"


def sample_n(spark, folder):
    return S.sample_n(proposals(spark, folder), 1000, KEY).select("proposta_id", "score")


def stratified_cap(spark, folder):
    return S.stratified_cap(
        proposals(spark, folder), "inadimplente", KEY, cap=400, above=1000
    ).select("proposta_id", "inadimplente")


def stratified_split(spark, folder):
    rows = S.stratified_split(proposals(spark, folder), "inadimplente", KEY)
    return rows.select("proposta_id", F.col("is_test").cast("int").alias("is_test"))


def stratified_split_exact(spark, folder):
    rows = S.stratified_split(proposals(spark, folder), "inadimplente", KEY, exact=True)
    return rows.select("proposta_id", F.col("is_test").cast("int").alias("is_test"))


def stratified_folds(spark, folder):
    return S.stratified_folds(raw_proposals(spark, folder), KEY).select("proposta_id", "fold")


def union_slices(spark, folder):
    rows = raw_proposals(spark, folder).select("proposta_id", "score", "ticket")
    slices = [rows.filter(F.col("proposta_id") % 3 == i) for i in range(3)]
    return S.union_slices([slices[0], slices[1].select("ticket", "score", "proposta_id"), slices[2]])


QUERIES = {
    f.__name__: f
    for f in (
        normalize_aliases, validate_proposals, split_valid, error_rows, batch_results_with_errors,
        check_batch_size, batch_counters, check_required_columns, resolve_columns,
        check_feature_contract, coerce_csv, map_enums, fit_label_encoder, fit_label_encoder_wide,
        encode_labels, encode_labels_joined, feature_table, impute_score_median, sample_n,
        stratified_cap, stratified_split, stratified_split_exact, stratified_folds, union_slices,
    )
}

_VALID = "erros = ''"
_RISK = "round((950 - score_credito) / 650.0::double * 0.9::double, 6)"

ORACLES = {
    "normalize_aliases": DRAFTS + " SELECT proposta_id, "
    + ", ".join(f"{a} AS {c}" for a, c in K.ALIASES.items()) + " FROM drafts",
    "validate_proposals": _CHECKED + """ SELECT proposta_id, upper(uf) AS uf,
        coalesce(qtd_atrasos_12m, 0) AS qtd_atrasos_12m, erros FROM checked""",
    "split_valid": _CHECKED + f""" SELECT proposta_id,
        CASE WHEN {_VALID} THEN 'valid' ELSE 'quarantine' END AS part FROM checked""",
    "error_rows": _CHECKED + f""" SELECT cliente_id, 'Erro' AS nome, valor,
        0.0 AS probabilidade_inadimplencia, score_credito, 'Erro' AS decisao,
        substr(replace(erros, ';', '; '), 1, 150) AS motivo_rejeicao, 0.0 AS perda_evitada,
        'N/A' AS risco_categoria FROM checked WHERE NOT ({_VALID})""",
    "batch_results_with_errors": _CHECKED + f""", r AS (SELECT
         CASE WHEN {_VALID} THEN {_RISK} ELSE 0 END AS p,
         CASE WHEN NOT ({_VALID}) THEN 'Erro' WHEN {_RISK} <= 0.10 THEN 'Aprovar'
          WHEN {_RISK} <= 0.30 THEN 'Revisar' ELSE 'Negar' END AS d, valor FROM checked)
        SELECT count(*) AS total, count(CASE WHEN d = 'Aprovar' THEN 1 END) AS aprovados,
         count(CASE WHEN d = 'Negar' THEN 1 END) AS negados,
         round(count(CASE WHEN d = 'Aprovar' THEN 1 END) / count(*) * 100, 1) AS pct_aprovados,
         round(count(CASE WHEN d = 'Negar' THEN 1 END) / count(*) * 100, 1) AS pct_negados,
         round(avg(p * 100), 1) AS risco_medio,
         sum(cast(CASE WHEN d = 'Negar' AND p > 0.5 THEN valor * p ELSE 0 END AS decimal(28,8)))::double
          AS perda_evitada_total FROM r""",
    "check_batch_size": BATCHES + """, known AS (SELECT DISTINCT batch_id FROM batches
          UNION SELECT DISTINCT batch_id + 1000000 FROM batches),
         n AS (SELECT batch_id, count(*) AS n FROM batches GROUP BY batch_id)
        SELECT batch_id, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'empty'
         WHEN n > 1000 THEN 'too_large' ELSE 'ok' END AS status FROM known LEFT JOIN n USING (batch_id)""",
    "batch_counters": BATCHES + """ SELECT batch_id, count(*) AS total,
        count(CASE WHEN proposta_id % 13 <> 0 THEN 1 END) AS success,
        count(CASE WHEN proposta_id % 13 = 0 THEN 1 END) AS failed FROM batches GROUP BY batch_id""",
    "check_required_columns": PROP + """ SELECT 0 AS ok, 'taxa_juros_aa' AS missing, count(*) AS n_rows,
         23 AS n_columns, round(avg(inadimplente) * 100, 2) AS label_rate FROM prop
        UNION ALL SELECT 1, '', count(*), 24, round(avg(inadimplente) * 100, 2) FROM prop""",
    "resolve_columns": PROP + " SELECT proposta_id, inadimplente, ticket FROM prop",
    "check_feature_contract": PROP + """, n AS (SELECT cast(count(*) AS varchar) AS n, count(*) > 0 AS filled FROM prop)
        SELECT * FROM (VALUES ('features_present', true, ''), ('feature_count', true, '21'),
         ('encoders_present', false, 'tipo_credito'), ('encoder_count', false, '7'),
         ('rows_complete', true, '0')) t("check", ok, detail)
        UNION ALL SELECT 'rows_present', filled, n FROM n""",
    "coerce_csv": UPLOADS + " SELECT cliente_id, "
    + ", ".join(_number_sql(c, kind, default) for c, (kind, default) in K.CSV_NUMBERS.items())
    + ", " + ", ".join(
        (f"upper({_or(c, d)})" if c == "uf" else _or(c, d)) + f" AS {c}"
        for c, d in K.CSV_TEXTS.items()
    ) + " FROM uploads",
    "map_enums": UPLOADS + f""" SELECT cliente_id,
        CASE {_or('genero', 'M')} WHEN 'M' THEN 'Masculino' WHEN 'F' THEN 'Feminino'
         WHEN 'Feminino' THEN 'Feminino' WHEN 'Outro' THEN 'Outro' ELSE 'Masculino' END AS genero,
        {_SCHOOL} AS escolaridade,
        {_rules(_or('tipo_produto', 'Pessoal'), I.PRODUCT_RULES, 'Pessoal')} AS tipo_produto,
        {_rules(_or('canal_aquisicao', 'App'), I.CHANNEL_RULES, 'App')} AS canal_aquisicao FROM uploads""",
    "fit_label_encoder": PROP + ", " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_BAND.format(x='idade') if c == 'faixa_etaria' else c} AS value FROM prop"
        for c in K.ENCODED_COLUMNS
    ).join(("v AS (", ")")) + """ SELECT "column", value,
        row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code
        FROM (SELECT DISTINCT "column", value FROM v)""",
    "fit_label_encoder_wide": PROP + """, v AS (SELECT DISTINCT 'cliente_id' AS "column", cliente_id AS value FROM prop
         UNION ALL SELECT DISTINCT 'uf', uf FROM prop)
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM v""",
    "encode_labels": _SEEN + " SELECT proposta_id, "
    + ", ".join(
        f"coalesce((SELECT code FROM enc_{c} WHERE v = translate(r.{c}, '{X.ACCENTED}', '{X.PLAIN}')), 0) "
        f"AS {c}_encoded" for c in K.ENCODED_COLUMNS
    ) + " FROM rows_ r",
    "encode_labels_joined": PROP + """ SELECT proposta_id,
        dense_rank() OVER (ORDER BY cliente_id) - 1 AS cliente_id_encoded FROM prop""",
    "feature_table": PROP + """ SELECT proposta_id, idade, renda, score, ticket, prazo_meses, taxa_juros_aa,
        tempo_cliente_meses, qtd_produtos, qtd_atrasos_12m,
        CASE WHEN perc > 30 THEN 1 ELSE 0 END AS alto_comprometimento,
        round(parcela_mensal, 4) AS parcela_mensal, round(perc, 6) AS perc_comprometimento_renda,
        round((950 - score) / 650.0::double, 8) AS fator_risco, """
    + ", ".join(_code_sql(c, True) for c in K.ENCODED_COLUMNS) + " FROM prop",
    "impute_score_median": PROP + """, s AS (SELECT proposta_id, CASE WHEN proposta_id % 20 = 0
         OR proposta_id % 21 = 0 THEN NULL ELSE score + 0.5::double END AS score FROM prop)
        SELECT proposta_id, cast(least(greatest(round_even(coalesce(score, (SELECT median(score) FROM s)), 0), 300), 950)
         AS int) AS score FROM s""",
    "sample_n": PROP + f" SELECT proposta_id, score FROM prop ORDER BY {_hash_sql(42)} LIMIT 1000",
    "stratified_cap": PROP + f""", r AS (SELECT proposta_id, inadimplente,
         row_number() OVER (PARTITION BY inadimplente ORDER BY {_hash_sql(42)}) AS k FROM prop)
        SELECT proposta_id, inadimplente FROM r WHERE k <= 400""",
    "stratified_split": PROP + f" SELECT proposta_id, ({_hash_sql(42)} < '{S.share_edge(0.2)}')::int AS is_test FROM prop",
    "stratified_split_exact": PROP + f""", r AS (SELECT proposta_id,
         row_number() OVER (PARTITION BY inadimplente ORDER BY {_hash_sql(42)}) AS k,
         count(*) OVER (PARTITION BY inadimplente) AS n FROM prop)
        SELECT proposta_id, (k <= round(n * 0.2::double))::int AS is_test FROM r""",
    "stratified_folds": PROP + f""" SELECT proposta_id, ({_hash_sql(43)} >= '{S.share_edge(1 / 3)}')::int
        + ({_hash_sql(43)} >= '{S.share_edge(2 / 3)}')::int AS fold FROM prop""",
    "union_slices": PROP + " SELECT proposta_id, score, ticket FROM prop",
}
