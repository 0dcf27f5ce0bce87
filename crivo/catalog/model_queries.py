"""Training, evaluation, scoring and generated tables, driven by the proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo import constants as K
from crivo.catalog.dirty import drafts
from crivo.catalog.fixture_sql import PROP
from crivo.catalog.intake_queries import _CHECKED, _hash_sql
from crivo.functions import features as X
from crivo.operators import encoding as E
from crivo.operators import reports as R
from crivo.operators import sampling as S
from crivo.plans import generators as G
from crivo.plans import training as M
from crivo.session import scratch_path, stored
from crivo.sources import files
from crivo.sources.star import proposals, raw_proposals, table

KEY = ["proposta_id"]
# Small recipes of the queries named _short and of the run they share. The functions in WHOLE run
# the presets and are timed by `bench.py --full`.
QUICK = {"maxIter": 8, "maxDepth": 4}
_MODELS: dict = {}


def _trained(spark, folder):
    """One quick run per session and folder, shared by the queries that only serve it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MODELS:
        _MODELS[key] = M.fitted_run(proposals(spark, folder), KEY, **QUICK)
    return _MODELS[key]


def _report(model, metrics, floor=0.7):
    """What a training run must show whatever its trees are: size, weights, counts, a floor."""
    weights = model.featureImportances.toArray()
    return metrics.select(
        F.lit(model.getNumTrees).alias("n_trees"), F.lit(model.numFeatures).alias("n_features"),
        F.lit(round(float(weights.sum()), 6)).alias("importance_sum"),
        F.lit(int((weights < 0).sum())).alias("n_negative"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
        (F.col("fn") + F.col("tp")).alias("n_bad"), (F.col("auc") >= floor).cast("int").alias("auc_ok"),
    )


def _held_out(rows):
    return S.stratified_split(rows, "inadimplente", KEY)


def assemble_features(spark, folder):
    rows = M.assemble_features(raw_proposals(spark, folder))
    values = M.vector_to_array("features")
    return rows.select(
        "proposta_id", F.size(values).alias("n"), values[0].alias("idade"),
        values[2].alias("score"), values[20].alias("tipo_credito_encoded"),
    )


def train_gbt(spark, folder, **recipe):
    run = M.fitted_run(proposals(spark, folder), KEY, **recipe)
    return _report(run.model, run.metrics)


def train_gbt_short(spark, folder):
    return train_gbt(spark, folder, **QUICK)


def feature_importance_top_short(spark, folder):
    """The ten largest importances: in order, distinct, and known by name."""
    run = _trained(spark, folder)
    top = [tuple(r) for r in M.importances(run.model, spark, 10).collect()]
    ordered = top == sorted(top, key=lambda r: (-r[1], r[0]))
    known = len({n for n, _ in top} & set(run.features))
    given = proposals(spark, folder).agg(F.count(F.lit(1)).alias("n_rows"))
    return given.select(
        "n_rows", F.lit(len(top)).alias("n_top"), F.lit(known).alias("n_known"),
        F.lit(int(ordered)).alias("ordered"),
        F.lit(int(dict(top) == run.explained())).alias("served"),
    )


def train_regularised(spark, folder, **recipe):
    run = M.fitted_run(proposals(spark, folder), KEY, learner=M.train_regularised, **recipe)
    return _report(run.model, run.metrics)


def train_regularised_short(spark, folder):
    return train_regularised(spark, folder, rounds=6, depth=4)


def train_early_stopping(spark, folder, patience=M.PATIENCE, **recipe):
    """Stops on a part of the training rows and reports on rows it has not seen.

    ``waited`` is the number of rounds grown after the best one, ``kept`` whether the model ends
    with that round, ``improved`` whether its loss is below that of no tree at all.
    """
    rows = _held_out(M.assemble_features(proposals(spark, folder)))
    parts = S.stratified_folds(rows, KEY, 5).withColumn("checks", F.col("fold") == 0)
    training = parts.filter(~F.col("is_test"))
    model, losses = M.train_with_patience(training, "checks", patience=patience, keys=KEY, **recipe)
    best = losses.index(min(losses))
    shown = _report(model, M.evaluate(model, rows.filter("is_test"))).drop("n_trees")
    return shown.withColumns({
        "waited": F.lit(len(losses) - 1 - best), "kept": F.lit(int(model.getNumTrees == best)),
        "improved": F.lit(int(losses[best] < losses[0])),
    })


def train_early_stopping_short(spark, folder):
    return train_early_stopping(spark, folder, patience=3, rounds=40, depth=3, leaves=8, rate=0.5)


def train_compact(spark, folder, **recipe):
    table_ = G.enrich_portfolio(G.make_base(_ids(spark, folder)))
    encoder = E.fit_label_encoder(table_, K.COMPACT_ENCODED)
    rows = M.assemble_compact(table_, encoder)
    model = M.train_gbt(rows, **recipe)
    return M.importances(
        model, spark, 12, K.COMPACT_NUMERIC + tuple(f"{c}_encoded" for c in K.COMPACT_ENCODED)
    )


def train_compact_short(spark, folder):
    return train_compact(spark, folder, **QUICK)


def train_forest(spark, folder):
    rows = _held_out(proposals(spark, folder))
    model = M.train_forest(rows.filter(~F.col("is_test")))
    scored = M.with_probability(model, M.assemble(rows.filter("is_test"), K.FOREST_FEATURES))
    return _report(model, M.evaluation_summary(scored.select("p", "inadimplente")))


def tune(spark, folder, **search):
    """A search over all parameters; the trials in order, each inside the space."""
    rows = M.assemble_features(proposals(spark, folder))
    model, trials = M.tune(rows, KEY, **search)
    best = trials.agg(F.max("mean_auc")).scalar()
    return trials.select(
        "trial", F.col("mean_auc").between(0.7, 1.0).cast("int").alias("auc_ok"),
        *(F.col("params").contains(f"'{name}'").cast("int").alias(name) for name in M.SPACE),
        F.lit(model.numFeatures).alias("n_features"), (best >= F.col("mean_auc")).cast("int").alias("best_ok"),
    )


def tune_short(spark, folder):
    space = M.SPACE | {"maxIter": (2, 4, False), "maxDepth": (2, 3, False)}
    return tune(spark, folder, n=2, space=space)


def evaluate_model_short(spark, folder):
    """The counts of the report by the rows' own probabilities, and rates that follow from them."""
    run = _trained(spark, folder)
    rows = _held_out(proposals(spark, folder)).filter("is_test")
    scored = M.with_probability(run.model, run.assemble(rows)).select("p", "inadimplente")
    called, bad = F.col("p") >= 0.5, F.col("inadimplente") == 1
    counts = stored(scored, "scored").agg(
        F.count_if(~called & ~bad).alias("tn_"), F.count_if(called & ~bad).alias("fp_"),
        F.count_if(~called & bad).alias("fn_"), F.count_if(called & bad).alias("tp_"),
    )
    same = (F.col("tn") == F.col("tn_")) & (F.col("fp") == F.col("fp_")) & (
        F.col("fn") == F.col("fn_")) & (F.col("tp") == F.col("tp_"))
    rates = F.abs(F.col("recall") - F.col("tp") / (F.col("tp") + F.col("fn"))) < 1e-7
    return run.metrics.join(counts, F.lit(True)).select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
        same.cast("int").alias("same_counts"), rates.cast("int").alias("recall_ok"),
        F.col("ks").between(0.3, 1).cast("int").alias("ks_ok"),
    )


def score_batch_short(spark, folder):
    """Every draft back, with its errors, and responses that follow from the probability."""
    rows = _trained(spark, folder).score(drafts(spark, folder))
    p = F.col("probability")
    decision = F.when(p <= 0.10, "Aprovar").when(p <= 0.30, "Revisar").otherwise("Negar")
    near = F.least(F.abs(p - 0.10), F.abs(p - 0.30), F.abs(p - 0.5)) < 1e-4  # shown with four digits
    follows = near | (
        (F.col("recommendation") == decision) & (F.col("prediction") == (p >= 0.5).cast("int"))
    )
    return rows.select(
        "proposta_id", F.col("ok").cast("int").alias("ok"), F.array_join("errors", ";").alias("erros"),
        F.coalesce(p.between(0, 1), F.lit(False)).cast("int").alias("scored"),
        F.coalesce(follows, F.lit(True)).cast("int").alias("follows"),
        F.size("explainability").alias("n_explained"),
    )


def score_batch_counters_short(spark, folder):
    rows = drafts(spark, folder).withColumn("batch_id", F.floor(F.col("proposta_id") / 900))
    return R.batch_counters(_trained(spark, folder).score(rows), "batch_id")


def expected_vs_actual_short(spark, folder):
    run = _trained(spark, folder)
    return M.expected_vs_actual(run.model, M.profile_rows(spark), run.encoder)


def judged_profiles(spark, folder):
    """Proposals as profiles: their known probability, stated for the portfolio, against a score rule."""
    rows = proposals(spark, folder).withColumns({
        "perfil": F.col("proposta_id").cast("string"),
        "esperado": F.when(F.col("score") >= 500, "Aprovar").otherwise("Negar"),
        "p": M.D.prior_shifted("p", 0.5, M.PRIOR),
    })
    return M.judged_profiles(rows).select("perfil", "esperado", "obtido", "status", "conjunto_ok")


def extreme_profiles_short(spark, folder):
    return M.extreme_profiles(_trained(spark, folder).model, spark)


def save_model_run_short(spark, folder):
    """A saved and reloaded run reports the very metrics of its training run."""
    run = _trained(spark, folder)
    path = scratch_path(spark, "run")
    M.save_run(run, path)
    again = M.load_run(spark, path)
    rows = _held_out(proposals(spark, folder)).filter("is_test")
    both = run.metrics.unionByName(stored(M.evaluate(again.model, again.assemble(rows)), "metrics"))
    saved = spark.read.parquet(f"{path}/metrics").select("n_features", "model_type")
    versions = both.agg(
        F.count_distinct(F.struct(*both.columns)).alias("n_versions"), F.count(F.lit(1)).alias("n_reports"),
        F.max(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
    )
    return versions.join(saved, F.lit(True)).withColumn("n_named", F.lit(len(again.features)))


def append_model_metrics(spark, folder):
    """Seed rows and per-product default rates, each appended twice."""
    path = scratch_path(spark, "metrics")
    rates = proposals(spark, folder).groupBy("tipo_credito").agg(
        F.avg("inadimplente").cast("decimal(10,6)").alias("metric_value")
    ).select(
        F.lit("2.0.0").alias("model_version"), F.col("tipo_credito").alias("metric_name"),
        "metric_value", F.current_timestamp().alias("recorded_at"),
    )
    for rows in (files.seed_metrics(spark), rates, files.seed_metrics(spark), rates):
        files.append_model_metrics(rows, path)
    return spark.read.parquet(path).select("model_version", "metric_name", "metric_value")


# --- generated tables: one row per order ------------------------------------------------------
def _ids(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))


def make_portfolio(spark, folder):
    return G.make_portfolio(_ids(spark, folder))


def make_portfolio_large(spark, folder):
    return G.make_portfolio_large(_ids(spark, folder))


def make_minimal(spark, folder):
    return G.make_minimal(_ids(spark, folder))


def enrich_portfolio(spark, folder):
    return G.enrich_portfolio(G.make_minimal(_ids(spark, folder)).drop("ticket", "inadimplente"))


def enrich_portfolio_windows(spark, folder):
    return G.enrich_portfolio(G.make_base(_ids(spark, folder)), variant="windows")


def make_flat(spark, folder):
    return G.make_flat(_ids(spark, folder))


def _rules(rows, name, *rules):
    """How many rows a generator made and how many keep all of its rules."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & rule
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(kept).alias("n_kept")).select(
        F.lit(name).alias("tabela"), "n_rows", "n_kept"
    )


def _outcome_rules():
    late, days = F.col("inadimplente") == 1, F.col("dias_atraso")
    stage = F.when(late, "Stage 3").when(F.col("score") < 600, "Stage 2").otherwise("Stage 1")
    return (
        F.col("score").between(300, 950), F.col("idade").between(18, 80),
        F.col("qtd_produtos_ativos").between(1, 10), F.col("ticket").between(1000, 500000),
        F.col("lgd").between(0.2, 0.9), F.when(late, days.between(91, 359)).otherwise(days == 0),
        F.col("perda_esperada") == F.when(late, F.col("ticket") * F.col("lgd")).otherwise(0),
        F.col("provisao_stage") == stage,
    )


def generated_rules(spark, folder):
    """Rules the generated tables keep whatever the draws are."""
    ids = _ids(spark, folder)
    product, term = F.col("tipo_produto"), F.col("prazo")

    def per_product(table_, rule):
        return G._by(product, {p: rule(values) for p, values in table_.items()})

    portfolio = _rules(
        G.make_portfolio(ids), "portfolio", F.col("score").between(300, 949),
        F.col("idade").between(18, 69), F.col("qtd_produtos").between(1, 5),
        F.col("tempo_cliente_meses").between(1, 119), F.col("taxa_juros_aa").between(8.0, 20.0),
        F.col("renda").isin(*G.INCOMES), F.col("ticket").isin(*G.TICKETS),
        F.col("prazo_meses").isin(*G.TERMS), F.col("inadimplente").isin(0, 1),
        F.col("qtd_atrasos_12m") <= F.when(F.col("score") < 500, 5).when(
            F.col("score") < 700, 2).otherwise(1),
    )
    large = _rules(
        G.make_portfolio_large(ids), "large", F.col("score_credito").between(300, 950),
        F.col("renda_mensal").between(1200, 35000), F.col("idade").between(18, 75),
        F.col("tempo_relacionamento").between(1, 200), F.col("qtd_produtos_ativos").between(1, 5),
        per_product(G.PRODUCT_VALUE_RANGES, lambda v: F.col("valor").between(v[0], v[1] - 1)),
        per_product(G.PRODUCT_TERMS, lambda v: term.isin(*v)),
        F.col("taxa").between(0.0149, 0.3501),
        (F.col("regiao") == G.MISSING) == (F.col("canal_aquisicao") == G.MISSING),
        F.col("mes_referencia").isin(*G.MONTHS),
    )
    minimal = _rules(
        G.make_minimal(ids), "minimal",
        F.coalesce(F.col("score").between(300, 950), F.lit(True)),
        F.col("renda").between(800, 600000), F.col("ticket").between(1000, 500000),
    )
    demo = _rules(
        enrich_portfolio(spark, folder), "demo", *_outcome_rules(),
        per_product(G.TERM_RANGE_BY_PRODUCT, lambda v: term.between(v[0], v[1] - 1)),
    )
    windows = _rules(
        enrich_portfolio_windows(spark, folder), "windows", *_outcome_rules(),
        per_product(G.TERM_BY_PRODUCT, lambda v: term.between(max(v - 6, 1), v + 6)),
    )
    flat = _rules(
        G.make_flat(ids), "flat", *_outcome_rules(),
        per_product(G.TERM_BY_PRODUCT, lambda v: term == v),
        per_product(G.RATE_BY_PRODUCT, lambda v: F.col("taxa") == v),
    )
    return S.union_slices([portfolio, large, minimal, demo, windows, flat])


def held_out_counts_short(spark, folder):
    """Held-out rows and defaults the evaluation has seen."""
    return _trained(spark, folder).metrics.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"),
        (F.col("fn") + F.col("tp")).alias("n_bad"),
        F.col("auc").between(0.5, 1.0).cast("int").alias("auc_ok"),
    )


def scored_responses_short(spark, folder):
    """Responses of valid rows, counted by whether they agree with their probability."""
    rows = _trained(spark, folder).score(drafts(spark, folder))
    p = F.col("probability")
    agrees = (
        p.between(0, 1)
        & (F.abs(F.col("risk_score") - p * 100) <= 0.0101)
        & F.col("recommendation").isin("Aprovar", "Revisar", "Negar")
        & F.col("confidence").between(0.6, 1.0)
        & F.col("prediction").isin(0, 1)
    )
    empty = p.isNull() & F.col("recommendation").isNull() & F.col("prediction").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ok") & agrees).alias("n_valid"),
        F.count_if(~F.col("ok") & empty).alias("n_invalid"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        assemble_features, train_gbt_short, feature_importance_top_short, train_regularised_short,
        train_early_stopping_short, train_compact_short, train_forest, tune_short, evaluate_model_short,
        score_batch_short, score_batch_counters_short, expected_vs_actual_short, judged_profiles, extreme_profiles_short,
        save_model_run_short, append_model_metrics, make_portfolio, make_portfolio_large, make_minimal,
        enrich_portfolio, enrich_portfolio_windows, make_flat, generated_rules, held_out_counts_short,
        scored_responses_short,
    )
}
# The whole recipes: presets uncut, 20 trials over the whole space.
WHOLE = {f.__name__: f for f in (train_gbt, train_regularised, train_early_stopping, train_compact, tune)}

_TEST = PROP + f""", test AS (SELECT * FROM prop WHERE {_hash_sql(42)} < '333333333333333')"""


def _trees(trees, features):
    return _TEST + f"""SELECT {trees} AS n_trees, {features} AS n_features, 1.0 AS importance_sum,
        0 AS n_negative, count(*) AS n_test, count(CASE WHEN inadimplente = 1 THEN 1 END) AS n_bad,
        1 AS auc_ok FROM test"""


_ODDS = "(0.0639::double * (1 - 0.5::double) / (0.5::double * (1 - 0.0639::double)))"
ORACLES = {
    "judged_profiles": PROP + f""", s AS (SELECT proposta_id, score, p * {_ODDS} / (p * {_ODDS} + (1 - p)) AS q FROM prop),
        d AS (SELECT proposta_id::varchar AS perfil, CASE WHEN score >= 500 THEN 'Aprovar' ELSE 'Negar' END AS esperado,
          CASE WHEN q <= 0.10 THEN 'Aprovar' WHEN q <= 0.30 THEN 'Revisar' ELSE 'Negar' END AS obtido FROM s),
        j AS (SELECT *, CASE WHEN obtido = esperado THEN 'pass' WHEN esperado = 'Negar' AND obtido = 'Aprovar' THEN 'warn'
          ELSE 'fail' END AS status FROM d)
        SELECT *, (SELECT avg((status <> 'fail')::int) FROM j) >= 0.8 AS conjunto_ok FROM j""",
    "train_gbt_short": _trees(8, 21),
    "train_regularised_short": _trees(6, 21),
    "train_forest": _trees(10, 9),
    "train_early_stopping_short": _TEST + """SELECT 21 AS n_features, 1.0 AS importance_sum, 0 AS n_negative,
        count(*) AS n_test, count(CASE WHEN inadimplente = 1 THEN 1 END) AS n_bad, 1 AS auc_ok,
        3 AS waited, 1 AS kept, 1 AS improved FROM test""",
    "feature_importance_top_short": PROP + """ SELECT count(*) AS n_rows, 10 AS n_top, 10 AS n_known,
        1 AS ordered, 1 AS served FROM prop""",
    "tune_short": """SELECT unnest([0, 1]) AS trial, 1 AS auc_ok, 1 AS "maxIter", 1 AS "stepSize", 1 AS "maxDepth",
        1 AS "minInstancesPerNode", 1 AS "subsamplingRate", 1 AS "featureSubsetStrategy",
        21 AS n_features, 1 AS best_ok""",
    "evaluate_model_short": _TEST + """SELECT count(*) AS n_test, 1 AS same_counts, 1 AS recall_ok, 1 AS ks_ok FROM test""",
    "score_batch_short": _CHECKED + """ SELECT proposta_id, CASE WHEN erros = '' THEN 1 ELSE 0 END AS ok, erros,
        CASE WHEN erros = '' THEN 1 ELSE 0 END AS scored, 1 AS follows, 10 AS n_explained FROM checked""",
    "save_model_run_short": _TEST + """SELECT 1 AS n_versions, 2 AS n_reports, count(*) AS n_test, 21 AS n_features,
        'GBTClassificationModel' AS model_type, 21 AS n_named FROM test""",
    "assemble_features": PROP + """ SELECT proposta_id, 21 AS n, idade, score,
        CASE tipo_credito WHEN 'CDC' THEN 0 WHEN 'Imobiliário' THEN 1 WHEN 'Cartão' THEN 2 ELSE 3 END
        AS tipo_credito_encoded FROM prop""",
    "score_batch_counters_short": _CHECKED + """ SELECT cast(floor(proposta_id / 900) AS bigint) AS batch_id,
        count(*) AS total, count(CASE WHEN erros = '' THEN 1 END) AS success,
        count(CASE WHEN erros <> '' THEN 1 END) AS failed FROM checked GROUP BY 1""",
    "append_model_metrics": PROP + """ SELECT '2.0.0' AS model_version, tipo_credito AS metric_name,
        cast(avg(inadimplente) AS decimal(10,6)) AS metric_value FROM prop GROUP BY tipo_credito
        UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"('{v}', '{n}', {x}::decimal(10,6))" for v, n, x in K.SEED_METRICS) + ")",
    "generated_rules": """SELECT tabela, count(*) AS n_rows, count(*) AS n_kept FROM orders
        JOIN (VALUES ('portfolio'), ('large'), ('minimal'), ('demo'), ('windows'), ('flat')) t(tabela) ON true
        GROUP BY tabela""",
    "held_out_counts_short": PROP + f""" SELECT count(*) AS n_test,
        count(CASE WHEN inadimplente = 1 THEN 1 END) AS n_bad, 1 AS auc_ok
        FROM prop WHERE {_hash_sql(42)} < '{S.share_edge(0.2)}'""",
    "scored_responses_short": _CHECKED + """ SELECT count(*) AS n_rows, count(CASE WHEN erros = '' THEN 1 END) AS n_valid,
        count(CASE WHEN erros <> '' THEN 1 END) AS n_invalid FROM checked""",
}
