"""Validation, encoding, sampling, generators, files and plan shapes."""

import pytest
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.operators import audit as A
from crivo.operators import encoding as E
from crivo.operators import reports as R
from crivo.operators import sampling as S
from crivo.operators import validation as V
from crivo.operators.quantiles import exact_quantiles
from crivo.plans import generators as G
from crivo.plans import training as M
from crivo.session import scratch_path
from crivo.sources import files
from crivo.sources.star import proposals

GOOD = {
    "cliente_id": "12345678901", "idade": 35, "renda_mensal": 5000.0, "score_credito": 650,
    "valor": 15000.0, "prazo": 24, "taxa": 12.5, "tempo_relacionamento": 24,
    "qtd_produtos_ativos": 2, "qtd_atrasos_12m": 0, "genero": "Masculino",
    "estado_civil": "Casado", "escolaridade": "Superior", "regiao": "Sudeste", "uf": "sp",
    "porte_municipio": "Metrópole", "tipo_produto": "CDC", "canal_aquisicao": "App",
}
SCHEMA = (
    "cliente_id string, idade int, renda_mensal double, score_credito int, valor double, prazo int, "
    "taxa double, tempo_relacionamento int, qtd_produtos_ativos int, qtd_atrasos_12m int, "
    "genero string, estado_civil string, escolaridade string, regiao string, uf string, "
    "porte_municipio string, tipo_produto string, canal_aquisicao string"
)


def requests_table(spark, *changes):
    rows = [tuple((GOOD | change).values()) for change in changes]
    return spark.createDataFrame(rows, SCHEMA)


def errors_of(spark, change):
    df = V.validate_proposals(V.normalize_aliases(requests_table(spark, change)))
    return df.first().errors


@pytest.mark.parametrize(
    "change, codes",
    [
        ({}, []),
        ({"idade": 150}, ["idade_range"]),
        ({"idade": -1}, ["idade_range"]),
        ({"idade": None}, ["idade_missing"]),
        ({"score_credito": 1000}, ["score_range"]),
        ({"renda_mensal": 0.0}, ["renda_range"]),
        ({"renda_mensal": float("nan")}, ["renda_range"]),
        ({"qtd_atrasos_12m": None}, []),
        ({"uf": "XX"}, ["uf_enum"]),
        ({"tipo_produto": "Veículo", "genero": "X"}, ["genero_enum", "tipo_credito_enum"]),
        ({"canal_aquisicao": None}, []),
        ({"canal_aquisicao": "Fax"}, ["canal_aquisicao_enum"]),
    ],
)
def test_validation(spark, change, codes):
    assert errors_of(spark, change) == codes


def test_defaults_applied_by_validation(spark):
    df = V.validate_proposals(V.normalize_aliases(requests_table(spark, {"qtd_atrasos_12m": None})))
    assert (df.first().uf, df.first().qtd_atrasos_12m) == ("SP", 0)


def test_batch_limits(spark):
    rows = spark.range(0, 2001).select((F.col("id") > 1000).cast("int").alias("batch"))
    known = spark.createDataFrame([(0,), (1,), (2,)], "batch int")
    got = {r.batch: r.status for r in V.check_batch_size(rows, "batch", known).collect()}
    assert got == {0: "too_large", 1: "ok", 2: "empty"}


def test_first_candidate_column_wins(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "label int, bad int, loan_amount double")
    row = V.resolve_columns(df).first()
    assert (row.inadimplente, row.ticket) == (0, 5.0)
    with pytest.raises(ValueError):
        V.resolve_columns(df.drop("label", "bad"))


def test_encoder_ranks_values_and_both_lookups_agree(spark):
    df = spark.range(0, 3000).select(
        F.concat(F.lit("v"), (F.col("id") * 7919 % 997).cast("string")).alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("string")).alias("b"),
    )
    small = E.fit_label_encoder(df, ["a", "b"])
    values = sorted({f"v{i * 7919 % 997}" for i in range(3000)})
    expected = [("a", v, k) for k, v in enumerate(values)] + [("b", str(k), k) for k in range(3)]
    assert sorted(tuple(r) for r in small.collect()) == sorted(expected)
    literal = E.encode_labels(df, small, ["a", "b"], literal=True)
    joined = E.encode_labels(df, small, ["a", "b"])
    assert sorted(literal.select("a_encoded", "b_encoded").collect()) == sorted(
        joined.select("a_encoded", "b_encoded").collect()
    )


def test_sample_sizes_are_exact(spark):
    df = spark.range(0, 20_000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    assert S.sample_n(df, 1234, ["id"]).count() == 1234
    assert S.sample_n(df, 50_000, ["id"]).count() == 20_000
    capped = S.stratified_cap(df, "y", ["id"], cap=300, above=100)
    assert {r.y: r["count"] for r in capped.groupBy("y").count().collect()} == {0: 300, 1: 300}
    assert S.stratified_cap(df, "y", ["id"], cap=300).count() == 20_000
    split = S.stratified_split(df, "y", ["id"], exact=True).groupBy("y").agg(
        F.count_if("is_test").alias("n")
    )
    assert {r.y: r.n for r in split.collect()} == {0: 3920, 1: 80}


def test_repeated_keys_are_refused(spark):
    df = spark.range(0, 900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("id"))
    h = S.stable_hash("id", seed=42)
    ahead = df.filter(h < df.filter("id = 0").select(h.alias("h")).agg(F.min("h")).scalar()).count()
    with pytest.raises(ValueError):
        S.sample_n(df, ahead + 100, ["id"])


def test_draws_do_not_depend_on_partitions(spark):
    one = G.make_portfolio(G.make_ids(spark, 500, partitions=1))
    many = G.make_portfolio(G.make_ids(spark, 500, partitions=16))
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.count() == 500 and len(one.columns) == 22


def test_generated_rates(spark):
    df = G.make_portfolio(G.make_ids(spark, 40_000))
    rows = df.agg(
        F.avg("inadimplente").alias("rate"),
        F.avg(F.when(F.col("score") < 400, F.col("inadimplente"))).alias("low"),
        F.avg(F.when(F.col("score") > 850, F.col("inadimplente"))).alias("high"),
    ).first()
    assert 0.05 < rows.rate < 0.35 and rows.low > 2 * rows.high
    large = G.make_portfolio_large(G.make_ids(spark, 20_000, 10_000_000))
    row = large.agg(
        F.avg((F.col("regiao") == G.MISSING).cast("int")).alias("lost"),
        F.min("renda_mensal").alias("lo"), F.max("renda_mensal").alias("hi"),
    ).first()
    assert 0.04 < row.lost < 0.06 and row.lo >= 1200 and row.hi <= 35000
    assert dict(large.dtypes)["qtd_produtos_ativos"] == "tinyint" and len(large.columns) == 14
    minimal = G.make_minimal(G.make_ids(spark, 20_000))
    assert 0.04 < minimal.agg(F.avg(F.isnull("score").cast("int"))).first()[0] < 0.06
    flat = G.make_flat(G.make_ids(spark, 5_000))
    assert flat.filter("dias_atraso between 1 and 90").count() == 0


def test_audit_log_on_disk(spark):
    path = scratch_path(spark, "audit")
    rows = spark.createDataFrame(
        [("2024-01-01 23:59:59", "a"), ("2024-01-02 00:00:00", "b"), ("2024-01-03 10:00:00", "c")],
        "t string, event_type string",
    ).select(
        F.col("t").cast("timestamp").alias("timestamp"), "event_type", F.lit("info").alias("severity")
    )
    files.write_audit(rows, path)
    files.write_audit(rows.limit(1), path)
    day = F.lit("2024-01-02").cast("date")
    log = files.scan_audit(spark, path, day)
    assert sorted(r.event_type for r in log.collect()) == ["b", "c"]
    assert "PartitionFilters: [isnotnull(event_date" in log._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    spark.createDataFrame([('{"event_type": "cut', "2024-01-03")], "v string, event_date string").write.mode(
        "append"
    ).partitionBy("event_date").text(path)
    assert files.scan_audit(spark, path).count() == 4
    assert len(files.scan_audit(spark, path).collect()) == 4


def test_retention(spark):
    rows = spark.createDataFrame(
        [("2020-01-01",), ("2024-01-20",), ("notes",)], "event_date string"
    )
    asof = F.lit("2024-01-31 12:00:00").cast("timestamp")
    kept = A.retain_audit(rows.withColumn("timestamp", asof), asof, 30)
    assert sorted(r.event_date for r in kept.collect()) == ["2024-01-20", "notes"]


def test_retained_days_go_to_a_new_place(spark):
    log, kept = scratch_path(spark, "log"), scratch_path(spark, "kept")
    rows = spark.range(40).select(
        F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id AS int))").alias("timestamp"),
        F.lit("logout").alias("event_type"),
    )
    files.write_audit(rows, log)
    files.write_retained(files.scan_audit(spark, log), kept, days=10)
    assert files.scan_audit(spark, kept).count() == 10
    assert files.scan_audit(spark, log).count() == 40


def test_empty_audit_log(spark):
    rows = spark.createDataFrame([], A.AUDIT_SCHEMA + ", event_date date")
    got = {r.metric: r.value for r in A.audit_summary(rows, F.current_timestamp()).collect()}
    assert got["total_events"] == 0 and got["failed_logins"] == 0


def test_metric_log_inserts_once(spark):
    path = scratch_path(spark, "metrics")
    for _ in range(2):
        files.append_model_metrics(files.seed_metrics(spark), path)
    assert spark.read.parquet(path).count() == len(K.SEED_METRICS)


def test_profile_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    row = R.profile(df).first()
    assert (row.n, row.n_null, row.q25, row.q50, row.q75) == (4, 1, 1.75, 2.5, 3.25)


def test_large_table_quantiles_are_exact(spark):
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, 7.5).otherwise((F.col("id") * 7919 % 30_011) / 10).alias("hot"),
        F.when(F.col("id") % 50 != 0, F.col("id") % 11).alias("few"),
        F.lit(None).cast("double").alias("none"),
    )
    for buckets in (3, 50, 4096):
        found = exact_quantiles(df, ["hot", "few", "none"], [0.0, 0.01, 0.5, 0.999, 1.0], buckets).collect()
        assert {r["column"] for r in found} == {"hot", "few"}
        for r in found:
            expected = df.agg(F.percentile(r["column"], F.lit(r.prob))).first()[0]
            assert r.value == pytest.approx(expected)
    middle = df.agg(F.median("hot")).first()[0]
    filled = E.impute_score_median(df.select(F.lit(None).cast("double").alias("score"), "hot").unionByName(
        df.select(F.col("hot").alias("score"), "hot")))
    assert filled.filter("score is null").count() == 0 and middle > 300


def test_saved_run_serves_what_was_trained(spark):
    df = G.make_portfolio(G.make_ids(spark, 1500))
    run = M.fitted_run(df, ["id"], maxIter=3, maxDepth=3)
    path = scratch_path(spark, "run")
    M.save_run(run, path)
    again = M.load_run(spark, path)
    assert type(again.model) is type(run.model) and again.features == run.features
    assert again.explained() == run.explained() and len(run.explained()) == 10
    left = run.score(df).orderBy("id").select("id", "probability", "explainability").collect()
    assert left == again.score(df).orderBy("id").select("id", "probability", "explainability").collect()
    forest = M.train_forest(df, numTrees=2)
    M.save_model_run(forest, f"{path}/forest", run.metrics, run.encoder, features=K.FOREST_FEATURES)
    assert M.load_run(spark, f"{path}/forest").model.getNumTrees == 2
    M.save_model_run(forest, f"{path}/bad", run.metrics, run.encoder)
    with pytest.raises(ValueError):
        M.load_run(spark, f"{path}/bad")


def test_contract_counts_the_models_inputs(spark):
    df = spark.createDataFrame([tuple(range(21))], list(K.FEATURE_ORDER))
    forest = M.train_forest(G.make_portfolio(G.make_ids(spark, 200)), numTrees=1, maxDepth=2)
    for model, ok in ((None, True), (forest, False)):
        found = {r["check"]: r.ok for r in V.check_feature_contract(df, K.FEATURE_ORDER, model=model).collect()}
        assert found["feature_count"] is ok


def test_report_leaves_nan_out(spark):
    from crivo.operators import evaluation as X

    df = spark.createDataFrame([(0.9, 1), (float("nan"), 1), (float("nan"), 0), (0.2, 0), (None, 1)], "p double, inadimplente int")
    counts = ("tn", "fp", "fn", "tp")
    report = X.classification_report(df).select(*counts).first()
    assert report == X.evaluation_summary(df).select(*counts).first() and tuple(report) == (1, 0, 0, 1)


def test_audit_reports_prune_by_day(spark):
    from crivo.operators import audit as A

    rows = spark.range(0, 600).select(
        F.timestamp_seconds(F.col("id") * 7200 + 1_700_000_000).alias("timestamp"),
        F.lit("login_failed").alias("event_type"), F.lit("info").alias("severity"),
        F.lit("u").alias("user_id"), F.lit("n").alias("username"), F.lit("1.1.1.1").alias("ip_address"),
        F.create_map(F.lit("a"), F.lit("b")).alias("details"), F.create_map(F.lit("c"), F.lit(True)).alias("compliance"),
    )
    path = scratch_path(spark, "log")
    files.write_audit(rows, path)
    log = files.scan_audit(spark, path)
    asof = F.timestamp_seconds(F.lit(1_700_000_000 + 600 * 7200))
    for report in (A.audit_statistics, A.audit_summary):
        plan = report(log, asof, 7)._jdf.queryExecution().executedPlan().toString()
        filters = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.split("\n") if "PartitionFilters: [" in x]
        assert filters and all("event_date" in x for x in filters)
        total = report(log, asof, 7).filter("metric = 'total_events'").first().value
        assert total == 84 and report(log, None, 7).filter("metric = 'total_events'").first().value == 85


def test_quantiles_of_wide_and_odd_numbers(spark):
    rows = [(1e-300,), (2.0,), (3.0,), (1e300,), (float("nan"),), (None,), (-1.7e308,), (1.7e308,)]
    df = spark.createDataFrame(rows, "x double")
    found = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0.0, 0.4, 0.6, 1.0], 16).collect()}
    assert found == {0.0: -1.7e308, 0.4: 2.0, 0.6: 3.0, 1.0: 1.7e308}
    assert exact_quantiles(df.filter("x is null"), ["x"], [0.5]).count() == 0
    assert "percentile" not in R.profile(df)._jdf.queryExecution().toString()


def test_exact_split_of_many_classes(spark):
    df = spark.range(0, 20_000).select("id", F.nullif(F.col("id") % 5000, F.lit(7)).alias("cls"))
    split = S.stratified_split(df, "cls", ["id"], test_share=0.25, exact=True)
    sizes = split.groupBy("cls").agg(F.count_if("is_test").alias("n"), F.count("*").alias("all"))
    assert sizes.count() == 5000 and {(r.n, r.all) for r in sizes.collect()} == {(1, 4)}


def test_scan_reads_only_what_is_asked(spark, folder):
    path = scratch_path(spark, "loans")
    files.write_portfolio(proposals(spark, folder), path)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = files.scan_portfolio(spark, path).filter("score > 500")._jdf.queryExecution().explainString(mode)
    assert "ReadSchema: struct<score:int,ticket:double,inadimplente:int>" in plan
    assert "PushedFilters: [IsNotNull(score), GreaterThan(score,500)]" in plan


def test_scoring_is_one_narrow_stage(spark):
    df = G.make_portfolio(G.make_ids(spark, 400))
    model, metrics = M.training_run(df, ["id"], maxIter=2, maxDepth=2)
    batch = M.score_batch(model, df.withColumn("renda", F.when(F.col("id") != 7, F.col("renda"))))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    counted = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok")).first()
    assert counted.n == 400 and counted.ok < 400
    bad = batch.filter("id = 7").first()
    assert not bad.ok and bad.probability is None
    assert 0 <= metrics.first().auc <= 1


def test_profiles_are_judged(spark):
    df = G.make_portfolio(G.make_ids(spark, 3000))
    model, _ = M.training_run(df, ["id"], maxIter=5, maxDepth=4)
    judged = M.expected_vs_actual(model, M.profile_rows(spark)).collect()
    assert len(judged) == 6 and {r.status for r in judged} <= {"pass", "warn", "fail"}
    passed = sum(r.status != "fail" for r in judged) / 6
    assert all(r.conjunto_ok == (passed >= 0.8) for r in judged)
    assert M.extreme_profiles(model, spark).count() == 2


def test_cut_recipes_are_named_short(spark, folder, monkeypatch):
    from crivo.catalog import model_queries as Q

    class Asked(Exception):
        pass

    def stop(*_, **given):
        whole = {"learner": M.train_regularised, "keys": Q.KEY, "patience": M.PATIENCE}
        raise Asked({k: v for k, v in given.items() if whole.get(k) != v})

    for name in ("fitted_run", "train_gbt", "train_with_patience", "tune"):
        monkeypatch.setattr(M, name, stop)
    monkeypatch.setattr(Q, "_MODELS", {})

    def cut(query):
        try:
            query(spark, folder)
        except Asked as asked:
            return asked.args[0]

    registered = {n: f for n, f in Q.QUERIES.items() if n not in ("append_model_metrics", "train_forest")}
    assert {n for n, f in registered.items() if cut(f)} == {n for n in registered if n.endswith("_short")}
    assert {n: cut(f) for n, f in Q.WHOLE.items()} == dict.fromkeys(Q.WHOLE, {})


def test_only_the_newest_days_of_a_log_are_read(spark):
    from crivo.session import scratch_path
    from crivo.sources import files

    path = scratch_path(spark, "log")
    rows = spark.range(400).select(
        (F.lit("2024-03-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, cast(id % 40 AS int), 0, 0, id)")).alias("timestamp"),
        F.when(F.col("id") % 4 == 0, "login_failed").otherwise("other").alias("event_type"),
        F.lit("info").alias("severity"), F.col("id").cast("string").alias("user_id"), F.lit("u").alias("username"),
        F.lit("1.1.1.1").alias("ip_address"),
        F.create_map(F.lit("id"), F.col("id").cast("string")).alias("details"),
        F.create_map(F.lit("ok"), F.lit(True)).alias("compliance"),
    )
    files.write_audit(rows, path)
    days = files.log_days(spark, path)
    assert len(days) == 40 and days[0] == "2024-04-09" and days == sorted(days, reverse=True)
    recent = files.recent_audit(spark, path, 15)
    assert {f.split("event_date=")[1][:10] for f in recent.inputFiles()} == set(days[:2])
    expected = sorted(rows.collect(), key=lambda r: (-r.timestamp.date().toordinal(), r.timestamp))[:15]
    assert [r.details["id"] for r in recent.collect()] == [r.details["id"] for r in expected]
    failed = files.recent_audit(spark, path, 10_000, "login_failed")
    assert failed.count() == 100 and len({r.event_date for r in failed.collect()}) == 10
    files.retain_log(spark, path, f"{path}-kept", days=3)
    assert files.log_days(spark, f"{path}-kept") == days[:3]


def test_quantiles_scan_the_table_a_fixed_number_of_times(spark):
    """The table once, its stored numbers three times, whatever the values."""
    for values in (F.rand(3), F.pow(F.lit(10.0), F.col("id") % 60), F.lit(1.0)):
        reads = spark.sparkContext.accumulator(0)
        df = spark.range(3000).select(values.alias("x"))

        def seen(batches):
            for batch in batches:
                reads.add(len(batch))
                yield batch

        counted = df.mapInPandas(seen, df.schema)
        got = {r.prob: r.value for r in exact_quantiles(counted, ["x"], [0.1, 0.5, 0.99]).collect()}
        assert reads.value == 3000
        xs = sorted(r.x for r in df.collect())
        for q, value in got.items():
            at = q * 2999
            low, high = xs[int(at)], xs[min(int(at) + 1, 2999)]
            assert value == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
