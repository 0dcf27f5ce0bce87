"""Threshold analytics on the hundred-row formula table, edge rows and partitionings."""

import pytest
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.operators import evaluation as E
from crivo.operators import thresholds as T


@pytest.fixture(scope="module")
def loans(spark):
    rows = [(300 + 6 * i, 5000.0 + 50 * i, int(i % 4 == 0)) for i in range(100)]
    return spark.createDataFrame(rows, "score int, ticket double, inadimplente int")


def brute(rows, t):
    ok = [(s is not None and s == s and (s - 300) / 650 >= t, v, y) for s, v, y in rows]
    approved = [r for r in ok if r[0]]
    return {
        "total": len(ok),
        "approved": len(approved),
        "revenue": sum(v for _, v, _ in approved),
        "losses": sum(v for _, v, y in approved if y == 1),
        "missed": sum(v for a, v, y in ok if not a and y == 0),
        "avoided": sum(v for a, v, y in ok if not a and y == 1),
    }


def as_brute(row):
    return {
        "total": row.totalClientes, "approved": row.clientesAprovados, "revenue": row.receitaTotal,
        "losses": row.perdasInadimplencia, "missed": row.oportunidadesPerdidas,
        "avoided": row.perdasEvitadas,
    }


def test_metrics_match_brute_force(loans):
    rows = [tuple(r) for r in loans.collect()]
    for t in (0.0, 0.3, 0.5, 0.91, 1.0):
        assert as_brute(T.threshold_metrics(loans, t).first()) == brute(rows, t)


def test_table_equals_single_metrics(loans):
    table = {r.threshold: as_brute(r) for r in T.threshold_table(loans).collect()}
    rows = [tuple(r) for r in loans.collect()]
    assert table == {t: brute(rows, t) for t in K.SENSITIVITY_GRID}


def test_exact_double_threshold(spark):
    """Score 495 is 0.3 exactly and misses the third grid point by one unit in the last place."""
    df = spark.createDataFrame([(495, 1000.0, 0)], "score int, ticket double, inadimplente int")
    assert T.threshold_metrics(df, 0.3).first().clientesAprovados == 1
    third = T.threshold_table(df).filter(F.col("threshold") == K.SENSITIVITY_GRID[2]).first()
    assert third.clientesAprovados == 0


def test_missing_scores_are_rejected(spark):
    df = spark.createDataFrame(
        [(None, 10.0, 1), (float("nan"), 20.0, 0), (950.0, 40.0, 0)],
        "score double, ticket double, inadimplente int",
    )
    row = T.threshold_metrics(df, 0.5).first()
    assert (row.clientesAprovados, row.perdasEvitadas, row.oportunidadesPerdidas) == (1, 10.0, 20.0)
    matrix = T.confusion_matrix(df, 0.5).first()
    assert (matrix.tp, matrix.fp, matrix.tn, matrix.fn) == (1, 1, 1, 0)
    last = T.roc_curve(df).orderBy(F.desc("threshold")).first()
    assert (last.fpr, last.tpr) == (0.0, 0.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "score int, ticket double, inadimplente int")
    row = T.threshold_metrics(df, 0.4).first()
    assert row.threshold == 0.4 and all(v == 0 for v in tuple(row)[:-1])
    assert T.threshold_sensitivity(df).count() == 9
    assert T.roc_curve(df).count() == 50
    assert T.roc_auc_grid(T.roc_curve(df)).first().auc == 0.0


def test_roc_is_monotone_and_stops_short(loans):
    rows = T.roc_curve(loans).orderBy("threshold").collect()
    assert [r.tpr for r in rows] == sorted(r.tpr for r in rows)
    assert [r.fpr for r in rows] == sorted(r.fpr for r in rows)
    top = loans.sparkSession.createDataFrame(
        [(950, 1.0, 1), (300, 1.0, 0)], "score int, ticket double, inadimplente int"
    )
    assert T.roc_curve(top).orderBy(F.desc("threshold")).first().tpr == 0.0


def test_lowest_threshold_wins_ties(spark):
    df = spark.createDataFrame([(950, 10.0, 0)], "score int, ticket double, inadimplente int")
    for objective in ("profit", "risk", "balanced", "anything"):
        assert T.optimize_threshold(df, objective).first().optimal_threshold == 0.1


def test_partitioning_does_not_matter(loans):
    for df in (loans.coalesce(1), loans.repartition(8)):
        assert sorted(T.threshold_table(df).collect()) == sorted(T.threshold_table(loans).collect())


def test_one_data_sized_shuffle_and_no_cross_join(loans):
    plan = T.threshold_table(loans)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Aggregate") == 2


def brute_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranked_statistics(spark):
    rows = [((i * 37 % 50) / 50, int((i * 13) % 7 < 2 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "p double, inadimplente int")
    assert E.histogram_auc(df).first().auc == pytest.approx(brute_auc(rows))
    n_pos, n_neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    gaps, best = [], (0.0, None)
    for cut in sorted({p for p, _ in rows}):
        tp = sum(p >= cut and y == 1 for p, y in rows)
        fp = sum(p >= cut and y == 0 for p, y in rows)
        gaps.append(abs(fp / n_neg - tp / n_pos))
        precision, recall = tp / (tp + fp), tp / n_pos
        f1 = 2 * precision * recall / (precision + recall + 1e-10)
        best = max(best, (f1, -cut), key=lambda x: (round(x[0], 12), x[1] or 0))
    assert E.ks_statistic(df).first().ks == pytest.approx(max(gaps))
    assert E.pr_curve_best_f1(df).first().threshold == pytest.approx(-best[1])
    summary = E.evaluation_summary(df).first()
    report = E.classification_report(df).first()
    assert (summary.tp, summary.fp, summary.fn, summary.tn) == (
        report.tp, report.fp, report.fn, report.tn,
    )


def test_single_class(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, inadimplente int")
    assert E.exact_auc(df).first().auc is None
    assert E.pr_curve_best_f1(df).first().threshold == 0.5


def test_exact_auc_tells_close_probabilities_apart(spark):
    rows = [(0.3 + (i * 37 % 61) * 1e-12, int((i * 13) % 7 < 2 + i % 3)) for i in range(300)]
    rows += [(float("nan"), 1), (None, 0), (0.3, None), (2.0, 1), (-1.0, 0), (float("inf"), 0)]
    df = spark.createDataFrame(rows, "p double, inadimplente int")
    known = [(p, y) for p, y in rows if p is not None and y is not None and p == p]
    for parts in (1, 7):
        assert E.exact_auc(df.repartition(parts)).first().auc == pytest.approx(brute_auc(known), abs=1e-14)
    assert abs(E.histogram_auc(df).first().auc - brute_auc(known)) > 0.001
    same = spark.createDataFrame([(0.5, i % 2) for i in range(50)], "p double, inadimplente int")
    assert E.exact_auc(same).first().auc == 0.5
    assert E.exact_auc(same.limit(0)).first().auc is None
