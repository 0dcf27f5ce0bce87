"""Approval-threshold analytics over a loan portfolio.

Every operator reads (score, ticket, label) once. Rows are first reduced to one row per interval
between thresholds, so whatever the table size, the grid work runs on at most
``len(grid) + 2`` rows, the map side combines before the only data-sized shuffle, and a score
that holds a third of the table is still one partial sum per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import drop_nan
from crivo.functions.features import score_norm

MONEY = "decimal(18,2)"
METRIC_COLUMNS = (
    "saldoLiquido", "taxaAprovacao", "taxaInadimplencia", "totalClientes", "clientesAprovados",
    "clientesRejeitados", "receitaTotal", "perdasInadimplencia", "oportunidadesPerdidas",
    "perdasEvitadas", "valorMedio", "threshold",
)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 on a zero denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _money(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast(MONEY)).cast("double")


def _norm(score: str) -> Column:
    return score_norm(drop_nan(F.col(score)))


def grid_position(x: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending grid are ``<= x``, by bisection; -1 for NULL."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x >= F.lit(grid[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return F.when(x.isNull(), -1).otherwise(search(0, len(grid)))


def interval_totals(
    df: DataFrame, grid: Sequence[float], score: str = "score", ticket: str = "ticket",
    label: str = "inadimplente",
) -> DataFrame:
    """Counts and money per grid interval, plus one zero row so an empty table still reports.

    The normalised score is a column of its own, so the bisection compares a value, not a formula.
    """
    rows = df.select(
        _norm(score).alias("norm"), F.col(ticket).try_cast(MONEY).alias("money"),
        F.col(label).alias("label"),
    )
    money, bad, good = F.col("money"), F.col("label") == 1, F.col("label") == 0
    totals = rows.groupBy(grid_position(F.col("norm"), grid).alias("position")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(good).alias("n_good"),
        F.count(money).alias("n_money"),
        F.sum(money).cast("decimal(38,2)").alias("money"),
        F.sum(F.when(bad, money)).cast("decimal(38,2)").alias("money_bad"),
        F.sum(F.when(good, money)).cast("decimal(38,2)").alias("money_good"),
    )
    zero = F.lit(0).cast("bigint")
    none = F.lit(0).cast("decimal(38,2)")
    empty = df.sparkSession.range(1).select(
        F.lit(-1).alias("position"), zero.alias("n"), zero.alias("n_bad"), zero.alias("n_good"),
        zero.alias("n_money"), none.alias("money"), none.alias("money_bad"),
        none.alias("money_good"),
    )
    return totals.unionByName(empty)


def _per_threshold(totals: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Each interval row once per threshold (bounded by the squared grid size)."""
    points = F.array(
        *(F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid))
    )
    return totals.withColumn("point", F.explode(points)).select(
        "*", F.col("point.i").alias("i"), F.col("point.threshold").alias("threshold")
    )


def _metric_columns(threshold: Column) -> list[Column]:
    """The twelve metrics, from the raw sums of ``_sums``."""
    total, approved = F.col("total"), F.col("approved")
    revenue, losses = F.col("revenue"), F.col("losses")
    return [
        (revenue - losses).alias("saldoLiquido"),
        F.round(safe_ratio(approved, total) * 100, 1).alias("taxaAprovacao"),
        F.round(safe_ratio(F.col("approved_bad"), approved) * 100, 1).alias("taxaInadimplencia"),
        total.alias("totalClientes"),
        approved.alias("clientesAprovados"),
        (total - approved).alias("clientesRejeitados"),
        revenue.alias("receitaTotal"),
        losses.alias("perdasInadimplencia"),
        F.col("missed").alias("oportunidadesPerdidas"),
        F.col("avoided").alias("perdasEvitadas"),
        safe_ratio(F.col("money_all"), F.col("n_money_all")).alias("valorMedio"),
        threshold.alias("threshold"),
    ]


def threshold_metrics(
    df: DataFrame, threshold: float = 0.5, score: str = "score", ticket: str = "ticket",
    label: str = "inadimplente",
) -> DataFrame:
    """One row of approval, default and money metrics at a threshold, in one conditional pass.

    A NULL or NaN score is rejected. An empty table gives zeros and the requested threshold.
    """
    money, bad, good = F.col(ticket).try_cast(MONEY), F.col(label) == 1, F.col(label) == 0
    passed = F.coalesce(_norm(score) >= F.lit(float(threshold)), F.lit(False))
    sums = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("approved"),
        F.count_if(passed & bad).alias("approved_bad"),
        _money(F.sum(F.when(passed, money))).alias("revenue"),
        _money(F.sum(F.when(passed & bad, money))).alias("losses"),
        _money(F.sum(F.when(~passed & good, money))).alias("missed"),
        _money(F.sum(F.when(~passed & bad, money))).alias("avoided"),
        _money(F.sum(money)).alias("money_all"),
        F.count(money).alias("n_money_all"),
    )
    return sums.select(*_metric_columns(F.lit(float(threshold))))


def threshold_table(
    df: DataFrame, grid: Sequence[float] = K.SENSITIVITY_GRID, score: str = "score",
    ticket: str = "ticket", label: str = "inadimplente",
) -> DataFrame:
    """``threshold_metrics`` at every grid point from one pass over the table."""
    passed = F.col("position") > F.col("i")
    sums = (
        _per_threshold(interval_totals(df, grid, score, ticket, label), grid)
        .groupBy("i", "threshold")
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("approved"),
            F.sum(F.when(passed, F.col("n_bad")).otherwise(0)).alias("approved_bad"),
            _money(F.sum(F.when(passed, F.col("money")))).alias("revenue"),
            _money(F.sum(F.when(passed, F.col("money_bad")))).alias("losses"),
            _money(F.sum(F.when(~passed, F.col("money_good")))).alias("missed"),
            _money(F.sum(F.when(~passed, F.col("money_bad")))).alias("avoided"),
            _money(F.sum("money")).alias("money_all"),
            F.sum("n_money").alias("n_money_all"),
        )
    )
    return sums.select(*_metric_columns(F.col("threshold")))


def threshold_sensitivity(df: DataFrame, **columns: str) -> DataFrame:
    """Six columns at the nine standard thresholds."""
    return threshold_table(df, **columns).select(
        F.round("threshold", 2).alias("threshold"), "taxaAprovacao", "taxaInadimplencia",
        "saldoLiquido", "perdasEvitadas", "oportunidadesPerdidas",
    )


def objective_value(objective: str) -> Column:
    if objective == "risk":
        return -F.col("taxaInadimplencia")
    if objective == "balanced":
        return F.col("taxaAprovacao") - F.col("taxaInadimplencia") * 10
    return F.col("saldoLiquido")


def threshold_candidates(df: DataFrame, objective: str = "profit", **columns: str) -> DataFrame:
    """All nine thresholds with their objective value."""
    return threshold_table(df, **columns).withColumn("value", objective_value(objective))


def optimize_threshold(df: DataFrame, objective: str = "profit", **columns: str) -> DataFrame:
    """Best threshold for an objective with its metrics; the lowest threshold wins ties."""
    best = (
        threshold_candidates(df, objective, **columns)
        .orderBy(F.desc("value"), "threshold")
        .limit(1)
    )
    return best.select(
        F.round("threshold", 2).alias("optimal_threshold"),
        F.lit(objective).alias("objective"),
        F.col("value").alias("best_value"),
        *METRIC_COLUMNS,
    )


def confusion_matrix(
    df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "inadimplente"
) -> DataFrame:
    """Positive means default, predicted positive means rejected; rates in percent."""
    bad, good = F.col(label) == 1, F.col(label) == 0
    passed = F.coalesce(_norm(score) >= F.lit(float(threshold)), F.lit(False))
    counts = df.agg(
        F.count_if(~passed & bad).alias("tp"),
        F.count_if(~passed & good).alias("fp"),
        F.count_if(passed & good).alias("tn"),
        F.count_if(passed & bad).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * (precision * recall), precision + recall)
    return counts.select(
        "tp", "fp", "tn", "fn",
        F.round(safe_ratio(tp + tn, tp + fp + tn + fn) * 100, 2).alias("accuracy"),
        F.round(precision * 100, 2).alias("precision"),
        F.round(recall * 100, 2).alias("recall"),
        F.round(f1 * 100, 2).alias("f1_score"),
        F.lit(float(threshold)).alias("threshold"),
    )


def roc_curve(
    df: DataFrame, grid: Sequence[float] = K.ROC_GRID, score: str = "score",
    label: str = "inadimplente",
) -> DataFrame:
    """(threshold, fpr, tpr) with rejection as the positive call.

    A missing score is rejected at no threshold but stays in the denominators.
    """
    bad, good = F.col("label") == 1, F.col("label") == 0
    rows = df.select(_norm(score).alias("norm"), F.col(label).alias("label"))
    totals = rows.groupBy(grid_position(F.col("norm"), grid).alias("position")).agg(
        F.count_if(bad).alias("n_bad"), F.count_if(good).alias("n_good")
    )
    zero = F.lit(0).cast("bigint")
    totals = totals.unionByName(
        df.sparkSession.range(1).select(
            F.lit(-1).alias("position"), zero.alias("n_bad"), zero.alias("n_good")
        )
    )
    rejected = (F.col("position") >= 0) & (F.col("position") <= F.col("i"))
    return (
        _per_threshold(totals, grid)
        .groupBy("i", "threshold")
        .agg(
            F.sum(F.when(rejected, F.col("n_bad")).otherwise(0)).alias("tp"),
            F.sum(F.when(rejected, F.col("n_good")).otherwise(0)).alias("fp"),
            F.sum("n_bad").alias("n_bad"),
            F.sum("n_good").alias("n_good"),
        )
        .select(
            "threshold",
            safe_ratio(F.col("fp"), F.col("n_good")).alias("fpr"),
            safe_ratio(F.col("tp"), F.col("n_bad")).alias("tpr"),
        )
    )


def roc_auc_grid(roc: DataFrame) -> DataFrame:
    """Area under the grid points by trapezoids (the window sees one row per grid point)."""
    order = Window.orderBy("threshold")
    width = F.col("fpr") - F.lag("fpr").over(order)
    height = (F.col("tpr") + F.lag("tpr").over(order)) / 2
    return roc.select((width * height).alias("area")).agg(
        F.abs(F.coalesce(F.sum("area"), F.lit(0.0))).alias("auc")
    )


def score_distribution(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows per score; missing scores are left out."""
    return (
        df.select(drop_nan(F.col(score)).alias("score"))
        .filter(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def approval_split(df: DataFrame, threshold: float = 0.5, **columns: str) -> DataFrame:
    """Approved and rejected shares, progress towards the goals, default-rate tag."""
    m = threshold_metrics(df, threshold, **columns)
    total, rate = F.col("totalClientes"), F.col("taxaInadimplencia")
    return m.select(
        F.col("clientesAprovados").alias("aprovados"),
        F.col("clientesRejeitados").alias("rejeitados"),
        F.round(safe_ratio(F.col("clientesAprovados"), total) * 100, 1).alias("pct_aprovados"),
        F.round(safe_ratio(F.col("clientesRejeitados"), total) * 100, 1).alias("pct_rejeitados"),
        F.least(F.col("taxaAprovacao"), F.lit(100.0)).alias("meta_aprovacao"),
        F.greatest(F.lit(0.0), 100 - rate * 10).alias("meta_inadimplencia"),
        F.when(rate < 3, "Baixo").otherwise("Alto").alias("faixa_inadimplencia"),
    )
