"""Quality of a probability against a 0/1 label.

Ranked statistics run on a histogram of the probability rounded to six digits. It holds at most
1 000 001 rows however large the table is, so the ordered window over it is bounded; the rows
themselves are reduced by a partial aggregation and never sorted. `exact_auc` ranks the
probabilities as they are, over as many sorted ranges as they fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.operators.thresholds import safe_ratio
from crivo.session import stored

STEPS = 1_000_000


def probability_histogram(
    df: DataFrame, p: str = "p", y: str = "inadimplente", threshold: float = 0.5
) -> DataFrame:
    """Positives and negatives per rounded probability, split by the call at ``threshold``."""
    prob, pos, neg = F.col(p), F.col(y) == 1, F.col(y) == 0
    called = prob >= F.lit(float(threshold))
    return (
        df.filter(prob.isNotNull() & F.col(y).isNotNull() & ~F.isnan(prob))
        .groupBy(F.floor(prob * STEPS + 0.5).alias("step"))
        .agg(
            F.count_if(pos).alias("pos"),
            F.count_if(neg).alias("neg"),
            F.count_if(pos & called).alias("tp"),
            F.count_if(neg & called).alias("fp"),
        )
        .select((F.col("step") / STEPS).alias("p"), "pos", "neg", "tp", "fp")
    )


def cumulative_shares(histogram: DataFrame) -> DataFrame:
    """Running counts from the highest probability down, with the grand totals."""
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("p")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return histogram.select(
        "*",
        F.sum("pos").over(down).alias("cum_pos"),
        F.sum("neg").over(down).alias("cum_neg"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    )


def _auc() -> Column:
    """Share of (positive, negative) pairs ranked right; a tie counts half."""
    above = F.col("cum_pos") - F.col("pos")
    pairs = F.col("neg") * (above + F.col("pos") / 2).cast("double")
    everything = F.max("all_pos").cast("double") * F.max("all_neg")
    return F.sum(pairs) / F.nullif(everything, F.lit(0.0))


def _gap() -> Column:
    return F.abs(
        safe_ratio(F.col("cum_neg"), F.col("all_neg"))
        - safe_ratio(F.col("cum_pos"), F.col("all_pos"))
    )


def _f1() -> Column:
    """F1 of calling positive everything from this probability up."""
    precision = safe_ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    recall = safe_ratio(F.col("cum_pos"), F.col("all_pos"))
    return 2 * (precision * recall) / (precision + recall + 1e-10)


def histogram_auc(df: DataFrame, p: str = "p", y: str = "inadimplente") -> DataFrame:
    """AUC of the probability rounded to six digits."""
    return cumulative_shares(probability_histogram(df, p, y)).agg(_auc().alias("auc"))


def exact_auc(df: DataFrame, p: str = "p", y: str = "inadimplente") -> DataFrame:
    """AUC of the probability as it is: pairs are counted in whole numbers, ties count half.

    Rows are summed by probability, the sums ranged by it; a range hands over its positives, so a
    probability knows the positives above it from the ranges above and its own range. Equal
    probabilities are one row and lie in one range. Missing values and NaN are left out; without
    both classes the result is null.
    """
    prob = F.col(p).cast("double")
    known = prob.isNotNull() & F.col(y).isNotNull() & ~F.isnan(prob)
    groups = df.filter(known).groupBy(prob.alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    ranged = groups.repartitionByRange(F.desc("p")).sortWithinPartitions(F.desc("p"))
    rows = stored(ranged.withColumn("part", F.spark_partition_id()), "auc-ranges")
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = rows.groupBy("part").agg(F.sum("pos").alias("own"), F.sum("neg").alias("negatives")).select(
        F.col("part").alias("of"), F.coalesce(F.sum("own").over(above), F.lit(0)).alias("before"), "own", "negatives"
    )
    inside = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    higher = F.col("before") + F.coalesce(F.sum("pos").over(inside), F.lit(0))
    whole = F.lit(2) * higher + F.col("pos")
    pairs = rows.join(parts, F.col("part") == F.col("of")).select(
        (F.col("neg").cast("decimal(18,0)") * whole.cast("decimal(19,0)")).alias("pairs")
    ).agg(F.sum("pairs").alias("pairs"))
    totals = parts.agg(F.sum("own").alias("pos"), F.sum("negatives").alias("neg"))
    everything = F.col("pos").cast("double") * F.col("neg") * 2
    return pairs.join(totals, F.lit(True)).select(
        (F.col("pairs").cast("double") / F.nullif(everything, F.lit(0.0))).alias("auc")
    )


def ks_statistic(df: DataFrame, p: str = "p", y: str = "inadimplente") -> DataFrame:
    """Largest gap between the cumulative good and bad shares; equal probabilities are one step."""
    return cumulative_shares(probability_histogram(df, p, y)).agg(F.max(_gap()).alias("ks"))


def pr_curve_best_f1(df: DataFrame, p: str = "p", y: str = "inadimplente") -> DataFrame:
    """Cut with the best F1, the lowest one on ties; 0.5 when there are no positives."""
    curve = cumulative_shares(probability_histogram(df, p, y)).select(
        "p", "all_pos", F.round(_f1(), 12).alias("f1")
    )
    return curve.agg(F.max(F.struct(F.col("f1"), (-F.col("p")).alias("minus_p"), "all_pos")).alias(
        "best"
    )).select(
        F.when(F.col("best.all_pos") > 0, -F.col("best.minus_p")).otherwise(0.5).alias("threshold"),
        F.coalesce("best.f1", F.lit(0.0)).alias("f1"),
    )


def classification_report(
    df: DataFrame, p: str = "p", y: str = "inadimplente", threshold: float = 0.5
) -> DataFrame:
    """Counts and precision, recall, F1 of ``p >= threshold``; rows with a missing or NaN ``p`` or label are left out."""
    called, pos = F.col(p) >= F.lit(float(threshold)), F.col(y) == 1
    known = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(y).isNotNull()
    counts = df.filter(known).agg(
        F.count_if(~called & ~pos).alias("tn"),
        F.count_if(called & ~pos).alias("fp"),
        F.count_if(~called & pos).alias("fn"),
        F.count_if(called & pos).alias("tp"),
    )
    return counts.select("tn", "fp", "fn", "tp", *report_rates())


def report_rates() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
    ]


def class_weight(df: DataFrame, y: str = "inadimplente") -> DataFrame:
    """Negatives per positive."""
    return df.agg(
        (F.count_if(F.col(y) == 0) / F.nullif(F.count_if(F.col(y) == 1), F.lit(0))).alias(
            "class_weight"
        )
    )


def evaluation_summary(
    df: DataFrame, p: str = "p", y: str = "inadimplente", threshold: float = 0.5
) -> DataFrame:
    """AUC, KS, best-F1 cut and the report at ``threshold`` in one pass over the rows."""
    best = F.max(F.struct(F.round(_f1(), 12).alias("f1"), (-F.col("p")).alias("minus_p")))
    totals = cumulative_shares(probability_histogram(df, p, y, threshold)).agg(
        _auc().alias("auc"),
        F.max(_gap()).alias("ks"),
        best.alias("best"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        (F.sum("pos") - F.sum("tp")).alias("fn"),
        (F.sum("neg") - F.sum("fp")).alias("tn"),
    )
    return totals.select(
        F.round("auc", 8).alias("auc"),
        F.round("ks", 8).alias("ks"),
        F.when(F.col("tp") + F.col("fn") > 0, -F.col("best.minus_p")).otherwise(0.5).alias(
            "best_threshold"
        ),
        F.col("best.f1").alias("best_f1"),
        "tn", "fp", "fn", "tp",
        *(F.round(c, 8).alias(n) for c, n in zip(report_rates(), ("precision", "recall", "f1"))),
    )


def feature_importance_top(model, features: list[str], k: int, spark) -> DataFrame:
    """The k features a tree model leans on most (one row per model input, not per data row)."""
    weights = model.featureImportances.toArray().tolist()
    rows = list(zip(features, weights))
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(k)
    )
