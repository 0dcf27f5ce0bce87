"""Portfolio, batch and prediction-log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.operators.quantiles import exact_quantiles
from crivo.operators.thresholds import MONEY, safe_ratio


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def profile(df: DataFrame) -> DataFrame:
    """Describe every numeric column: one row per column, quartiles interpolated and exact."""
    names, quarters = numeric_columns(df), (0.25, 0.5, 0.75)
    stats = []
    for name in names:
        x = F.col(name).cast("double")
        parts = [
            F.lit(name).alias("column"),
            F.count(x).alias("n"),
            F.count_if(x.isNull()).alias("n_null"),
            F.round(F.avg(x), 6).alias("mean"),
            F.round(F.stddev_samp(x), 6).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]
        stats.append(F.struct(*parts).alias(name))
    rows = df.agg(*stats).select(F.inline(F.array(*(F.col(n) for n in names))))
    found = exact_quantiles(df, names, quarters).groupBy("column").agg(
        F.array(
            *(F.max(F.when(F.col("prob") == q, F.col("value"))) for q in quarters)
        ).alias("cuts")
    )
    rows = rows.join(found, "column", "left")
    return rows.select(
        "column", "n", "n_null", "mean", "std", "min",
        *(F.round(F.col("cuts")[i], 6).alias(f"q{25 * (i + 1)}") for i in range(3)),
        "max",
    )


def profile_text(df: DataFrame) -> DataFrame:
    """Describe every text column: count, NULLs, distinct values, most frequent value."""
    names = text_columns(df)
    pairs = F.explode(
        F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names))
    )
    values = df.select(pairs.alias("cell")).groupBy("cell.column", "cell.value").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = F.col("value").isNotNull()
    return values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(known, F.col("n"))).alias("freq"),
    )


def label_counts(df: DataFrame, label: str = "inadimplente") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def amount_summary(
    df: DataFrame, label: str = "inadimplente", amount: str = "ticket"
) -> DataFrame:
    """Label sum and rate, amount mean, sum, minimum and maximum."""
    money = F.col(amount).try_cast(MONEY)
    total = F.sum(money).cast("double")
    return df.agg(
        F.sum(label).alias("label_sum"),
        F.round(F.avg(label) * 100, 2).alias("label_rate"),
        F.round(F.try_divide(total, F.count(money)), 6).alias("amount_mean"),
        total.alias("amount_sum"),
        F.min(amount).alias("amount_min"),
        F.max(amount).alias("amount_max"),
    )


def segment_default_rates(
    df: DataFrame, score: str = "score", commitment: str = "perc_comprometimento_renda",
    label: str = "inadimplente",
) -> DataFrame:
    """Default rate in percent where the rules of the generator should bite."""
    s, c, y = F.col(score), F.col(commitment), F.col(label)

    def rate(cond, name):
        return (F.avg(F.when(cond, y)) * 100).alias(name)

    return df.agg(
        rate(s < 400, "score_below_400"),
        rate(s > 850, "score_above_850"),
        rate(c > 50, "commitment_above_50"),
        rate(c < 20, "commitment_below_20"),
    )


def portfolio_summary(
    df: DataFrame, score: str = "score", income: str = "renda", ticket: str = "ticket",
    loss: str = "perda_esperada", label: str = "inadimplente",
) -> DataFrame:
    money = F.sum(F.col(ticket).try_cast(MONEY)).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(label) * 100).alias("default_rate"),
        F.avg(score).alias("score_mean"),
        F.avg(income).alias("income_mean"),
        F.try_divide(money, F.count(ticket)).alias("ticket_mean"),
        money.alias("ticket_total"),
        F.sum(F.col(loss).cast("decimal(28,8)")).cast("double").alias("expected_loss_total"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counters of a batch result: approvals, denials, mean risk in percent, avoided loss."""
    decision, n = F.col("decisao"), F.count(F.lit(1))
    approved, denied = F.count_if(decision == "Aprovar"), F.count_if(decision == "Negar")
    risk = F.col("probabilidade_inadimplencia") * 100
    return results.agg(
        n.alias("total"),
        approved.alias("aprovados"),
        denied.alias("negados"),
        F.round(safe_ratio(approved, n) * 100, 1).alias("pct_aprovados"),
        F.round(safe_ratio(denied, n) * 100, 1).alias("pct_negados"),
        F.round(F.avg(risk), 1).alias("risco_medio"),
        F.coalesce(F.sum(F.col("perda_evitada").cast("decimal(28,8)")).cast("double"), F.lit(0.0))
        .alias("perda_evitada_total"),
    )


def batch_counters(df: DataFrame, batch_key: str, ok: str = "ok") -> DataFrame:
    """Rows, successes and failures per batch."""
    return df.groupBy(batch_key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(ok)).alias("success"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"),
    )


def prediction_log_rollup(df: DataFrame) -> DataFrame:
    """Per model version: predictions, approval rate, mean risk score, mean milliseconds."""
    return df.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(F.when(F.col("recommendation") == "Aprovar", 1.0).otherwise(0.0)).alias(
            "approval_rate"
        ),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("processing_ms").alias("avg_processing_time"),
    )
