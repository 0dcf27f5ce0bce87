"""Label encoding and the model's feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import lookup
from crivo.functions.features import default_code, strip_accents, with_features
from crivo.operators.quantiles import exact_quantiles
from crivo.session import reliable_checkpoint, stored


def _distinct_values(df: DataFrame, columns: Sequence[str], fold: bool) -> DataFrame:
    def text(name: str) -> Column:
        value = F.col(name).cast("string")
        return strip_accents(value) if fold else value

    cells = F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns))
    return (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def position_in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``position``, the row's rank in a global order, without a one-task sort.

    Rows are range partitioned and sorted in place; the offset of a partition is the row count of
    the partitions before it. The sorted rows are checkpointed, so both reads see one layout.
    """
    spread = df.sparkSession.sparkContext.defaultParallelism * 4
    placed = reliable_checkpoint(
        df.repartitionByRange(spread, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One offset row per partition of ``spread``: the broadcast cannot grow with the data.
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("position", F.col("offset") + inside)
        .drop("part", "offset", "place")
    )


def fit_label_encoder(
    df: DataFrame, columns: Sequence[str], fold: bool = False
) -> DataFrame:
    """(column, value, code): the code is the rank of the value among the column's sorted values.

    ``fold`` strips accents before fitting. Distinct values are ranked by range partitions and
    written once, so later joins know the encoder's size.
    """
    ranked = position_in_order(_distinct_values(df, columns, fold), ("column", "value"))
    first = ranked.groupBy("column").agg(F.min("position").alias("first"))
    # One row per encoded column.
    return stored(
        ranked.join(F.broadcast(first), "column").select(
            "column", "value", (F.col("position") - F.col("first")).cast("int").alias("code")
        ),
        "encoder",
    )


def encode_labels(
    df: DataFrame, encoder: DataFrame, columns: Sequence[str], fold: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Adds ``<column>_encoded``; unknown and NULL values give 0.

    The encoder is joined per column on (column, value), and the planner sizes the join. For an
    encoder known to be small, ``literal`` reads it once into a lookup inside the projection.
    """

    def text(name: str) -> Column:
        value = F.col(name).cast("string")
        return strip_accents(value) if fold else value

    if literal:
        codes: dict[str, dict[str, int]] = {c: {} for c in columns}
        for row in encoder.filter(F.col("column").isin(list(columns))).collect():
            codes[row["column"]][row["value"]] = row["code"]
        return df.withColumns(
            {
                f"{c}_encoded": F.coalesce(lookup(text(c), codes[c]), F.lit(0))
                if codes[c]
                else F.lit(0)
                for c in columns
            }
        )
    out = df
    for c in columns:
        part = encoder.filter(F.col("column") == c).select(
            F.col("value").alias(f"{c}_value"), F.col("code").alias(f"{c}_code")
        )
        out = (
            out.join(part, text(c) == F.col(f"{c}_value"), "left")
            .withColumn(f"{c}_encoded", F.coalesce(f"{c}_code", F.lit(0)))
            .drop(f"{c}_value", f"{c}_code")
        )
    return out


def feature_table(
    df: DataFrame, keep: Sequence[str] = (), encoder: DataFrame | None = None,
    compat_unknown_zero: bool = False,
) -> DataFrame:
    """The 21 model inputs in contract order, missing values as 0, plus the columns to keep.

    Without an encoder the default codes apply. Accents are stripped on both sides, unless
    ``compat_unknown_zero`` asks for the serving quirk that strips them on the value only.
    """
    rows = with_features(df)
    if encoder is None:
        rows = rows.withColumns(
            {f"{c}_encoded": default_code(c, c, not compat_unknown_zero) for c in K.ENCODED_COLUMNS}
        )
    else:
        rows = encode_labels(rows, encoder, K.ENCODED_COLUMNS, fold=True)
    return rows.select(*keep, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                for c in K.FEATURE_ORDER))


def impute_score_median(df: DataFrame, score: str = "score") -> DataFrame:
    """Missing scores become the median; all are rounded half-even and clipped to 300-950."""
    known = F.when(~F.isnan(score), F.col(score)).cast("double")
    middle = exact_quantiles(df, [score], [0.5]).agg(F.max("value")).scalar()
    bounded = F.least(
        F.greatest(F.bround(F.coalesce(known, middle), 0), F.lit(K.SCORE_MIN)), F.lit(K.SCORE_MAX)
    )
    return df.withColumn(score, bounded.cast("int"))
