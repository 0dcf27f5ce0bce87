"""Samples, caps, splits and folds decided by a hash of the row's key.

The hash is the head of an MD5 digest as hexadecimal text, so any engine can reproduce a draw and
text order is number order. Exact sizes need the n-th smallest hash of a class. It is found by
counting, not sorting: 65 536 buckets locate it, as many again inside that bucket, and only the
handful of hashes left is ordered; the final cut is a plain row filter, so rows never move to a task
of their class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.session import stored

HASH_DIGITS = 15
BUCKET_DIGITS = 4
LEVELS = 2


def stable_hash(*keys: str, seed: int) -> Column:
    """Fifteen hexadecimal digits from the seed and the key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return F.substring(F.md5(text), 1, HASH_DIGITS)


def share_edge(share: float) -> str:
    """The hash below which a share of all hashes lies."""
    edge = int(share * 16**HASH_DIGITS)
    return f"{edge:0{HASH_DIGITS}x}" if edge < 16**HASH_DIGITS else "g"


def _crossing(counts: DataFrame, need: Column) -> DataFrame:
    """Per class the bucket where the running count reaches the need, and what is left of it."""
    upto = Window.partitionBy("cls").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("upto", F.sum("n").over(upto))
        .withColumn("need", need)
        .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        .select("cls", "b", "n", (F.col("need") - (F.col("upto") - F.col("n"))).alias("left"))
    )


def smallest_hashes(
    df: DataFrame, keys: list[str], seed: int, size: Callable[[Column], Column],
    cls: Column | None = None,
) -> DataFrame:
    """Adds ``chosen``: the row is among the ``size(class rows)`` smallest hashes of its class.

    ``keys`` must identify a row; a key that repeats across the cut is an error. The cut-offs are
    a table of one row per class, joined by class; only the answer to that check reaches the
    driver, so there may be any number of classes.
    """
    tagged = df.withColumns(
        {"__hash": stable_hash(*keys, seed=seed), "__class": F.lit(0) if cls is None else cls}
    )
    edge = tagged.select(F.col("__class").alias("cls"), F.col("__hash").alias("h"))
    need = size(F.sum("n").over(Window.partitionBy("cls")))
    for level in range(LEVELS):
        bucket = F.substring("h", 1 + level * BUCKET_DIGITS, BUCKET_DIGITS)
        counts = edge.groupBy("cls", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        if level:
            counts = counts.join(needed, F.col("cls").eqNullSafe(F.col("of"))).drop("of")
        found = stored(
            _crossing(counts, need).select(F.col("cls").alias("of"), F.col("b").alias("at"), "left"),
            "cuts",
        )
        # One bucket in 65 536 a class: stored, so the table is not read again to look inside it.
        inside = F.col("cls").eqNullSafe(F.col("of")) & (bucket == F.col("at"))
        edge = stored(edge.join(found, inside, "left_semi"), "edge")
        needed, need = found.select("of", F.col("left").alias("need_left")), F.col("need_left")
    # Rows of one hash are counted first, so a repeated key is one number here, not a group.
    counts = edge.groupBy("cls", F.col("h").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(needed, F.col("cls").eqNullSafe(F.col("of"))).drop("of")
    last = stored(_crossing(counts, need), "cuts")
    if not last.filter(F.col("left") != F.col("n")).isEmpty():
        raise ValueError(f"the keys {keys} repeat: an exact size needs one row per key")
    cuts = last.select(F.col("cls").alias("__cut_class"), F.col("b").alias("__cut"))
    chosen = F.coalesce(F.col("__hash") <= F.col("__cut"), F.lit(False))
    return (
        tagged.join(cuts, F.col("__class").eqNullSafe(F.col("__cut_class")), "left")
        .withColumn("chosen", chosen)
        .drop("__hash", "__class", "__cut_class", "__cut")
    )


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Uniform sample of exactly n rows (all rows when the table is smaller)."""
    out = smallest_hashes(df, keys, seed, lambda total: F.least(total, F.lit(n)))
    return out.filter("chosen").drop("chosen")


def stratified_cap(
    df: DataFrame, label: str, keys: list[str], cap: int = 250_000, above: int = 500_000,
    seed: int = 42,
) -> DataFrame:
    """At most ``cap`` rows per class, only when the table has more than ``above`` rows."""
    if df.count() <= above:
        return df
    out = smallest_hashes(
        df, keys, seed, lambda total: F.least(total, F.lit(cap)), F.col(label)
    )
    return out.filter("chosen").drop("chosen")


def stratified_split(
    df: DataFrame, label: str, keys: list[str], test_share: float = 0.2, seed: int = 42,
    exact: bool = False,
) -> DataFrame:
    """Adds ``is_test``.

    The default draws per row (narrow, the label rate holds in expectation). ``exact`` picks
    ``round(share * rows)`` of every class.
    """
    if not exact:
        return df.withColumn("is_test", stable_hash(*keys, seed=seed) < share_edge(test_share))
    out = smallest_hashes(
        df, keys, seed, lambda total: F.round(total * F.lit(test_share)).cast("bigint"),
        F.col(label),
    )
    return out.withColumnRenamed("chosen", "is_test")


def stratified_folds(df: DataFrame, keys: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1, drawn apart from the split of the same seed."""
    h, fold = stable_hash(*keys, seed=seed + 1), F.lit(0)
    for i in range(1, k):
        fold = fold + (h >= share_edge(i / k)).cast("int")
    return df.withColumn("fold", fold)


def union_slices(slices: list[DataFrame]) -> DataFrame:
    """All slices as one table, columns matched by name."""
    out = slices[0]
    for part in slices[1:]:
        out = out.unionByName(part)
    return out
