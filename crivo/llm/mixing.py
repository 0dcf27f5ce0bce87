"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import hash_unit, row_digest, stored, without

#: Largest mean inverted at once; a larger rate is the sum of equal independent draws.
STEP = 16.0
#: Terms of the inverted distribution; at a mean of 16 the rest is under 2e-16.
TERMS = 64
#: Equal rows that one task writes out.
BLOCK = 4096
#: Copies of the table of rates, so that a hot source is joined by as many groups of rows.
SALTS = 64


def tempered_rates(docs: DataFrame, alpha: float = 0.5, total: float | None = None) -> DataFrame:
    """`source`, `rate`: mean repetitions that give source s the share n_s^alpha / sum n^alpha.

    `total` is the size of the mixed set, by default the number of documents. A null source is a
    source of its own.
    """
    counts = stored(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    power = F.pow("n", F.lit(float(alpha)))
    whole = counts.agg(F.sum("n").alias("rows"), F.sum(power).alias("weights")).first()
    size = float(total if total is not None else whole.rows or 0)
    return counts.select("source", (power / F.lit(whole.weights) * size / F.col("n")).alias("rate"))


def weighted_rates(docs: DataFrame, weights: Mapping[str | None, float], total: float | None = None) -> DataFrame:
    """`source`, `rate` for explicit weights; a source without a weight gets rate 0."""
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    spark = docs.sparkSession
    given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "given string, weight double")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    joined = stored(
        counts.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight")),
        "sources",
    )
    whole = joined.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    size = float(total if total is not None else whole.rows or 0)
    rate = F.col("weight") / F.lit(whole.weights or 1.0) * size / F.col("n")
    return joined.select("source", rate.alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k from 0 on, as an array of `TERMS` numbers."""
    first = F.exp(-mean)

    def state(p: Column, every: Column) -> Column:
        return F.named_struct(F.lit("p"), p, F.lit("all"), every)

    def term(now: Column, k: Column) -> Column:
        p = now["p"] * mean / k
        return state(p, F.concat(now["all"], F.array(F.element_at(now["all"], -1) + p)))

    ks = F.sequence(F.lit(1), F.lit(TERMS - 1))
    return F.aggregate(ks, state(first, F.array(first)), term, lambda now: now["all"])


def _numbered(docs: DataFrame, digest: str, number: str) -> DataFrame:
    """The rows with their digest and their number among equal rows, from 0.

    Equal rows are found by counting digests; of those found more than once one row is kept a task
    and a digest, and the rest is written out again from it in blocks over many tasks. So neither
    the counting nor the numbering gathers a group of equal rows.
    """
    marked = docs.withColumn(digest, row_digest(docs.columns))
    counted = marked.groupBy(digest).agg(F.count("*").alias("__llm_times")).filter("__llm_times > 1")
    often = stored(counted, "repeated")
    single = marked.join(often, digest, "left_anti").withColumn(number, F.lit(0).cast("long"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = marked.join(often, digest).groupBy(digest).agg(F.first(whole).alias("__llm_row"), F.first("__llm_times").alias("__llm_times"))
    blocks = kept.withColumn("__llm_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__llm_times - 1) div {BLOCK}"))))
    first = F.col("__llm_block") * BLOCK
    last = F.least(first + BLOCK, F.col("__llm_times")) - 1
    again = (
        blocks.repartition(F.xxhash64(digest, "__llm_block"))
        .withColumn(number, F.explode(F.sequence(first, last)))
        .select(*[F.col("__llm_row")[c].alias(c) for c in docs.columns], digest, number)
    )
    return single.unionByName(again)


def mix_sources(docs: DataFrame, rates: DataFrame, seed: int = 42, copy_column: str | None = "copy", partitions: int | None = None) -> DataFrame:
    """Every document as often as a Poisson draw with its source's mean rate says, shuffled.

    Returns the documents' columns and, if named, the running number of the copy from 0 (a column
    of that name is replaced). A draw inverts the distribution at a number hashed from the seed, the
    whole row and its number among equal rows, so it is the same wherever and whenever the row is
    processed, and rows draw independently whatever their doc_id: null and repeated ids are as good
    as any. A source without a rate, or with a null one, is left out; a null source joins the null
    entry. Null and empty texts are documents, and a text of any length is hashed once and copied
    whole. An empty table gives no rows.

    The rates join on source and salt, so that a source with a third of the rows is not one task's
    work. The copies are dealt to partitions by a hash and ordered within by another: a uniform
    global shuffle without a global sort.
    """
    salt, means, draws, n = "__llm_salt", "__llm_cdf", "__llm_draws", "__llm_copy"
    digest, number = "__llm_digest", "__llm_number"
    base = without(docs, copy_column) if copy_column else docs
    steps = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    inverted = (
        rates.filter("rate > 0")
        .select(
            F.col("source").alias("__llm_source"),
            steps.alias(draws),
            _cumulative(F.col("rate") / steps).alias(means),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__llm_salted"),
        )
    )
    numbered = _numbered(base, digest, number)
    salted = numbered.withColumn(salt, F.pmod(F.xxhash64(digest, number), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("__llm_source")) & (F.col(salt) == F.col("__llm_salted"))
    identity = F.lower(F.hex(digest))

    def one_draw(j: Column) -> Column:
        u = hash_unit(F.lit(str(seed)), identity, F.col(number), j)
        return F.size(F.filter(F.col(means), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda acc, j: acc + one_draw(j))
    drawn = (
        salted.join(inverted, same)
        .withColumn(draws, copies)
        .filter(F.col(draws) > 0)
        .withColumn(n, F.explode(F.sequence(F.lit(0), F.col(draws) - 1)))
        .drop(salt, means, draws, "__llm_source", "__llm_salted")
    )
    key = [F.xxhash64(F.lit(f"{seed}/{turn}"), digest, number, n) for turn in ("deal", "order")]
    dealt = drawn.repartition(partitions, key[0]) if partitions else drawn.repartition(key[0])
    mixed = dealt.sortWithinPartitions(key[1], digest, number, n).drop(digest, number)
    return mixed.withColumnRenamed(n, copy_column) if copy_column else mixed.drop(n)
