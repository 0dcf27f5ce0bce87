"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm.common import without
from crivo.session import ship_package

#: Rows of a source partition and of a block of a shard, the unit of the second permutation.
SOURCE_ROWS, BLOCK_ROWS = 20_000, 50_000
#: Most source partitions and blocks. Beyond, they grow in rows instead (their sorts spill), so that
#: the matrix has a bounded size and does not grow with the square of the table.
MOST_PARTS, MOST_BLOCKS = 8192, 8192
#: Population from which numpy makes no hypergeometric draws, and the deviations inverted there.
NUMPY_BOUND, DEVIATIONS = 10**9, 14
#: Running number among rows with one doc_id and text, so that copies do not stay together.
AGAIN = "__llm_again"


def block_sizes(total: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, int]:
    """Rows of every block, shard by shard, and blocks per shard.

    Shard counts differ by one at most, and so do the blocks of a shard.
    """
    per = max(1, min(-(-total // (shards * block_rows)), MOST_BLOCKS // shards))
    sizes = total // shards + (np.arange(shards) < total % shards)
    blocks = sizes[:, None] // per + (np.arange(per)[None, :] < (sizes % per)[:, None])
    return blocks.ravel(), per


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of `taken` from `good + bad` are good; large populations invert the distribution.

    Ratios of neighbouring probabilities are summed in logs over the values within `DEVIATIONS`
    standard deviations of the mean; what lies outside is below the precision of the sum.
    """
    every = good + bad
    if every < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, taken))
    mean = taken / every * good
    wide = DEVIATIONS * (mean * (bad / every) * ((every - taken) / max(1, every - 1))) ** 0.5 + DEVIATIONS
    low, high = max(0, taken - bad, int(mean - wide)), min(taken, good, int(mean + wide) + 1)
    k = np.arange(low, high)
    ratio = np.log(good - k) + np.log(taken - k) - np.log(k + 1) - np.log(bad - taken + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw_columns(rng: np.random.Generator, left: np.ndarray, taken: int) -> np.ndarray:
    """How many of `taken` rows fall to each column, of which `left` rows are to be filled."""
    every = int(left.sum())
    if every < NUMPY_BOUND:
        return rng.multivariate_hypergeometric(left, taken, method="marginals")
    out = np.zeros_like(left)
    for j, good in enumerate(left.tolist()):
        if not taken:
            break
        out[j] = hypergeometric(rng, good, every - good, taken)
        every, taken = every - good, taken - int(out[j])
    return out


def matrix_row(sizes: np.ndarray, counts: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of a random matrix with row sums `counts` and column sums `sizes`.

    Entries are how many rows a uniform shuffle sends from each partition to each block. Halves of
    the partitions are drawn against each other, down to the one wanted: a draw depends only on its
    place, so every task finds its own row from the counts, and a repeated task finds it again.
    """
    low, high, left = 0, len(counts), sizes.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        taken = int(counts[low:middle].sum())
        drawn = draw_columns(np.random.default_rng([seed, low, high]), left, taken)
        if part < middle:
            high, left = middle, drawn
        else:
            low, left = middle, left - drawn
    return left


def _identity(seed: int, turn: int) -> list[Column]:
    """Random order of rows that depends on their values and, for repeated rows, their number."""
    return [F.xxhash64(F.lit(f"{seed}/{turn}"), "doc_id", "text", AGAIN), F.col("doc_id"), F.col(AGAIN)]


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 42, source_rows: int = SOURCE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents with their own columns, `shard` (int) and `slot` (long, gapless from 0).

    Shard counts are at most one apart; with fewer rows than shards the last shards are empty, and
    an empty table gives no rows. Nulls and repeated rows are dealt like all others. Columns named
    `shard` or `slot` are replaced.

    Rows are permuted within source partitions, exchanged by the drawn counts, and permuted again
    within blocks. A source partition is a hash of the row's values, so its rows and their order are
    the same whenever a task is repeated; a third of all rows under one doc_id still spreads by
    their texts. The driver holds one count a partition and one size a block.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = without(docs, "shard", "slot")
    total = base.count()
    parts = max(8, min(-(-total // source_rows), MOST_PARTS))
    source, rank, target, offset = "__llm_part", "__llm_rank", "__llm_block", "__llm_offset"
    placed = base.withColumn(source, F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(parts)).cast("int"))
    held = {r[0]: r[1] for r in placed.groupBy(source).count().collect()}
    counts = np.array([held.get(k, 0) for k in range(parts)], dtype=np.int64)
    sizes, per = block_sizes(total, shards, block_rows)
    known = spark.sparkContext.broadcast((sizes, counts))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, counts = known.value
        for batch in batches:
            drawn = [matrix_row(sizes, counts, k, seed) for k in batch.column(0).to_pylist()]
            ends = [np.cumsum(row).reshape(shards, per).tolist() for row in drawn]
            yield pa.record_batch({source: batch.column(0), "ends": pa.array(ends, pa.list_(pa.list_(pa.int64())))})

    matrix = spark.range(parts).select(F.col("id").cast("int").alias(source)).mapInArrow(
        rows_of, f"{source} int, ends array<array<long>>"
    ).repartitionById(parts, F.col(source))
    repeated = Window.partitionBy(source, "doc_id", F.xxhash64("text")).orderBy("doc_id")
    # one exchange by partition serves both windows; a task is one partition, as hashing it again
    # would put several into one task and leave others idle
    ranked = placed.repartitionById(parts, F.col(source)).withColumn(AGAIN, F.row_number().over(repeated)).withColumn(
        rank, F.row_number().over(Window.partitionBy(source).orderBy(*_identity(seed, 1))) - 1
    )
    passed = lambda ends: F.size(F.filter(ends, lambda e: e <= F.col(rank)))
    shard = F.size(F.filter("ends", lambda row: F.element_at(row, -1) <= F.col(rank)))
    dealt = (
        ranked.join(matrix, source)
        .withColumn("shard", shard)
        .withColumn(target, passed(F.element_at("ends", F.col("shard") + 1)))
        .drop("ends", rank, source)
    )
    # the rows of the shard's earlier blocks: as many blocks of one size come first as the remainder
    in_shard = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    before = F.col(target) * F.floor(in_shard / per) + F.least(F.col(target), in_shard % per)
    block = Window.partitionBy(target).orderBy(*_identity(seed, 2))
    return (
        dealt.withColumn(offset, before)
        .withColumn(target, F.col("shard") * per + F.col(target))
        .repartitionById(shards * per, F.col(target))
        .withColumn("slot", (F.col(offset) + F.row_number().over(block) - 1).cast("long"))
        .drop(target, offset, AGAIN)
    )
