"""Exact duplicates with the frequent texts split off before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm.common import fold_ascii, stored
from crivo.session import ship_package

#: Counters of a Misra-Gries summary; a digest held by more than one row in this many is found.
COUNTERS = 1000


def misra_gries(summary: dict, values: Iterator, counters: int) -> None:
    """Takes the values into the summary; at most `counters` entries stay."""
    for value in values:
        if value in summary:
            summary[value] += 1
        elif len(summary) < counters:
            summary[value] = 1
        else:
            for key in [k for k, n in summary.items() if n == 1]:
                del summary[key]
            for key in summary:
                summary[key] -= 1


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be held by more than a `1 / (counters + 1)` share of the rows.

    Every task keeps one summary. Summaries are merged by adding counts and keeping what exceeds
    the (counters + 1)-th largest, so no digest above the share is lost, and at most `counters`
    rows come out whatever the table's size.
    """
    ship_package(digests.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[bytes, int] = {}
        for batch in batches:
            misra_gries(summary, iter(batch.column(0).to_pylist()), counters)
        yield pa.record_batch(
            {"digest": pa.array(list(summary), pa.binary()), "n": pa.array(list(summary.values()), pa.int64())}
        )

    partial = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    ranked = partial.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest")
    top = ranked.limit(counters + 1).select("digest", "n", F.count("*").over(Window.partitionBy()).alias("kept"), F.min("n").over(Window.partitionBy()).alias("least"))
    return top.filter((F.col("kept") <= counters) | (F.col("n") > F.col("least"))).select("digest")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when identical after folding A-Z; null counts as empty. The row with the
    largest doc_id stays (nulls last); rows that repeat this doc_id are counted in the group but
    only one is `kept`. A group of null doc_ids has a null `keep_id` and keeps one row. An empty
    table gives no rows; other columns are ignored.

    Frequent digests are counted exactly before they count as winners; the winners (at most
    `counters` rows) are broadcast and their documents never shuffled. The rest has no group
    larger than a `1 / counters` share and is shuffled as usual.
    """
    digests = stored(
        docs.select("doc_id", F.unhex(F.sha2(fold_ascii(F.col("text")), 256)).alias("digest")).withColumn(
            # tells rows with one doc_id apart, so that one of them is kept
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row"))
    frequent = F.broadcast(frequent_digests(digests, counters))
    counted = digests.join(frequent, "digest").groupBy("digest").agg(
        F.count("*").alias("size"), last.alias("last")
    )
    total = digests.count()
    winners = stored(counted.filter(F.col("size") * F.lit(counters) > F.lit(total)), "winners")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    rest = marked.filter("last is null").select(
        "digest", "doc_id", "row", F.count("*").over(group).alias("size"), last.over(group).alias("last")
    )
    both = marked.filter("last is not null").select("digest", "doc_id", "row", "size", "last").unionByName(rest)
    return both.select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

