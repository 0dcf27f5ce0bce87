"""The corpus pipeline: five stages from raw documents to shards of a training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crivo.llm.common import read_table, stored
from crivo.llm.decontaminate import decontaminate
from crivo.llm.mixing import mix_sources, tempered_rates
from crivo.llm.sharding import shard_rows
from crivo.llm.simhash import simhash_keep
from crivo.llm.toxicity import THRESHOLD, fit_lexicon, with_toxicity

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a score from the threshold on go."""
    lexicon = fit_lexicon(docs, read_table(spark, sf_dir, "labels"))
    score = "__llm_score"
    return with_toxicity(docs, lexicon, score).filter(f"{score} < {THRESHOLD}").drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies the document with the smallest doc_id stays."""
    return simhash_keep(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources get weights in proportion to the root of their size."""
    return mix_sources(docs, tempered_rates(docs), copy_column=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a uniform shuffle into shards whose row counts differ by one at most."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned weights, fingerprints and random draws have no SQL twin; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
