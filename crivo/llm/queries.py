"""Registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm.common import read_table
from crivo.llm.decontaminate import with_hits
from crivo.llm.exact import exact_groups
from crivo.llm.licenses import scan_licenses
from crivo.llm.lm import lm_scores
from crivo.llm.merkle import build_manifest, folded, leaf_digest, prove
from crivo.llm.mixing import mix_sources, tempered_rates
from crivo.llm.oracles import ORACLES
from crivo.llm.packing import pack_documents
from crivo.llm.repair import damaged, repair_report
from crivo.llm.sharding import shard_rows
from crivo.llm.simhash import simhash_groups
from crivo.llm.toxicity import THRESHOLD, fit_lexicon, held_out, with_toxicity
from crivo.llm.urls import Rule, filter_urls, fit_url_model
from crivo.llm.warc import archive_folder, read_warc, write_warc

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 40
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Host words the labelled URL table marks as unwanted.
UNWANTED = ("ads", "bets", "casino", "pills", "track")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(read_table(spark, sf_dir, "documents")).drop("places")
    return scanned.withColumn("score", F.round("score", 6))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, tempered_rates(docs))
    return mixed.select("doc_id", "copy", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon = fit_lexicon(docs, read_table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs.select("doc_id", "text"), lexicon, "score")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = with_hits(docs, read_table(spark, sf_dir, "benchmark"), "hits")
    words = F.aggregate("hits.spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    return hit.select(
        "doc_id",
        F.col("hits.n_words").cast("long").alias("n_words"),
        words.cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("hits.items", ","), "UTF-8"), 256).alias("items_sha256"),
        (words > 0).alias("contaminated"),
    )


def op6_lm_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(read_table(spark, sf_dir, "documents"), order=3)
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_score")})


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharded.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    parts = F.split(F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1), "[.-]")
    unwanted = F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED)))
    model = fit_url_model(pages.select("url", unwanted.cast("int").alias("block")))
    return filter_urls(pages, RULES, model)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(read_table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    wrong = leaf_digest("doc_id", "source", "lang", F.col("n_chars") + 1, "text")
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("digest"),
        F.when(tampered, wrong).alias("wrong"),
    )
    manifest = build_manifest(leaves, ["doc_id"])
    proved = prove(manifest).withColumn("claimed", F.coalesce("wrong", "digest"))
    checked = proved.withColumn("folded", folded("claimed"))

    def text(column: str) -> Column:
        return F.lower(F.hex(column))

    return checked.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (text("folded") == F.lit(manifest.root)).alias("verified"),
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair_report(damaged(rows))
    every = rows.select("conv_id").distinct()
    out = every.join(report, every["conv_id"].eqNullSafe(report["conv"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), vocabulary)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_mix": op3_mix,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_order3": op6_lm_order3,
    "op7_shards": op7_shards,
    "op8_urls": op8_urls,
    "op9_warc": op9_warc,
    "op10_exact": op10_exact,
    "op11_merkle": op11_merkle,
    "op12_repair": op12_repair,
    "op13_pack": op13_pack,
    "pipeline": pipeline,
}
