"""Benchmark decontamination: training text that holds windows of benchmark items."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import SEPARATORS, WORD_BYTES, raw_texts, split_words, without, words_of
from crivo.session import drop_stored, ship_package, stored

WINDOW = 10
SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32())])
#: Windows collected and broadcast at a time (some 0.1 GB in a worker); a larger benchmark is scanned in
#: blocks of this size.
BLOCK_WINDOWS = 1 << 18


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`words` (array) and `item_id` of every window; an item of fewer words is one window."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return (
        words.select("item_id", "w", F.explode(starts).alias("at"))
        .select(F.slice("w", F.col("at"), window).alias("words"), "item_id")
        .distinct()
    )


class WindowIndex:
    """Windows by length, found by a rolling hash over word numbers and verified word by word."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, windows: list[tuple[tuple[bytes, ...], str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        items: dict[tuple[int, ...], set[str]] = {}
        for words, item in windows:
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            items.setdefault(key, set())
            if item is not None:
                items[key].add(item)
        self.items = items
        self.hashes = {
            size: np.unique([self._hash(np.array(k, dtype=np.uint64), size)[0] for k in keys])
            for size, keys in groupby(sorted(items, key=len), key=len)
        }

    def _hash(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hash of every run of `size` numbers."""
        out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
        for k in range(size):
            out = out * self.BASE + ids[k : k + len(out)]
        return out ^ (out >> np.uint64(29))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each occurrence."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        runs = edge.reshape(-1, 2)
        for size, known in self.hashes.items():
            # only runs of benchmark words long enough can hold a window
            for a, b in runs[runs[:, 1] - runs[:, 0] >= size].tolist():
                found = self._hash(ids[a:b], size)
                at = np.searchsorted(known, found)
                hit = known[np.minimum(at, len(known) - 1)] == found
                for start in (np.flatnonzero(hit) + a).tolist():
                    items = self.items.get(tuple(ids[start : start + size].tolist()))
                    if items is not None:
                        yield start, start + size, items


def merged(spans: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[dict[str, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"first": first, "end": end})
    return out


def _scan(docs: DataFrame, rows: list, name: str) -> tuple[DataFrame, Broadcast]:
    """Adds `name`: word spans and items of the benchmark windows in each text; and what it broadcasts."""
    spark = docs.sparkSession
    windows = spark.sparkContext.broadcast(
        [(tuple(w.encode() for w in row.words), row.item) for row in rows]
    )
    state: dict[str, WindowIndex] = {}

    @F.arrow_udf("struct<n_words:int,spans:array<struct<first:int,end:int>>,items:array<string>>")
    def scanned(texts: pa.Array) -> pa.Array:
        index = state.get("index") or state.setdefault("index", WindowIndex(windows.value))
        out = []
        for raw in raw_texts(texts):
            words, spans, items = split_words(raw), [], set()
            for first, end, found in index.find(words):
                spans.append((first, end))
                items |= found
            out.append({"n_words": len(words), "spans": merged(spans), "items": sorted(items)})
        return pa.array(
            out, pa.struct([("n_words", pa.int32()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
        )

    return docs.withColumn(name, scanned(F.col("text"))), windows


def _hits_by_block(docs: DataFrame, windows: DataFrame, blocks: int, name: str) -> DataFrame:
    """`with_hits` for more windows than one broadcast holds.

    Documents are stored with a row number. Every block is collected, broadcast, scanned for and
    dropped before the next one; only rows with hits are written, and joined back at the end.
    """
    row, found, spans, items = "__llm_row", "__llm_found", "__llm_spans", "__llm_items"
    docs = stored(without(docs, row, spans, items).withColumn(row, F.monotonically_increasing_id()), "documents")
    windows = stored(windows.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(blocks))), "windows")
    hits = None
    for k in range(blocks):
        chosen = windows.filter(F.col("part") == k).select("words", "item").collect()
        marked, sent = _scan(docs.select(row, "text"), chosen, found)
        some = marked.filter(F.size(f"{found}.spans") > 0)
        part = stored(some.select(row, F.col(f"{found}.spans").alias(spans), F.col(f"{found}.items").alias(items)), "hits")
        sent.destroy()
        hits = part if hits is None else hits.unionByName(part)
    drop_stored(windows)

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def joined(rows: pa.Array) -> pa.Array:
        return pa.array([merged((s["first"], s["end"]) for s in r) for r in rows.to_pylist()], pa.list_(SPAN))

    together = hits.groupBy(row).agg(
        joined(F.flatten(F.collect_list(spans))).alias(spans),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
    )
    hit = F.struct(
        F.size(words_of(F.col("text"))).alias("n_words"),
        F.coalesce(spans, F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )
    return docs.join(together, row, "left").withColumn(name, hit).drop(row, spans, items)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Adds the struct `name`: `n_words`, `spans` (merged, in order) and `items` (sorted strings).

    The windows are counted first. Up to `block` of them are broadcast and the documents pass in one
    narrow stage; a larger benchmark is cut into blocks by a hash of the window, taken one after the
    other, so driver and workers hold one block at a time and nothing is left out. Null or empty
    texts have no words, very long ones are scanned whole; windows of an item without id mark words
    but no item; repeated rows are marked alike; an empty benchmark marks none. A column `name` is
    replaced, all others stay.
    """
    ship_package(docs.sparkSession)
    windows = benchmark_windows(benchmark, window).select("words", F.col("item_id").cast("string").alias("item"))
    blocks = -(-windows.count() // block)
    if blocks > 1:
        return _hits_by_block(docs, windows, blocks, name)
    return _scan(docs, windows.collect(), name)[0]


_WORD = re.compile(SEPARATORS.replace("[", "[^", 1).encode())


def cut_spans(raw: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : places[s["first"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with their own columns, without what they share with the benchmark.

    `documents` drops every text that holds a window, `spans` cuts the hit words out and keeps all
    rows. Nulls, empty texts and rows without a hit stay as they are; repeated rows are treated
    alike; an empty benchmark changes nothing. Up to `block` windows no row is shuffled.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    hits = "__llm_hits"
    marked = with_hits(docs, benchmark, hits, window, block)
    if mode == "documents":
        return marked.filter(F.size(f"{hits}.spans") == 0).drop(hits)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(raw_texts(texts), spans.to_pylist())
        return pa.array([cut_spans(raw, found) if found else raw for raw, found in rows], pa.binary()).cast(pa.string())

    return marked.withColumn("text", cut(F.col("text"), F.col(f"{hits}.spans"))).drop(hits)
