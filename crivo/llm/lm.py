"""Stupid-backoff scores from n-gram counts of the whole corpus.

Documents form blocks by a hash. A block asks for its distinct n-grams; the questions are shuffled
by n-gram hash, where the counts of all blocks meet and become the count tables; the answers go
back to the block and are summed per document. Questions of one block to one part of the tables
travel as one packed row, so a word that is everywhere costs one entry a block. Texts, questions
and answers travel packed, as they are most of what the job writes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import split_words
from crivo.session import ship_package

#: Text bytes of a block, and the least number of blocks and of parts of the count tables.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 48
ALPHA = 0.4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", 1)


def squeeze(raw: bytes) -> bytes:
    return _ZSTD.compress(raw, asbytes=True)


def unsqueeze(raw: bytes, size: int) -> bytes:
    return _ZSTD.decompress(raw, size, asbytes=True)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes as gaps, byte by byte of all gaps: what is below the mean gap is
    noise and stays as it is, the few bits above are compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    low = max(1, int(keys[-1] - keys[0]) // len(keys)).bit_length() // 8
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    head = np.array([len(keys), low], dtype="<u4").tobytes()
    return head + planes[:low].tobytes() + squeeze(planes[low:].tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    n, low = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    high = unsqueeze(raw[8 + n * low :], (8 - low) * n)
    planes = np.frombuffer(raw[8 : 8 + n * low] + high, dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in the narrowest type that holds them."""
    kind = np.min_scalar_type(int(values.max()))
    head = np.array([len(values), kind.itemsize], dtype="<u4").tobytes()
    return head + squeeze(values.astype(kind).tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    n, width = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    return np.frombuffer(unsqueeze(raw[8:], n * width), dtype=f"u{width}").astype(np.int64)


class Grams:
    """N-grams of a block's documents by order: sorted distinct hashes, counts and positions."""

    def __init__(self, texts: list[bytes | None], order: int):
        seen: dict[bytes, int] = {}
        ids, self.sizes = [], []
        for raw in texts:
            words = split_words(raw)
            self.sizes.append(len(words))
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w, 42)
            ids.extend([seen[w] for w in words])
        one = np.array(ids, dtype=np.uint64)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes) if one.size else np.zeros(0, dtype=np.int64)
        room = ends - np.arange(len(one))  # words from here to the document's end
        #: by order from 0: distinct hashes, their counts in the block
        self.keys = [np.zeros(1, dtype=np.uint64)]
        self.counts = [np.array([len(one)])]
        #: by order from 1: start positions and the index of the n-gram there
        self.starts, self.index = [None], [None]
        grams = one
        for k in range(1, order + 1):
            at = np.flatnonzero(room >= k)
            if k > 1:
                grams = (grams[: len(one) - k + 1] * _MIX) ^ one[k - 1 :] if len(one) >= k else one[:0]
                grams = grams ^ (grams >> np.uint64(31))
            keys, index, counts = np.unique(grams[at], return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.starts.append(at)
            self.index.append(index)

    def parts(self, k: int, bits: int) -> list[tuple[int, int, int]]:
        """(part, first, end) of the sorted hashes of one order; a part is the hash's top bits."""
        part = (self.keys[k] >> np.uint64(64 - bits)).astype(np.int64)
        found, first = np.unique(part, return_index=True)
        return list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))


def backoff_scores(grams: Grams, totals: list[np.ndarray], order: int, min_count: int, alpha: float) -> np.ndarray:
    """Log score of every word: the longest n-gram ending there that is frequent enough counts."""
    n = sum(grams.sizes)
    score = np.log(totals[1][grams.index[1]] / max(1, int(totals[0][0]))) if n else np.zeros(0)
    first = np.repeat(np.cumsum(grams.sizes) - grams.sizes, grams.sizes)
    longest = np.minimum(np.arange(n) - first + 1, order)  # n-gram length the document allows here
    score += math.log(alpha) * (longest - 1)
    below = np.zeros(n)
    for k in range(2, order + 1):
        below[:] = 0
        below[grams.starts[k - 1]] = totals[k - 1][grams.index[k - 1]]
        count = totals[k][grams.index[k]]
        known = count >= min_count
        start = grams.starts[k][known]
        end = start + k - 1
        score[end] = np.log(count[known] / below[start]) + math.log(alpha) * (longest[end] - k)
    return score


def lm_scores(docs: DataFrame, order: int = 2, min_count: int = 2, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `log_score` (sum of natural logs), `mean_score`.

    S(w | h) is count(h w) / count(h) if the n-gram occurs at least `min_count` times in the
    corpus, else `alpha` times S(w | shorter h); a single word has its share of all words. A
    word's history ends at its document's start. Counts cover every row of the table, repeated
    ones as often as they occur. Null and empty texts have zero words, score 0 and a null mean; an
    empty table gives no rows; other columns are ignored. N-grams are told apart by 64 bits.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // block_bytes))
    bits = max(1, math.ceil(math.log2(blocks)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            packed = [x if x is None else squeeze(x) for x in raw]
            sizes = [x if x is None else len(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), batch.column("block")],
                names=["doc_id", "packed", "size", "block"],
            )

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(
        pack, f"doc_id {kind}, packed binary, size long, block int"
    )

    def texts(table: pa.Table) -> list[bytes | None]:
        pairs = zip(table.column("packed").to_pylist(), table.column("size").to_pylist())
        return [x if x is None else unsqueeze(x, n) for x, n in pairs]

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = Grams(texts(table), order)
        out = [
            (k, part, pack_keys(grams.keys[k][a:b]), pack_numbers(grams.counts[k][a:b]))
            for k in range(order + 1)
            for part, a, b in grams.parts(k, bits)
        ]
        kinds, parts, keys, counts = zip(*out)
        return pa.table({
            "part": pa.array(parts, pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int32()),
            "n": pa.array(kinds, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        kinds = table.column("n").to_numpy()
        totals: list[bytes] = [b""] * len(kinds)
        packed = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        for k in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == k).tolist()
            keys = [unpack_keys(packed[0][i]) for i in own]
            counts = np.concatenate([unpack_numbers(packed[1][i]) for i in own])
            _, index = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.bincount(index, weights=counts).astype(np.int64)
            if k > 1:  # rarer n-grams count nowhere: they back off, and no known n-gram extends one
                every[every < min_count] = 0
            every = every[index]
            for i, piece in zip(own, np.split(every, np.cumsum([len(x) for x in keys])[:-1])):
                totals[i] = pack_numbers(piece)
        return pa.table({
            "block": table.column("block"), "part": table.column("part"), "n": table.column("n"),
            "totals": pa.chunked_array([pa.array(totals, pa.binary())]),
        })

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = Grams(texts(left), order)
        found: dict[int, list[tuple[int, bytes]]] = {k: [] for k in range(order + 1)}
        for k, part, raw in zip(*[right.column(c).to_pylist() for c in ("n", "part", "totals")]):
            found[k].append((part, raw))
        totals = [
            np.concatenate([np.zeros(0, dtype=np.int64), *(unpack_numbers(raw) for _, raw in sorted(found[k]))])
            for k in range(order + 1)
        ]
        words = backoff_scores(grams, totals, order, min_count, alpha)
        ends = np.cumsum(grams.sizes)
        sums = [float(words[e - n : e].sum()) for e, n in zip(ends.tolist(), grams.sizes)]
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(grams.sizes, pa.int64()),
            "log_score": pa.array(sums, pa.float64()),
            "mean_score": pa.array([s / n if n else None for s, n in zip(sums, grams.sizes)], pa.float64()),
        })

    asked = blocked.groupBy("block").applyInArrow(ask, "part int, block int, n int, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block int, part int, n int, totals binary")
    return (
        blocked.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_score double")
    )
