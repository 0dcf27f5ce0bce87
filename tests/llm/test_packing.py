"""Sum-of-squares packing: ids against the tokenizer itself, placements against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crivo.llm import packing, queries
from crivo.llm.packing import LevelPacker, pack_documents, segments, sequences

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def check_pieces(rows, expected):
    """Every id lies in one piece, sequences are gapless, and nothing needs padding."""
    docs, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    assert set(docs) == set(expected)
    for doc_id, pieces in docs.items():
        joined, at = [], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(expected[doc_id])
            joined += ids_of(r.ids)
            at += r.length
        assert joined == expected[doc_id]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_pieces_hold_the_tokenizers_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pack_documents(docs, VOCABULARY).collect()
    check_pieces(rows, {r.doc_id: reference_ids(r.text) for r in docs.collect()})
    by_id = {(r.doc_id, r.start): r for r in rows}
    for r in queries.op13_pack(spark, folder).collect():
        assert r.ids_crc32 == zlib.crc32(by_id[r.doc_id, r.start].ids)


def test_edge_texts_and_clashing_columns(spark):
    texts = [None, "", " ", "<|endoftext|> a", "x" * 5000, "héé 日本語 ١٢٣ 😀   end", "word " * 40000, "a\r\n\t b", "é" * 200_000]
    docs = spark.createDataFrame(
        [(i, t, "theirs", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int"
    ).coalesce(1)
    check_pieces(pack_documents(docs, VOCABULARY).collect(), {i: reference_ids(t) for i, t in enumerate(texts)})
    assert pack_documents(docs.limit(0), VOCABULARY).count() == 0
    twice = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "d"), (1, "d")], "doc_id long, text string")
    rows = pack_documents(twice.coalesce(1), VOCABULARY).collect()
    assert sum(r.length for r in rows) == sum(len(reference_ids(t)) for t in ("a b c", "a b c", "d", "d"))
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' AS string)").alias("text"))
    check_pieces(pack_documents(broken, VOCABULARY).collect(), {0: reference_ids("a�b")})
    with pytest.raises(ValueError):
        pack_documents(docs, VOCABULARY, window=1000)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_segments_keep_the_ids(text, size):
    parts = list(segments(text * 3, size))
    assert "".join(parts) == text * 3
    assert sum((TOKENIZER.encode(p, add_special_tokens=False).ids for p in parts), []) == reference_ids(text * 3)[:-1]


def squares(counts):
    return sum(int(c) ** 2 for c in counts)


def test_every_placement_leaves_the_least_sum_of_squares():
    draw, packer = random.Random(5), LevelPacker(16)
    for k in range(600):
        size = draw.randint(1, 15)
        counts, best = packer.counts.copy(), {}
        for level in range(16 - size + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            best[level] = squares(after)
        assert best[packer.level_for(size)] == min(best.values())
        packer.place(k, 0, np.arange(size))
        assert [len(at) for at in packer.at_level] == packer.counts[:16].tolist()
    spare = sum(n * (16 - level) for level, n in enumerate(packer.counts.tolist()))
    assert spare < 0.05 * 600 * 8  # equally frequent sizes pack almost without loss


@pytest.mark.parametrize("size", [1, 700, 1023])
def test_sizes_that_never_fit_together_stay_bounded_and_unpadded(size):
    packer = LevelPacker(1024, open_windows=50)
    for k in range(1000):
        packer.place(k, 0, np.full(size, k))
        assert packer.counts.sum() <= 50
    packer.drain()
    used, seen = defaultdict(int), defaultdict(int)
    for item, first, ids, sequence, offset in sorted(packer.closed, key=lambda c: (c[3], c[4])):
        assert offset == used[sequence] and (ids == item).all()
        used[sequence] += len(ids)
        seen[item] += len(ids)
    assert set(seen.values()) == {size} and len(seen) == 1000
    short = [n for n in used.values() if n != 1024]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 10 * (1 + 1000 // 50)


def test_sequences_are_padded_except_at_powers_of_two(spark):
    rows = [(1, 0, 2, b"\1\0\0\0\2\0\0\0"), (1, 2, 1, b"\3\0\0\0"), (2, 0, 4, b"\4\0\0\0" * 4)]
    made = spark.createDataFrame(rows, "sequence_id long, offset long, length long, ids binary")
    out = {r.sequence_id: (r.used, ids_of(r.ids)) for r in sequences(made, window=8, pad_id=9).collect()}
    assert out == {1: (3, [1, 2, 3] + [9] * 5), 2: (4, [4] * 4)}


def test_packing_is_the_same_when_a_task_runs_again(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = ["sequence_id", "offset"]
    first = pack_documents(docs, VOCABULARY).orderBy(*order).collect()
    assert first == pack_documents(docs, VOCABULARY).orderBy(*order).collect()
    assert packing.OPEN_WINDOWS > 0
