"""Near and exact duplicates against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crivo.llm.components import components
from crivo.llm.exact import exact_groups, misra_gries
from crivo.llm.simhash import ball_masks, bucket_bits, bucket_links, fingerprint, simhash_groups, simhash_keep

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TRICKY = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "Straße und Öl und mehr Wörter"),
    (7, "word " * 30_000), (8, "word " * 30_000 + "tail"), (9, "a b c d e f g h"), (9, "a b c d e f g h"),
    (None, "a b c d e f g h"), (None, "only nulls here today"), (None, "only nulls here today"), (10, "STRASSE"),
]


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=4):
    """doc_id -> set of smallest ids of the components its rows are in."""
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        groups[find(k)].append(i)
    first = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return [(i, f"{p:016x}", first[find(k)]) for k, (i, p) in enumerate(prints)]


def as_set(rows):
    return sorted(rows, key=str)


def test_simhash_equals_brute_force(spark, folder):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    near = [(10_000 + k, (t or "") + " x") for k, (_, t) in enumerate(given[:60])]
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs_of(spark, given + near)).collect()]
    expected = slow_components(given + near)
    assert as_set(rows) == as_set(expected)
    assert any(c != i for i, _, c in rows if i >= 10_000)


def test_simhash_defines_tricky_rows(spark):
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs_of(spark, TRICKY)).collect()]
    assert as_set(rows) == as_set(slow_components(TRICKY))
    assert {r[1] for r in rows if r[0] in (1, 2, 3)} == {"0" * 16}


def test_simhash_keep_leaves_one_of_each_component(spark):
    docs = docs_of(spark, TRICKY).withColumn("fp", F.lit(7)).withColumn("component_id", F.lit("x"))
    kept = simhash_keep(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in slow_components(TRICKY)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == expected


def test_simhash_keep_does_not_depend_on_the_layout(spark):
    rows = [(1, "a b c d e f", lang, source, n) for lang in ("en", None, "de") for source in ("s", "t") for n in (5, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [simhash_keep(docs.orderBy(F.rand(seed)).repartition(parts)).collect() for seed, parts in ((1, 1), (2, 5), (3, 7))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_simhash_of_nothing(spark):
    empty = docs_of(spark, [])
    assert simhash_groups(empty).count() == 0 and simhash_keep(empty).count() == 0


def test_fingerprint_of_long_text_counts_repeats():
    text = "to be or not to be " * 5000 + "that is the question"
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_pair_in_the_ball_is_linked():
    """Random fingerprints and variants at each distance; all buckets together connect them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, size=40, dtype=np.uint64)
    values, wanted = [base], []
    for bits in range(1, 8):
        flips = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in base]
        other = base ^ np.array(flips, dtype=np.uint64)
        values.append(other)
        wanted += list(zip(base.tolist(), other.tolist(), [bits] * len(base)))
    every = np.unique(np.concatenate(values))
    links = [bucket_links(every, b, 6, 2) for b in range(64)]
    parent = {v: v for v in every.tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        for a, b in zip(u.tolist(), v.tolist()):
            parent[find(a)] = find(b)
    near = (np.bitwise_count(every[:, None] ^ every[None, :]) <= 4).nonzero()
    assert all(find(int(every[a])) == find(int(every[b])) for a, b in zip(*near))
    assert any(find(a) != find(b) for a, b, bits in wanted if bits > 4)
    assert len(ball_masks(2)) == 2081


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 500)]
    edges = spark.createDataFrame(chain + star + star + [(7, 7)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(500)}
    assert components(edges.filter("u < 0")).count() == 0


def slow_exact(pairs):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(pairs):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups[hashlib.sha256(folded.encode()).hexdigest()].append(i)
    return {
        d: (max((i for i in g if i is not None), default=None), len(g)) for d, g in groups.items()
    }


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_exact_groups_equal_brute_force(spark, counters):
    pairs = TRICKY + [(100 + k, "Hot Text") for k in range(300)] + [(600 + k, f"text {k % 40}") for k in range(200)]
    expected = slow_exact(pairs)
    rows = exact_groups(docs_of(spark, pairs), counters).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert (r.keep_id, r.group_size) == expected[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    kept = [r.text_sha256 for r in rows if r.kept]
    assert sorted(kept) == sorted(expected)
    assert exact_groups(docs_of(spark, [])).count() == 0


def test_misra_gries_never_loses_a_frequent_value():
    values = [1, 2, 3] * 40 + list(range(100, 220)) + [9] * 60
    rng = np.random.default_rng(0)
    rng.shuffle(values)
    summary = {}
    misra_gries(summary, iter(values), 7)
    assert len(summary) <= 7 and 9 in summary


def test_buckets_stay_bounded_at_any_count():
    for count in (0, 1_000, 5_000_000, 10**8, 10**10):
        bits = bucket_bits(count, 2081)
        assert count * min(2081, 1 << bits) >> bits <= 1 << 24
        assert count * 2081 >> bits <= 1 << 27
    assert bucket_bits(100_000, 2081) == 6
