"""The Merkle manifest against plain trees, and the block layout against its definition."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.llm import merkle
from crivo.llm.merkle import address, block_paths, build_manifest, fill, fold, folded, leaf_digest, prove
from crivo.llm.ranking import ranked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree over hex digests, the leaves' first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def plain_proof(levels, at):
    proof = []
    for nodes in levels[:-1]:
        if at ^ 1 < len(nodes):
            proof.append(nodes[at ^ 1])
        at //= 2
    return proof


def plain_manifest(rows):
    """(root, Counter of (doc_id, leaf, subroot, proof text)) of rows (doc_id, tree, leaf)."""
    trees = defaultdict(list)
    for doc_id, tree, leaf in rows:
        trees[tree].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: plain_tree([m[2] for m in sorted(trees[t])]) for t in names}
    top = plain_tree([built[t][-1][0] for t in names])
    out = Counter()
    for k, t in enumerate(names):
        for at, member in enumerate(sorted(trees[t])):
            proof = plain_proof(built[t], at) + plain_proof(top, k)
            out[member[3], member[2], built[t][-1][0], "".join(proof)] += 1
    return top[-1][0], out


def check(spark, rows, height):
    made = spark.createDataFrame(rows, "doc_id long, tree string, leaf string")
    manifest = build_manifest(made.withColumn("digest", F.unhex("leaf")), ["doc_id"], height)
    proved = prove(manifest).withColumn("back", folded("digest"))
    got = [
        (r.doc_id, r.leaf, bytes(r.subroot).hex(), bytes(r.siblings).hex()) for r in proved.collect()
    ]
    root, expected = plain_manifest(rows)
    assert manifest.root == root and Counter(got) == expected
    assert proved.filter(F.lower(F.hex("back")) != root).count() == 0


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, height):
    draw = random.Random(height)
    rows = [(draw.randrange(40), draw.choice(["en", "é", "a", None]), sha(str(draw.randrange(60)))) for _ in range(150)]
    rows += [(None, "en", sha("x")), (None, None, sha("y")), (7, "one", sha("z")), (7, "en", sha("z")), (7, "en", sha("z"))]
    check(spark, rows, height)


def test_one_leaf_equal_rows_and_many_trees(spark):
    check(spark, [(1, "en", sha("a"))], 10)
    check(spark, [(1, "en", sha("a"))] * 9, 2)
    check(spark, [(k, f"t{k}", sha(str(k))) for k in range(19)], 1)


def test_an_empty_table_has_no_root(spark):
    made = spark.createDataFrame([], "doc_id long, tree string, digest binary")
    manifest = build_manifest(made, ["doc_id"])
    assert manifest.root is None and prove(manifest).count() == 0


def test_leaves_spell_out_nulls_lengths_and_long_texts(spark):
    long = "wörd " * 100_000
    docs = spark.createDataFrame([(1, None, "é"), (None, 5, ""), (-2, 0, long)], "a long, b int, c string")
    leaves = [bytes(r.leaf).hex() for r in docs.select(leaf_digest("a", "b", "c").alias("leaf")).collect()]
    assert leaves == [sha("1:1-2:é"), sha("-1:50:"), sha(f"2:-21:0{len(long.encode())}:{long}")]


def layout(levels):
    """Addresses by definition: the upper half, then each lower subtree, all in the same layout."""
    if levels == 1:
        return {(0, 0): 0}
    top = levels // 2
    bottom = levels - top
    out = dict(layout(top))
    for j in range(1 << top):
        base = (1 << top) - 1 + j * ((1 << bottom) - 1)
        for (depth, index), at in layout(bottom).items():
            out[depth + top, (j << depth) + index] = base + at
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 8])
def test_addresses_follow_the_layout(levels):
    expected = layout(levels)
    got = {
        (d, i): int(address(levels, d, np.array([i]))[0]) for d in range(levels) for i in range(1 << d)
    }
    assert got == expected and sorted(got.values()) == list(range((1 << levels) - 1))


@pytest.mark.parametrize("count", [1, 2, 5, 8, 13, 16])
def test_a_changed_leaf_leads_to_another_root(count):
    levels = 5
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(count)]
    store = [bytes(32)] * 31
    root = fill(store, 0, levels, leaves)
    for k, (siblings, sides) in enumerate(block_paths(b"".join(store), levels, count, np.arange(count))):
        assert len(sides) == 4 and fold(leaves[k], siblings, sides) == root
        assert fold(hashlib.sha256(b"x").digest(), siblings, sides) != root


def test_positions_run_over_ranges(spark):
    rows = [(k % 3 or None, k % 7) for k in range(500)] + [(5, 1)] * 300
    made = spark.createDataFrame(rows, "g int, v int")
    out = ranked(made, "g", ["v"], "test").collect()
    for group in {g for g, _ in rows}:
        own = sorted((r.position, r.v, r["size"]) for r in out if r.g == group)
        values = sorted(v for g, v in rows if g == group)
        assert own == [(k, v, len(values)) for k, v in enumerate(values)]
    assert merkle.HEIGHT == 10
