"""Boosted trees against a plain leaf-wise learner, and early stopping."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crivo.plans import boosting as B
from crivo.plans import training as M
from crivo.plans.boosting import BoostedTrees, Recipe, best_cuts, fit_boosted, sampled


def made_rows(n, seed=1, noise=0.2):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        x = [draw.randrange(6), round(draw.random(), 2), draw.choice([0, 1]), draw.gauss(0, 1)]
        bad = (x[0] >= 3) ^ (x[1] > 0.6) if draw.random() > noise else draw.random() < 0.5
        rows.append((k, x, int(bad), 3.0 if bad else 1.0, draw.random() < 0.25))
    return rows


def table(spark, rows, parts=3):
    plain = [(k, [float(v) for v in x], float(y), w, c) for k, x, y, w, c in rows]
    made = spark.createDataFrame(plain, "id long, v array<double>, label double, weight double, checks boolean")
    return made.withColumn("features", array_to_vector("v")).drop("v").repartition(parts)


def score(g, h, r):
    t = max(abs(g / B.SCALE) - r.l1, 0.0)
    return t * t / (h / B.SCALE + r.l2)


def plain_cut(bins, g, h, rows, r):
    """(gain, feature, bin) by trying every cut; ties to the lowest feature, then the lowest bin."""
    best = None
    gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f in range(bins.shape[1]):
        for b in sorted({int(bins[i, f]) for i in rows}):
            left = [i for i in rows if bins[i, f] <= b]
            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
            if min(len(left), len(rows) - len(left)) < r.rows_in_leaf or min(hl, ht - hl) < B.LEAST_HESSIAN * B.SCALE:
                continue
            gain = score(gl, hl, r) + score(gt - gl, ht - hl, r) - score(gt, ht, r)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def plain_model(values, y, w, cuts, start, r):
    """Margins after every round of leaf-wise growing, each leaf's cut found by search."""
    bins = B.bin_rows(values, cuts)
    margin, out, trees = np.full(len(y), start), [], []
    for _ in range(r.rounds):
        p = 1 / (1 + np.exp(-margin))
        g = [int(v) for v in np.rint(w * (p - y) * B.SCALE)]
        h = [int(v) for v in np.rint(w * p * (1 - p) * B.SCALE)]
        leaves = {0: (list(range(len(y))), 0)}
        number, splits = 1, []
        while len(leaves) < r.leaves:
            found = {k: plain_cut(bins, g, h, rows, r) for k, (rows, depth) in leaves.items() if depth < r.depth}
            found = {k: c for k, c in found.items() if c}
            if not found:
                break
            node = max(found, key=lambda k: (found[k][0], -k))
            _, f, b = found[node]
            rows, depth = leaves.pop(node)
            splits.append((f, b))
            leaves[number] = ([i for i in rows if bins[i, f] <= b], depth + 1)
            leaves[number + 1] = ([i for i in rows if bins[i, f] > b], depth + 1)
            number += 2
        for rows, _ in leaves.values():
            value = B.leaf_value(sum(g[i] for i in rows), sum(h[i] for i in rows), r)
            margin[rows] += value
        out.append(margin.copy())
        trees.append(splits)
    return out, trees


@pytest.mark.parametrize("l1,l2", [(0.0, 0.0), (0.5, 0.5), (2.0, 10.0)])
def test_trees_equal_a_plain_leaf_wise_learner(spark, l1, l2):
    rows = made_rows(150)
    recipe = Recipe(rounds=3, rate=0.3, leaves=6, depth=4, rows_in_leaf=8, l1=l1, l2=l2, bins=16)
    model = fit_boosted(table(spark, rows).drop("checks"), recipe, ["id"])
    values = np.array([r[1] for r in rows], dtype=float)
    y, w = np.array([float(r[2]) for r in rows]), np.array([r[3] for r in rows])
    margins, trees = plain_model(values, y, w, model.cuts, model.start, recipe)
    for tree, splits in zip(model.trees, trees):
        own = sorted((f, c) for f, c in zip(tree.feature, tree.cut) if f >= 0)
        assert own == sorted(splits) and sum(f < 0 for f in tree.feature) == len(splits) + 1 <= 6
    assert np.allclose(model.margins(values), margins[-1], rtol=0, atol=1e-9)
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_best_cuts_equal_a_search(spark):
    draw = np.random.default_rng(3)
    n, recipe = 400, Recipe(rows_in_leaf=15, l1=0.7, l2=0.3, bins=8)
    bins = draw.integers(0, 8, size=(n, 3)).astype(np.uint8)
    g, h = draw.integers(-(1 << 20), 1 << 20, n).tolist(), draw.integers(1, 1 << 18, n).tolist()
    slots = draw.integers(0, 4, n)
    rows = [(int(slots[i]), f, int(bins[i, f]), g[i], h[i], 1) for i in range(n) for f in range(3)]
    sums = spark.createDataFrame(rows, "slot int, feature int, bin int, g long, h long, n long")
    got = best_cuts(sums, recipe).collect()
    assert len(got) == 12
    for r in got:
        own = [i for i in range(n) if slots[i] == r.slot]
        best = plain_cut(bins[:, [r.feature]], g, h, own, recipe)
        assert (r.gt, r.ht, r.nt) == (sum(g[i] for i in own), sum(h[i] for i in own), len(own))
        if best is None:
            assert r.best.gain is None
        else:
            assert r.best.gain == pytest.approx(best[0], rel=1e-12) and -r.best.low == best[2]


def test_growing_stops_after_the_patience(spark, monkeypatch):
    rounds = []
    grow = B._grow
    monkeypatch.setattr(B, "_grow", lambda *a: rounds.append(1) or grow(*a))
    rows = table(spark, made_rows(300, noise=0.7))
    recipe = Recipe(rounds=200, rate=0.8, leaves=8, depth=4, rows_in_leaf=5, patience=4)
    model = fit_boosted(rows, recipe, ["id"], "checks")
    best = int(np.argmin(model.losses))
    assert len(model.losses) - 1 == best + 4 and model.getNumTrees == best
    assert len(rounds) == best + 5 < 200  # every round once; the tree of the last one is dropped
    checked = [r for r in made_rows(300, noise=0.7) if r[4]]
    margins = model.margins(np.array([r[1] for r in checked], dtype=float))
    loss = np.mean([r[3] * math.log1p(math.exp(-(2 * r[2] - 1) * m)) for r, m in zip(checked, margins)])
    assert model.losses[best] == pytest.approx(loss, abs=1e-5)


def test_growing_to_the_end_without_a_stop(spark):
    rows = table(spark, made_rows(200))
    model = fit_boosted(rows, Recipe(rounds=6, leaves=4, depth=3, patience=50, rate=0.05), ["id"], "checks")
    assert len(model.losses) == 7 and model.getNumTrees == int(np.argmin(model.losses))
    plain = fit_boosted(rows, Recipe(rounds=2, leaves=4, depth=3), ["id"], "checks")
    assert len(plain.losses) == 3 and plain.getNumTrees == 2


def test_samples_do_not_depend_on_the_layout(spark):
    rows = made_rows(300)
    recipe = Recipe(rounds=4, leaves=6, depth=4, rows_in_leaf=5, row_share=0.7, rows_every=2, feature_share=0.5)
    models = [fit_boosted(table(spark, rows, parts), recipe, ["id"], "checks") for parts in (1, 5)]
    assert models[0].trees == models[1].trees and models[0].losses == models[1].losses
    draws = np.arange(200_000, dtype=np.int64) * 12345
    first, second = sampled(draws, 1, 0.7), sampled(draws, 2, 0.7)
    assert abs(first.mean() - 0.7) < 0.005 and abs((first & second).mean() - 0.49) < 0.006


def test_models_are_saved_and_served(spark, tmp_path):
    rows = table(spark, made_rows(200))
    model = fit_boosted(rows, Recipe(rounds=3, leaves=4, depth=3), ["id"])
    model.save(spark, str(tmp_path))
    again = BoostedTrees.load(spark, str(tmp_path))
    assert (again.trees, again.recipe, again.start) == (model.trees, model.recipe, model.start)
    p = [r.p for r in M.with_probability(again, rows.orderBy("id")).select("p").collect()]
    values = np.array([r[1] for r in made_rows(200)], dtype=float)
    assert np.allclose(p, 1 / (1 + np.exp(-model.margins(values))))


def test_one_class_or_no_rows_give_no_trees(spark):
    rows = table(spark, made_rows(50)).withColumn("label", F.lit(1.0))
    assert fit_boosted(rows, Recipe(rounds=3)).getNumTrees == 0
    assert fit_boosted(rows.limit(0), Recipe(rounds=3)).getNumTrees == 0
    with pytest.raises(ValueError):
        fit_boosted(rows, Recipe(bins=1000))


def test_training_tasks_hold_a_bounded_number_of_rows(spark):
    """A compact file of many rows is dealt out whole, in an order the rows decide; a small one stays."""
    rows = spark.range(900).select(
        array_to_vector(F.array((F.col("id") % 300).cast("double"), F.lit(1.0))).alias("features"),
        (F.col("id") % 2).cast("double").alias("label"),
    ).coalesce(1)
    assert M.dealt(rows).rdd.getNumPartitions() == 1
    parts = [M.dealt(rows, 100).rdd.glom().collect() for _ in range(2)]
    assert parts[0] == parts[1]
    assert len(parts[0]) == 9 and max(len(p) for p in parts[0]) <= 110
    assert sorted(str(r) for p in parts[0] for r in p) == sorted(str(r) for r in rows.collect())


def test_learner_and_search_deal_their_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "dealt", lambda rows, dealt=M.dealt: seen.append(rows.count()) or dealt(rows, 50))
    table = spark.createDataFrame(
        [(k, float(k % 7), int(k % 7 > 3)) for k in range(200)], "id long, x double, inadimplente int"
    )
    rows = M.assemble(table, ["x"])
    assert M.train_gbt(rows, maxIter=1, maxDepth=2).numFeatures == 1
    space = {"maxIter": (1, 1, False), "maxDepth": (2, 2, False)}
    model, trials = M.tune(rows, ["id"], n=1, folds=2, space=space)
    assert seen == [200, 200] and trials.first().mean_auc == 1.0
