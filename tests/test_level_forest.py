"""MLlib's forest grown level by level: a plain recursion's trees, MLlib's kind of model, no fit by MLlib itself."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.operators import forest, form
from touchline.operators import level_forest as lv
from touchline.operators.grown_forest import node_features
from touchline.plans import queries_ml

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """1,500 rows of three classes of unlike number; ``c`` is noise with nulls, ``d`` has three values."""
    x = spark.range(0, 1500, 1, 3).select(
        F.col("id").alias("match_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.when(F.rand(3) > 0.1, F.rand(4)).alias("c"), (F.col("id") % 3).cast("int").alias("d"))
    x = x.withColumn("label_str", F.when(F.col("a") + F.rand(5) / 3 > 1.0, "H").when(F.col("b") > 0.5, "A").otherwise("D"))
    path = str(tmp_path_factory.mktemp("levels") / "rows")
    x.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def by_levels(monkeypatch):
    """Few rows count as many, and MLlib's own fit is refused."""
    from pyspark.ml.classification import RandomForestClassifier

    def refuse(*_):
        raise AssertionError("MLlib fitted the forest")

    monkeypatch.setattr(forest, "LEVEL_ROWS", 100)
    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)


def _plain(x, y, w, tree, node, depth, most, spec):
    """{node: (feature, bin, counts)} by recursion, a cut's gain from its definition."""
    k, cw = spec["classes"], np.array(spec["weights"])
    counts = np.bincount(y, weights=w, minlength=k)

    def gini(c):
        return 1 - ((c * cw / (c * cw).sum()) ** 2).sum()

    best = (1e-9, None)
    for f in node_features(spec["seed"], tree, np.array([node]), x.shape[1], spec["take"])[0] if depth < most else ():
        for b in range(31):
            side = x[:, f] > b
            sides = [np.bincount(y[s], weights=w[s], minlength=k) for s in (~side, side)]
            if min(s.sum() for s in sides) >= spec["least"]:
                gain = gini(counts) - sum((s * cw).sum() / (counts * cw).sum() * gini(s) for s in sides)
                if gain > best[0] + 1e-12:
                    best = gain, (int(f), b)
    if best[1] is None:
        return {node: (-1, 0, counts.tolist())}
    f, b = best[1]
    out = {node: (f, b, counts.tolist())}
    for i, s in enumerate((x[:, f] <= b, x[:, f] > b)):
        out |= _plain(x[s], y[s], w[s], tree, 2 * node + i, depth + 1, most, spec)
    return out


def test_trees_are_the_plain_recursion(spark, monkeypatch):
    """Blocks, tasks and passes of few counts change nothing; class weights and least rows hold."""
    rng = np.random.default_rng(0)
    spec = {"classes": 3, "n_features": 4, "take": 2, "least": 3, "seed": 7, "single": False, "weights": [0.5, 2.0, 1.0]}
    made = []
    for block in range(5):
        x = rng.integers(0, 6, (90, 4)).astype(np.uint8)
        y = np.where(rng.random(90) < 0.3, rng.integers(0, 3, 90), x[:, 0] // 2).astype(np.uint8)
        made.append((block, x, y))
    blocks = spark.createDataFrame([(b, 90, bytearray(x.tobytes()), bytearray(y.tobytes())) for b, x, y in made], "block long, n int, x binary, y binary")
    trees = lv.grow_levels(blocks.repartition(3), spec, 3, 5)
    monkeypatch.setattr(lv, "BYTES_PER_PASS", 2 * spec["take"] * 32 * 3 * 8)
    assert str(lv.grow_levels(blocks.coalesce(1), spec, 3, 5)) == str(trees)
    for t, got in enumerate(trees):
        w = np.concatenate([lv.bag(7, t, b, 90, False) for b, _, _ in made])
        want = _plain(np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made]), w, t, 1, 0, 5, spec)
        assert {n: (v[0], v[1] if v[0] >= 0 else 0, v[2].tolist()) for n, v in got.items()} == want and len(want) > 10


def test_bags_are_poisson():
    n = np.bincount(lv.bag(1, 2, 3, 400_000, False), minlength=6) / 400_000
    assert all(abs(n[j] - math.exp(-1) / math.factorial(j)) < 0.004 for j in range(6))
    assert lv.bag(1, 2, 3, 50, True).tolist() == [1] * 50


def test_a_model_as_mllib_fits_it(spark, table, by_levels, monkeypatch, tmp_path):
    """Stages, parameters, importances and votes are MLlib's, saved and loaded alike; null labels are left out."""
    from pyspark.ml import PipelineModel

    ours = forest.train_forest(table.withColumn("label_str", F.when(F.col("match_id") != 5, F.col("label_str"))), COLS, num_trees=40, max_depth=5)
    rf = ours.stages[-1]
    assert forest.label_order(ours) == ["A", "D", "H"] and rf.getNumTrees == 40 == len(rf.trees) and set(rf.treeWeights) == {1.0}
    assert rf.getMaxDepth() == 5 == max(t.depth for t in rf.trees) and all(t.numNodes > 5 for t in rf.trees)
    assert abs(sum(rf.featureImportances.toArray()) - 1) < 1e-9
    loaded = PipelineModel.load(forest.save_model(ours, str(tmp_path / "m")))
    scores = [sorted(forest.score_forest(m, table).collect()) for m in (ours, loaded)]
    assert scores[0] == scores[1] and len(scores[0]) == 1500
    monkeypatch.undo()
    theirs = forest.train_forest(table.na.fill(0.0), COLS, num_trees=40, max_depth=5)  # MLlib refuses nulls
    right = [forest.score_forest(m, table).join(table, "match_id").where("predicted = label_str").count() / 1500 for m in (ours, theirs)]
    assert min(right) > 0.8 and abs(right[0] - right[1]) < 0.04
    by_name = [dict(forest.feature_importance(m, COLS)) for m in (ours, theirs)]
    assert all(abs(by_name[0][c] - by_name[1][c]) < 0.12 for c in COLS)


def test_shallow_and_single_trees(table, by_levels):
    """A forest of depth 0 says the heaviest class of each bag; one tree takes every row once and tries all features."""
    flat = forest.train_forest(table, COLS, num_trees=3, max_depth=0)
    assert [t.numNodes for t in flat.stages[-1].trees] == [1, 1, 1]
    one = forest.train_forest(table, ["d"], num_trees=1, max_depth=3, balanced=False)
    counts = {r["label_str"]: r["count"] for r in table.groupBy("label_str").count().collect()}
    for r in forest.score_forest(one, table.where("d = 0").limit(1)).collect():
        n = {r["label_str"]: r["count"] for r in table.where("d = 0").groupBy("label_str").count().collect()}
        shares = [n[c] / sum(n.values()) for c in "ADH"] if one.stages[-1].trees[0].numNodes > 1 else [counts[c] / 1500 for c in "ADH"]
        assert r["p_away"] == pytest.approx(shares[0], abs=0.05)


def test_features_are_built_once_for_all_forest_queries(spark, by_levels, monkeypatch):
    """Training, scoring and fixtures read the features that were written once."""
    calls, build = [], form.build_features
    monkeypatch.setattr(form, "build_features", lambda *a, **kw: (calls.append(a), build(*a, **kw))[1])
    for name in ("_BUILT", "_TRAINED"):
        monkeypatch.setattr(queries_ml, name, {})
    monkeypatch.setattr(queries_ml, "FOREST_TREES", 3)
    assert queries_ml.q_score_forest(spark, SMALL).count() > 0
    assert queries_ml.q_score_fixtures(spark, SMALL).where("p_home is null").count() == 0
    assert queries_ml.q_feature_importance(spark, SMALL).count() == len(queries_ml.FEATURES)
    assert len(calls) == 1
