"""MLlib's forest for many rows, its trees split level by level from counts (M5).

MLlib's own training (some 3 µs a row, tree and core for six levels, reckoned) keeps a number a row and tree. Here the
features become bins once, written as blocks of rows (as ``GrownForest``'s). Each level is one pass over the blocks:
a task draws every tree's bag of its blocks anew from (seed, tree, block), walks the drawn rows down the tree and
counts classes by node, feature and bin. The tasks' counts are added up by tree, each node takes its best cut
(Gini gain under the class weights, a random feature subset a node, least rows a child), and the next level follows.
A task holds ``BYTES_PER_PASS`` of counts at most: more nodes take more passes. The driver holds the trees alone,
which MLlib's model does too: they are written in its format and read back as a ``RandomForestClassificationModel``.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .grown_forest import MAX_BINS, GrownForest, node_features

#: Rows of one task of a pass.
ROWS_PER_TASK = 1 << 18
#: Counts that one task holds.
BYTES_PER_PASS = 64 << 20

#: A draw of 2**32 is drawn as often as there are numbers here that it reaches: Poisson of mean 1.
_POISSON = np.array([min(2**32 - 1, round(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1)))) for j in range(12)])
#: The same by the upper half of a draw; 255 where the lower half decides.
_BY_HALF = np.searchsorted(_POISSON, np.arange(1 << 16) << 16, side="right").astype(np.uint8)
_BY_HALF[np.searchsorted(_POISSON, (np.arange(1 << 16) << 16) + 65535, side="right") != _BY_HALF] = 255


def bag(seed: int, tree: int, block: int, n: int, single: bool) -> np.ndarray:
    """How often each row of a block is drawn for a tree; a forest of one tree takes each row once, as MLlib's does."""
    if single:
        return np.ones(n, np.uint8)
    draws = np.random.default_rng([seed & (2**64 - 1), tree, block])
    u = draws.integers(0, 1 << 16, n, dtype=np.uint16)
    w = _BY_HALF.take(u)
    open_ = np.flatnonzero(w == 255)
    w[open_] = np.searchsorted(_POISSON, (u[open_].astype(np.int64) << 16) + draws.integers(0, 1 << 16, len(open_)), side="right")
    return w


def _heap(nodes: dict, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) by node number above ``depth``; below a leaf all rows go left."""
    feature, at = np.zeros(1 << depth, np.int64), np.full(1 << depth, 255, np.uint8)
    for node, (f, b, *_) in nodes.items():
        if f >= 0:
            feature[node], at[node] = f, b
    return feature, at


def _counts(spec: dict, trees: dict, depth: int):
    """Per task and tree: the classes of the drawn rows by feature of the subset, active node and bin."""
    k, n, take = spec["classes"], spec["n_features"], spec["take"]

    def run(batches):
        sums, by_tree = {}, {}
        for tree, (feature, at, active) in trees.items():
            slot = np.full(2 << depth, -1, np.int64)
            slot[active] = np.arange(len(active))
            by_tree[tree] = feature, at, slot, np.ascontiguousarray(node_features(spec["seed"], tree, active, n, take).T), len(active)
            sums[tree] = np.zeros((take, len(active) * MAX_BINS * k))
        seen = False
        for pdf in batches:
            for block, size, raw, labels in zip(pdf["block"], pdf["n"], pdf["x"], pdf["y"]):
                x, y, first = np.frombuffer(raw, np.uint8), np.frombuffer(labels, np.uint8).astype(np.int64), np.arange(size) * n
                xk, seen = x.astype(np.uint16) * np.uint16(k), True
                for tree, (feature, at, slot, subset, m) in by_tree.items():
                    w = bag(spec["seed"], tree, block, size, spec["single"])
                    rows = np.flatnonzero(w != 0)
                    off, node = first.take(rows), np.ones(len(rows), np.int64)
                    for _ in range(depth):
                        node = 2 * node + (x.take(off + feature.take(node)) > at.take(node))
                    s = slot.take(node)
                    if m < 1 << depth:
                        live = np.flatnonzero(s >= 0)
                        rows, off, s = rows.take(live), off.take(live), s.take(live)
                    key, w = s * (MAX_BINS * k) + y.take(rows), w.take(rows).astype(np.float64)
                    for j in range(take):
                        sums[tree][j] += np.bincount(key + xk.take(off + subset[j].take(s)), weights=w, minlength=m * MAX_BINS * k)
        if seen:
            for tree, h in sums.items():
                yield pd.DataFrame({"tree": [tree], "counts": [h.astype(np.int32).tobytes()]})
    return run


def best_cuts(h: np.ndarray, weights: np.ndarray, least: int):
    """Counts (features, nodes, bins, classes) to each node's (gain, feature's place, bin, left counts, all counts);
    no valid cut: gain 0."""
    left = h.cumsum(axis=2)
    whole = left[:, :, -1]
    left = left[:, :, :-1]
    right = whole[:, :, None] - left
    fits = (left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least)

    def purity(c):
        c = c * weights
        total = c.sum(axis=-1)
        return (c * c).sum(axis=-1) / np.maximum(total, 1e-300), total

    (pl, _), (pr, _), (pw, total) = purity(left), purity(right), purity(whole)
    gain = np.where(fits, (pl + pr - pw[:, :, None]) / np.maximum(total, 1e-300)[:, :, None], 0.0)
    features, nodes, bins = gain.shape
    flat = gain.transpose(1, 0, 2).reshape(nodes, -1)
    pick = flat.argmax(axis=1)
    j, b, i = pick // bins, pick % bins, np.arange(nodes)
    best = np.where(flat[i, pick] > 1e-12, flat[i, pick], 0.0)
    return best, j, b, left[j, i, b], whole[0]


def _split(spec: dict, active: dict):
    """The best cuts of a tree's active nodes from the tasks' counts."""
    k, take, weights = spec["classes"], spec["take"], np.array(spec["weights"])

    def run(key, pdf):
        tree = int(key[0])
        nodes = active[tree]
        h = np.zeros(take * len(nodes) * MAX_BINS * k, np.int64)
        for raw in pdf["counts"]:
            h += np.frombuffer(raw, np.int32)
        gain, j, b, left, whole = best_cuts(h.reshape(take, len(nodes), MAX_BINS, k), weights, spec["least"])
        subset = node_features(spec["seed"], tree, nodes, spec["n_features"], take)
        f = np.where(gain > 0, subset[np.arange(len(nodes)), j], -1)
        return pd.DataFrame({"tree": tree, "node": nodes, "feature": f, "bin": b, "gain": gain, "left": left.tolist(), "whole": whole.tolist()})
    return run


def grow_levels(blocks: DataFrame, spec: dict, num_trees: int, max_depth: int) -> list[dict]:
    """Per tree {node: (feature or -1, bin, counts, gain)}; the root is 1, a node's children 2i and 2i + 1."""
    k, per_node = spec["classes"], spec["take"] * MAX_BINS * spec["classes"] * 8
    trees = [{} for _ in range(num_trees)]
    active = {t: [1] for t in range(num_trees)}
    for depth in range(max_depth + 1):
        # At the greatest depth only a root is still to be counted: other leaves know their rows from the cut above.
        if not active or (depth == max_depth and depth):
            break
        found, todo = [], sorted((t, n) for t in active for n in active[t])
        at_once = max(1, BYTES_PER_PASS // per_node)
        for i in range(0, len(todo), at_once):
            some = {}
            for t, n in todo[i:i + at_once]:
                some.setdefault(t, []).append(n)
            nodes = {t: np.array(ns, np.int64) for t, ns in some.items()}
            counts = blocks.mapInPandas(_counts(spec, {t: (*_heap(trees[t], depth), nodes[t]) for t in nodes}, depth), "tree int, counts binary")
            found += counts.groupBy("tree").applyInPandas(
                _split(spec, nodes), "tree int, node long, feature int, bin int, gain double, left array<long>, whole array<long>").collect()
        active = {}
        for r in found:
            left, whole = np.array(r["left"]), np.array(r["whole"])
            f = r["feature"] if depth < max_depth else -1
            trees[r["tree"]][r["node"]] = (f, r["bin"], whole, r["gain"])
            if f >= 0:
                for child, c in ((2 * r["node"], left), (2 * r["node"] + 1, whole - left)):
                    if depth + 1 < max_depth and (c > 0).sum() > 1 and c.sum() >= 2 * spec["least"]:
                        active.setdefault(r["tree"], []).append(child)
                    else:
                        trees[r["tree"]][child] = (-1, 0, c, 0.0)
    return trees


_NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
          "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def _rows(tree: int, nodes: dict, cuts: Sequence[np.ndarray], weights: np.ndarray) -> list:
    """A tree's rows of MLlib's format, from the root down, left side first; sibling leaves of one prediction are merged."""
    said, leaf = {}, {}
    for node in sorted(nodes, reverse=True):
        said[node] = int((nodes[node][2] * weights).argmax())
        sides = (2 * node, 2 * node + 1)
        leaf[node] = nodes[node][0] < 0 or (all(leaf[c] for c in sides) and said[sides[0]] == said[sides[1]])
    out = []

    def add(node: int) -> int:
        f, b, counts, gain = nodes[node]
        stats = counts * weights
        at = len(out)
        gini = 1 - float(((stats / stats.sum()) ** 2).sum()) if stats.sum() else 0.0
        out.append(None)
        sides, cut = (-1, -1), (-1, [], -1)
        if leaf[node]:
            gain = -1.0
        else:
            sides, cut = (add(2 * node), add(2 * node + 1)), (int(f), [float(cuts[f][b])], -1)
        out[at] = (tree, (at, float(said[node]), gini, stats.tolist(), int(counts.sum()), float(gain), *sides, cut))
        return at

    add(1)
    return out


def mllib_model(spark, rf, trees: Sequence[dict], cuts: Sequence[np.ndarray], weights: np.ndarray):
    """The trees as the model that the classifier ``rf`` would have fitted: written in MLlib's format and loaded."""
    from pyspark.ml.classification import RandomForestClassificationModel

    def metadata(cls: str, uid: str, drop: Sequence[str] = (), **more) -> str:
        params = [{p.name: v for p, v in m.items() if p.name not in drop} for m in (rf._paramMap, rf._defaultParamMap)]
        return json.dumps({"class": f"org.apache.spark.ml.classification.{cls}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": params[0], "defaultParamMap": params[1], **more})

    path, forest_only = scratch_path(spark, "forest-levels"), ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
    rows = [r for t, nodes in enumerate(trees) for r in _rows(t, nodes, cuts, weights)]
    spark.createDataFrame(rows, _NODES).write.parquet(f"{path}/data")
    each = [(t, metadata("DecisionTreeClassificationModel", f"dtc_{rf.uid}_{t}", forest_only), 1.0) for t in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = metadata("RandomForestClassificationModel", rf.uid, numFeatures=len(cuts), numClasses=len(weights), numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def fit(train: DataFrame, assembler, rf, weights: Mapping[str, float] | None = None) -> PipelineModel:
    """What ``Pipeline(label indexer, assembler, rf)`` fits, for a classifier of the square root of the features a node,
    its draws apart. With ``weights`` (by label) rows without a label are left out, as a join with them would."""
    spark, single = train.sparkSession, rf.getNumTrees() == 1
    data = train if weights is None else train.where(F.col("label_str").isNotNull())
    indexer, cuts, blocks, n = GrownForest(assembler.getInputCols(), "label_str")._blocks(data)
    cw = np.array([1.0 if weights is None else float(weights[label]) for label in indexer.labels])
    f = len(cuts)
    spec = {"classes": len(indexer.labels), "n_features": f, "take": f if single else int(np.ceil(np.sqrt(f))), "least": rf.getMinInstancesPerNode(),
            "seed": rf.getSeed(), "single": single, "weights": cw.tolist()}
    tasks = max(-(-n // ROWS_PER_TASK), min(spark.sparkContext.defaultParallelism, -(-n // 8192)))
    trees = grow_levels(blocks.repartition(tasks), spec, rf.getNumTrees(), rf.getMaxDepth())
    return PipelineModel([indexer, assembler, mllib_model(spark, rf, trees, cuts, cw)])
