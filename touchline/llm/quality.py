"""Operator 8: quality classifier as a sparse rule ensemble.

1. One map pass turns every whole text into a few statistics.
2. Boosted shallow trees are grown on labelled rows; every path from a root to
   a node becomes a rule, a conjunction of ``statistic <= t`` or ``> t``.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The rules that are left are compiled into one Spark column expression that
   scores every document from its statistics.

Fitting takes at most ``max_rows`` labelled rows, the smallest by a hash of
the id (a documented bound of the fit; everything else covers all rows).

Defined results: null or empty text has all statistics zero and is scored like
any other; labels that are null are ignored; an id labelled twice counts with
its larger label; without labels of both kinds every document gets the smoothed
share of good labels; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialize, text_hash, texts

STATISTICS = ("log_bytes", "log_words", "mean_word", "distinct_words", "repeated_next", "top_word", "punctuation",
              "symbols", "digits", "capitals", "beyond_ascii", "bare_symbol_words", "lines", "repeated_lines",
              "mean_line", "capital_words", "punctuated_words", "longest_word")
#: Labelled rows a fit may take.
MAX_ROWS = 20_000

_IS = {name: np.array([b in chars for b in range(256)]) for name, chars in {
    "punctuation": b".,;:!?'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "digits": b"0123456789",
    "capitals": bytes(range(65, 91)), "beyond": bytes(range(128, 256))}.items()}


def statistics(body: bytes) -> list[float]:
    """The numbers of one text, in the order of STATISTICS."""
    words = body.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(body)
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    share = {k: float(count[m].sum()) / size for k, m in _IS.items()}
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in body.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [math.log1p(size), math.log1p(n), size / n, len(seen) / n, same / n, max(seen.values()) / n,
            share["punctuation"], share["symbols"], share["digits"], share["capitals"], share["beyond"],
            sum(c for w, c in seen.items() if not w.isalnum() and w.isascii() and not any(map(_ALNUM.__getitem__, w))) / n,
            math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines),
            sum(c for w, c in seen.items() if w[:1].isupper()) / n, sum(c for w, c in seen.items() if w[-1] in b".,;:!?") / n,
            math.log1p(max(map(len, seen)))]


_ALNUM = [chr(b).isalnum() if b < 128 else True for b in range(256)]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, one double column per statistic) by one map pass over whole texts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        for b in frames:
            m = np.array([statistics(x) for x in b.column("body").to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *[pa.array(m[:, i]) for i in range(m.shape[1])]],
                                             names=["doc_id", "text_hash", *STATISTICS])

    hashed = texts(docs, id_col, text_col).withColumn("text_hash", text_hash("body"))
    return hashed.mapInArrow(run, f"doc_id {id_type}, text_hash long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above?, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.terms:
            out = out & (F.col(name) > F.lit(t) if above else F.col(name) <= F.lit(t))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of a good text as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(model) -> list[Rule]:
    """Every path of every tree, tightened so that a statistic occurs once for each side."""
    out: dict[Rule, None] = {}

    def walk(node, path):
        if path:
            out[Rule(tuple(sorted((STATISTICS[f], above, t) for (f, above), t in path.items())))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            f, t = node.split().featureIndex(), float(node.split().threshold())
            walk(node.leftChild(), path | {(f, False): min(t, path.get((f, False), math.inf))})
            walk(node.rightChild(), path | {(f, True): max(t, path.get((f, True), -math.inf))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(out)


def fit(rows: DataFrame, label_col: str = "label", trees: int = 16, depth: int = 3, lasso: float = 0.001,
        seed: int = 7) -> RuleModel:
    """Fit on a bounded, materialised table of statistics and a 0/1 label."""
    count = {int(r[0]): r[1] for r in rows.groupBy(label_col).count().collect()}
    if len(count) < 2:
        good, n = count.get(1, 0), sum(count.values())
        return RuleModel(math.log((good + 1) / (n - good + 1)), ())
    vec = rows.select(array_to_vector(F.array(*STATISTICS)).alias("x"), F.col(label_col).cast("double").alias("y"), *STATISTICS)
    rules = tree_rules(GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed,
                                     minInstancesPerNode=10).fit(vec))
    if not rules:
        return RuleModel(math.log((count[1] + 1) / (count[0] + 1)), ())
    fired = vec.select("y", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("z"))
    lr = LogisticRegression(featuresCol="z", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, lr.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lr.intercept), tuple(weights))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, max_rows: int = MAX_ROWS,
                  label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the held-out fold's labels are never read.

    ``by_text`` adds text_hash, which tells rows that share an id apart.
    """
    stats = materialize(text_statistics(docs, id_col, text_col), "quality-statistics")
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_fold))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = materialize(stats.join(chosen, "doc_id").repartition(4, "doc_id").sortWithinPartitions("doc_id", *STATISTICS),
                         "quality-sample")
    model = fit(sample)
    return stats.select("doc_id", *(["text_hash"] if by_text else []), (crc_fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), model.score().alias("score")
                        ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
