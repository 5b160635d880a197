from __future__ import annotations

import math
import zlib

from pyspark.sql import functions as F

from touchline.llm import quality
from tests.llm.fixtures import awkward_texts, docs, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_bounds(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(d, labels).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_never_read(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lied = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality"))
                             .otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality.score_quality(d, x).collect()) for x in (labels, lied))
    assert a == b


def test_column_expression_is_the_rule_sum(spark):
    model = quality.RuleModel(-0.3, ((quality.Rule((("digits", True, 0.1), ("lines", False, 2.0))), 1.5), (quality.Rule((("digits", False, 0.2),)), -0.7)))
    rows = [(0.0, 1.0), (0.15, 2.0), (0.3, 2.5), (0.3, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "digits double, lines double").select(model.score()).collect()]
    want = [1 / (1 + math.exp(-(-0.3 + (1.5 if x > 0.1 and y <= 2 else 0) + (-0.7 if x <= 0.2 else 0)))) for x, y in rows]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_awkward_rows_and_labels(spark):
    rows = awkward_texts()
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs(spark, rows), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty(spark), labels).count() == 0
    none = quality.score_quality(docs(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_statistics_of_odd_bytes():
    for body in (b"", b" \n", b"a", "é ñ".encode(), b"$$$ |", bytes(range(1, 256)) * 3):
        got = quality.statistics(body)
        assert len(got) == len(quality.STATISTICS) and all(math.isfinite(x) for x in got)
