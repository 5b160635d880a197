"""Invariants of the trained models on the smallest driver tables, with a small forest."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.operators import evaluate, forest, form
from touchline.plans import queries_ml
from touchline.sources.tables import contests


@pytest.fixture(scope="module")
def fitted(spark):
    train, test = queries_ml._frames(spark, SMALL)
    return forest.train_forest(train, queries_ml.FEATURES, num_trees=12, max_depth=5), test


def test_probabilities_and_labels(fitted):
    model, test = fitted
    assert forest.label_order(model) == ["A", "D", "H"]
    scored = forest.score_forest(model, test)
    assert scored.count() == test.count()
    best = F.greatest("p_home", "p_draw", "p_away")
    named = F.when(F.col("predicted") == "H", F.col("p_home")).when(F.col("predicted") == "D", F.col("p_draw")).otherwise(F.col("p_away"))
    assert scored.where((F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) > 1e-9) | (F.abs(named - best) > 1e-12)).count() == 0


def test_importances_and_saved_model(spark, fitted, tmp_path):
    from pyspark.ml import PipelineModel

    model, test = fitted
    got = forest.feature_importance(model, queries_ml.FEATURES)
    assert {n for n, _ in got} == set(form.feature_columns()) and abs(sum(v for _, v in got) - 1) < 1e-9
    assert [v for _, v in got] == sorted((v for _, v in got), reverse=True)
    top = forest.top_features(spark, model, queries_ml.FEATURES, 3).collect()
    assert [r.feature for r in top] == [n for n, _ in got[:3]]
    loaded = PipelineModel.load(forest.save_model(model, str(tmp_path / "m")))
    a, b = (sorted(forest.score_forest(m, test).collect()) for m in (model, loaded))
    assert a == b


def test_forest_in_the_evaluation(spark, fitted):
    model, test = fitted
    p = forest.score_forest(model, test).select("match_id", F.lit("forest").alias("model_name"), "p_home", "p_draw", "p_away")
    _, matches = evaluate.season_split(contests(spark, SMALL), queries_ml.TEST_SEASON)
    row = evaluate.accuracy_brier(p, matches).collect()[0]
    assert row.matches == matches.count() and 0 < row.accuracy < 1 and 0 < row.brier < 2


def test_tuning_covers_its_grid(spark):
    train, _ = queries_ml._frames(spark, SMALL)
    cv = forest.tune_forest(train, queries_ml.FEATURES, trees=(2, 3), depths=(2,), min_instances=(2,), folds=2)
    assert len(cv.avgMetrics) == 2 and all(0 < m <= 1 for m in cv.avgMetrics)


def test_registered_tuning_runs_the_full_grid(spark, monkeypatch):
    """18 grid points and 5 folds reach the cross-validation, over a written table."""
    from pyspark.ml.tuning import CrossValidator

    seen = []

    def fit(self, train):
        seen.append((self.getNumFolds(), train.inputFiles()))
        self.avgMetrics = [0.5] * len(self.getEstimatorParamMaps())
        return self

    monkeypatch.setattr(CrossValidator, "fit", fit)
    rows = queries_ml.q_tune_forest(spark, SMALL).collect()
    assert len({tuple(r)[:3] for r in rows}) == 18 == len(rows)
    assert {r.num_trees for r in rows} == {50, 100, 200} and {r.max_depth for r in rows} == {10, 20, 30}
    assert seen[0][0] == 5 and all("tune-train" in f for f in seen[0][1])


def test_training_rows_are_spread_by_number(spark):
    """Rows that lie in one partition are dealt evenly, each once; few rows stay as they lie."""
    rows = spark.range(0, 1000, 1, 1).withColumn("label_str", F.lit("H"))
    spread = forest.spread_rows(rows, rows_per_task=150)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) <= 150 and spread.distinct().count() == 1000
    assert forest.spread_rows(rows).rdd.getNumPartitions() == 1
    x = rows.select(F.when(F.col("id") % 3 == 0, "H").when(F.col("id") % 3 == 1, "D").otherwise("A").alias("label_str"), (F.col("id") % 7).cast("double").alias("a"))
    assert len(forest.train_forest(x, ["a"], num_trees=2, max_depth=2).stages[-1].trees) == 2
