"""Registered queries: MLlib models.

Trained models are not bit-reproducible across engines, so their values have
no oracle SQL; what must hold of them has: the GLM's score equations and the
leak guard. ``tests/test_models.py`` asserts the other invariants (probabilities
sum to 1, labels named by the indexer, importances sum to 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, evaluate, forest, form, poisson
from ..session import scratch_path, written
from ..sources.tables import contests
from .catalog import register
from .oracle_sql import CONTESTS, with_ctes
from .queries_models import TEST_SEASON, predictions, split

FEATURES = form.feature_columns()
FOREST_TREES, FOREST_DEPTH = 200, 6  # documented configuration: 200 trees, depth 6


_BUILT: dict[tuple[str, str], DataFrame] = {}


def built_features(spark, sf_dir) -> DataFrame:
    """The contests with all features, written once per application: training, scoring and fixtures read the same rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = written(form.build_features(contests(spark, sf_dir)), "features")
    return _BUILT[key]


def _frames(spark, sf_dir):
    feats = forest.features_targets(built_features(spark, sf_dir), FEATURES)
    seasons = contests(spark, sf_dir).select("match_id", "season")
    x = feats.join(seasons, "match_id")
    return x.where(F.col("season") < TEST_SEASON), x.where(F.col("season") == TEST_SEASON)


_TRAINED: dict[tuple[str, str], object] = {}


def _forest(spark, sf_dir):
    """(model, train, test); the forest is fitted once per application."""
    train, test = _frames(spark, sf_dir)
    clean.leak_guard(FEATURES, form.feature_columns())
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        path = scratch_path(spark, "forest-train")
        train.write.parquet(path)
        _TRAINED[key] = forest.train_forest(spark.read.parquet(path), FEATURES, num_trees=FOREST_TREES, max_depth=FOREST_DEPTH)
    return _TRAINED[key], train, test


def _all_predictions(spark, sf_dir):
    """(predictions of the forest, the Poisson model and the constant; test matches)."""
    model, _, test = _forest(spark, sf_dir)
    ours = forest.score_forest(model, test).select("match_id", F.lit("forest").alias("model_name"), "p_home", "p_draw", "p_away")
    _, _, matches = split(spark, sf_dir)
    return predictions(spark, sf_dir).unionByName(ours), matches


_MLE: dict[tuple[str, str], object] = {}


def poisson_mle(spark, sf_dir):
    """(fit, train): the maximum-likelihood model of the training seasons, fitted once per application."""
    train = contests(spark, sf_dir).where(F.col("season") < TEST_SEASON)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MLE:
        _MLE[key] = poisson.fit_poisson_mle(train)
    return _MLE[key], train


@register("fit_poisson_glm")
def q_fit_poisson_glm(spark, sf_dir):
    """M1: maximum-likelihood Poisson model of every league on the training seasons; the terms by name."""
    return poisson.mle_terms(poisson_mle(spark, sf_dir)[0])


_TRAINING_GOALS = [("attack", "home_team", "home_goals"), ("attack", "away_team", "away_goals"),
                   ("defence", "home_team", "away_goals"), ("defence", "away_team", "home_goals"), ("home", "CAST(NULL AS VARCHAR)", "home_goals")]


@register("glm_score_equations", with_ctes(CONTESTS, body="SELECT league, side, team, CAST(sum(goals) AS BIGINT) AS goals, TRUE AS balanced FROM (\n"
                                           + "\nUNION ALL ".join(f"SELECT league, '{side}' AS side, {team} AS team, {goals} AS goals FROM contests WHERE season < '{TEST_SEASON}'"
                                                                 for side, team, goals in _TRAINING_GOALS) + "\n) GROUP BY league, side, team"))
def q_glm_score_equations(spark, sf_dir):
    """M1: the fitted model's score equations: observed and expected goals agree per team and side, and at home."""
    fit, train = poisson_mle(spark, sf_dir)
    return poisson.score_equations(train, fit)


@register("train_forest")
def q_train_forest(spark, sf_dir):
    """M5: random forest on the pre-match features (train seasons); one row per tree it grew."""
    model, train, _ = _forest(spark, sf_dir)
    rf = model.stages[-1]
    return spark.createDataFrame(
        [(i, int(t.numNodes), int(t.depth), float(w)) for i, (t, w) in enumerate(zip(rf.trees, rf.treeWeights, strict=True))],
        "tree int, nodes int, depth int, weight double")


@register("score_forest")
def q_score_forest(spark, sf_dir):
    """M6: predicted outcome and named class probabilities for every test-season match."""
    model, _, test = _forest(spark, sf_dir)
    return forest.score_forest(model, test)


@register("forest_showdown")
def q_forest_showdown(spark, sf_dir):
    """D10 + D14: the forest against the Poisson model on the test season, accuracy and Brier score."""
    return evaluate.model_showdown(evaluate.accuracy_brier(*_all_predictions(spark, sf_dir)), ("poisson", "forest"))


@register("forest_confusion")
def q_forest_confusion(spark, sf_dir):
    """Per model and actual class, the test matches and how often each class was predicted."""
    return evaluate.confusion_matrix(*_all_predictions(spark, sf_dir))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """All feature importances by name."""
    model, _, _ = _forest(spark, sf_dir)
    return spark.createDataFrame(forest.feature_importance(model, FEATURES), "feature string, importance double")


@register("top_features")
def q_top_features(spark, sf_dir):
    """T5: the ten most important features."""
    model, _, _ = _forest(spark, sf_dir)
    return forest.top_features(spark, model, FEATURES, 10)


@register("tune_forest")
def q_tune_forest(spark, sf_dir):
    """M9: the full grid (18 points, 5 folds) with cross-validation on accuracy; one row per grid point."""
    train, _ = _frames(spark, sf_dir)
    path = scratch_path(spark, "tune-train")
    train.write.parquet(path)
    cv = forest.tune_forest(spark.read.parquet(path), FEATURES)
    rows = []
    for params, metric in zip(cv.getEstimatorParamMaps(), cv.avgMetrics):
        named = {p.name: v for p, v in params.items()}
        rows.append((int(named["numTrees"]), int(named["maxDepth"]), int(named["minInstancesPerNode"]), float(metric)))
    return spark.createDataFrame(rows, "num_trees int, max_depth int, min_instances int, cv_accuracy double")


@register("save_model")
def q_save_model(spark, sf_dir):
    """Persist the fitted pipeline to the shared folder and load it back."""
    from pyspark.ml import PipelineModel

    model, _, test = _forest(spark, sf_dir)
    path = forest.save_model(model, scratch_path(spark, "forest-model"))
    loaded = PipelineModel.load(path)
    return forest.score_forest(loaded, test)


STATISTICS = ("home_goals", "away_goals", "home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "home_corners", "away_corners")
GUARDED = tuple(c for c in FEATURES if not c.startswith("elo_"))


@register("leak_guard", with_ctes(CONTESTS, body=f"""
SELECT league, f.feature, CAST(0 AS BIGINT) AS changed
FROM (SELECT DISTINCT league FROM contests),
     (SELECT unnest([{', '.join(repr(c) for c in GUARDED)}]) AS feature) f"""))
def q_leak_guard(spark, sf_dir):
    """V7: raise the statistics and flip the result of each league's last match; per league and feature the
    matches whose pre-match features change. Nothing follows a last match, so any change is a leak."""
    feats = set(form.feature_columns())
    clean.leak_guard([c for c in FEATURES if c in feats], feats)
    c = contests(spark, sf_dir)
    last = c.groupBy("league").agg(F.max_by("match_id", F.struct("match_datetime", "match_id")).alias("match_id")).select(
        "match_id", F.lit(True).alias("_bump"))
    marked = c.join(last, "match_id", "left")
    bumped = marked.select(*[F.when(F.col("_bump"), F.col(x) + 100).otherwise(F.col(x)).cast(c.schema[x].dataType).alias(x) if x in STATISTICS
                             else F.when(F.col("_bump"), F.when(F.col(x) == "H", "A").otherwise("H")).otherwise(F.col(x)).alias(x)
                             if x == "result" else F.col(x) for x in c.columns])
    before = form.build_features(c, with_elo=False).select("match_id", "league", *GUARDED)
    after = form.build_features(bumped, with_elo=False).select("match_id", *[F.col(x).alias(f"_{x}") for x in GUARDED])
    pairs = before.join(after, "match_id")
    counts = pairs.groupBy("league").agg(*[F.sum(F.when(F.col(x).eqNullSafe(F.col(f"_{x}")), 0).otherwise(1)).cast("long").alias(x) for x in GUARDED])
    return counts.select("league", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("changed")) for x in GUARDED])).alias("v")
                         ).select("league", "v.feature", "v.changed")


@register("score_fixtures")
def q_score_fixtures(spark, sf_dir):
    """M7 + M6 (batch scoring of every fixture): fixtures with thin history get the
    constant priors; the rest are scored by the forest from the home side's latest
    home form, the away side's latest away form and the latest Elo ratings."""
    from ..sources.tables import fixtures_from_contests

    c = contests(spark, sf_dir)
    model, _, _ = _forest(spark, sf_dir)
    fx = fixtures_from_contests(c)
    gates = forest.fixture_gates(fx, c)
    rows = forest.fixture_feature_rows(fx, built_features(spark, sf_dir), FEATURES)
    model_p = forest.score_forest(model, rows).drop("predicted", "match_id")
    out = gates.join(model_p, ["league", "fixture_id"], "left")
    model_gate = F.col("gate") == "model"
    return out.select("league", "fixture_id", "home_team", "away_team", "gate",
                      F.when(model_gate, F.col("p_home")).otherwise(F.col("prior_home")).alias("p_home"),
                      F.when(model_gate, F.col("p_draw")).otherwise(F.col("prior_draw")).alias("p_draw"),
                      F.when(model_gate, F.col("p_away")).otherwise(F.col("prior_away")).alias("p_away"))
