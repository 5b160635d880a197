"""Random-forest outcome model and fixture scoring.

Training and scoring run on MLlib (distributed tree induction; ``level_forest`` where rows are many), tuning on
its ``CrossValidator`` over ``GrownForest``. Features are the strictly pre-match allow-list from
``form.feature_columns`` (rolling form per side + Elo); same-match statistics
never enter the assembler (V7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import level_forest
from .perspective import team_perspective

# History gates and their constant (home, draw, away) priors, as in the reference.
MIN_TEAM_MATCHES = 5
MIN_COMBINED_MATCHES = 10
PRIOR_BOTH_NEW = (0.45, 0.25, 0.30)
PRIOR_HOME_NEW = (0.20, 0.25, 0.55)
PRIOR_AWAY_NEW = (0.65, 0.25, 0.10)
PRIOR_THIN = (0.45, 0.25, 0.30)
PRIOR_NO_SIDE = (0.45, 0.25, 0.30)
#: Training rows of one task: a row costs work in every tree and level, some thousand times what its bytes suggest.
ROWS_PER_TASK = 32768
#: Training rows beyond which a forest of ``LEVEL_DEPTH`` levels at most is grown by ``level_forest``.
LEVEL_ROWS = 1 << 18
LEVEL_DEPTH = 12


def features_targets(features: DataFrame, feature_cols: Sequence[str], label: str = "result") -> DataFrame:
    """The allow-listed numeric feature columns with NULL → 0, plus the label."""
    keep = [c for c in feature_cols if c in features.columns]
    return features.select("match_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in keep],
                           F.col(label).alias("label_str"))


def class_weights(train: DataFrame, label: str = "label_str") -> DataFrame:
    """Balanced class weights n / (classes · n_class): a 3-row table."""
    from pyspark.sql import Window

    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()  # over the class-count table: one row per class
    n, k = F.sum("n_class").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(label, (n / (k * F.col("n_class"))).alias("weight"))


def spread_rows(train: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``train`` dealt evenly to as many partitions as its rows need; few rows stay as they lie.

    MLlib takes the partitions it finds, and those follow file sizes: rows of a few bytes end up in one task,
    which then grows all trees and holds all bagged rows. ``train`` is read twice, so it should be stored."""
    parts = -(-train.count() // rows_per_task)
    return train.repartition(max(parts, train.rdd.getNumPartitions())) if parts > 1 else train


def train_forest(train: DataFrame, feature_cols: Sequence[str], num_trees: int = 200, max_depth: int = 6,
                 min_instances: int = 2, seed: int = 42, balanced: bool = True):
    """M5: ``Pipeline(StringIndexer(alphabetAsc), VectorAssembler, RandomForestClassifier)``.

    Documented defaults: 200 trees, depth 6; the coded variant is depth 15,
    min leaf 2, sqrt features, balanced weights. Spark has no min-split knob;
    a depth above 30 (MLlib's maximum) raises. Over more than ``LEVEL_ROWS`` rows the same
    kind of model is grown by ``level_forest``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    if max_depth > 30:
        raise ValueError("MLlib grows trees of depth 30 at most")
    indexer = StringIndexer(inputCol="label_str", outputCol="label", stringOrderType="alphabetAsc")
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_instances,
                                featureSubsetStrategy="sqrt", seed=seed)
    # 3 classes: the weight table has a fixed, tiny size.
    weights = class_weights(train) if balanced else None
    if balanced:
        rf.setWeightCol("weight")
    if max_depth <= LEVEL_DEPTH and train.count() > LEVEL_ROWS:
        return level_forest.fit(train, assembler, rf, {r[0]: r[1] for r in weights.collect()} if balanced else None)
    data = spread_rows(train)
    if balanced:
        data = data.join(F.broadcast(weights), "label_str")
    return Pipeline(stages=[indexer, assembler, rf]).fit(data)


def label_order(model) -> list[str]:
    return list(model.stages[0].labels)


def score_forest(model, rows: DataFrame) -> DataFrame:
    """M6: predicted label and per-class probabilities named by the indexer's
    label order (never by position — the reference's home/away swap, R1)."""
    from pyspark.ml.functions import vector_to_array

    labels = label_order(model)
    scored = model.transform(rows.withColumn("label_str", F.coalesce(F.col("label_str"), F.lit(labels[0])))
                             if "label_str" in rows.columns else rows.withColumn("label_str", F.lit(labels[0])))
    probs = vector_to_array("probability")
    name = {"H": "p_home", "D": "p_draw", "A": "p_away"}
    cols = [probs[i].alias(name.get(lab, f"p_{lab}")) for i, lab in enumerate(labels)]
    pred = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    keys = [c for c in ("league", "fixture_id", "match_id") if c in rows.columns]
    return scored.select(*keys, pred.alias("predicted"), *cols)


def feature_importance(model, feature_cols: Sequence[str]) -> list[tuple[str, float]]:
    """Importances zipped with the assembler's names (a model attribute — tiny)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(feature_cols, imp), key=lambda t: (-t[1], t[0]))


def top_features(spark, model, feature_cols: Sequence[str], k: int = 10) -> DataFrame:
    """T5: top-k feature importances as a DataFrame."""
    rows = feature_importance(model, feature_cols)
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def tune_forest(train: DataFrame, feature_cols: Sequence[str], trees=(50, 100, 200), depths=(30, 10, 20),
                min_instances=(2, 5), folds: int = 5, parallelism: int = 4, seed: int = 42):
    """M9: grid search with k-fold cross-validation on accuracy (MLlib CrossValidator).
    Defaults are the reference grid: trees {50, 100, 200} × depth {unlimited → 30, 10, 20}
    × {2, 5} (MLlib has no min-split knob; the minimum leaf size stands in).

    The forests are ``GrownForest``'s, whose trees never lie on the driver; ``train`` should be stored."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from .grown_forest import GrownForest

    rf = GrownForest(inputCols=feature_cols, labelCol="label_str", seed=seed)
    grid = (ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths))
            .addGrid(rf.minInstancesPerNode, list(min_instances)).build())
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(train)


def save_model(model, path: str) -> str:
    """Persist the fitted pipeline (labels and feature names live in its stages)."""
    model.write().overwrite().save(path)
    return path


def fixture_gates(fixtures: DataFrame, history: DataFrame) -> DataFrame:
    """M7 (gates): history counts per fixture and the constant prior when history is thin:
    both teams < 5 matches → .45/.25/.30; home < 5 → .20/.25/.55; away < 5 →
    .65/.25/.10; < 10 combined → .45/.25/.30; a home side without a home match or an away
    side without an away match → .45/.25/.30 (``no_side``); else ``model``."""
    per_team = team_perspective(history, stats=[]).groupBy("league", "team").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_home").cast("long")).alias("n_home"))
    a, b = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    pair = history.groupBy(F.col("league").alias("_league"), a.alias("ta"), b.alias("tb")).agg(F.count(F.lit(1)).alias("n_pair"))
    x = (fixtures
         .join(per_team.select("league", F.col("team").alias("home_team"), F.col("n").alias("nh"), F.col("n_home").alias("at_home")), ["league", "home_team"], "left")
         .join(per_team.select("league", F.col("team").alias("away_team"), F.col("n").alias("na"), (F.col("n") - F.col("n_home")).alias("at_away")), ["league", "away_team"], "left")
         .join(pair, (F.col("league") == F.col("_league")) & (F.least("home_team", "away_team") == F.col("ta"))
               & (F.greatest("home_team", "away_team") == F.col("tb")), "left"))
    nh, na = F.coalesce("nh", F.lit(0)).cast("long"), F.coalesce("na", F.lit(0)).cast("long")
    ne = nh + na - F.coalesce("n_pair", F.lit(0)).cast("long")
    gate = (F.when((nh < MIN_TEAM_MATCHES) & (na < MIN_TEAM_MATCHES), "both_new")
            .when(nh < MIN_TEAM_MATCHES, "home_new").when(na < MIN_TEAM_MATCHES, "away_new")
            .when(ne < MIN_COMBINED_MATCHES, "thin").when((F.col("at_home") == 0) | (F.col("at_away") == 0), "no_side").otherwise("model"))
    x = x.select("league", "fixture_id", "home_team", "away_team", nh.alias("n_home"), nh.alias("_nh"),
                 na.alias("n_away"), ne.alias("n_either"), gate.alias("gate"))
    priors = {"both_new": PRIOR_BOTH_NEW, "home_new": PRIOR_HOME_NEW, "away_new": PRIOR_AWAY_NEW, "thin": PRIOR_THIN, "no_side": PRIOR_NO_SIDE}
    outs = []
    for i, col in enumerate(("prior_home", "prior_draw", "prior_away")):
        e = None
        for g, p in priors.items():
            e = (F.when(F.col("gate") == g, F.lit(p[i])) if e is None else e.when(F.col("gate") == g, F.lit(p[i])))
        outs.append(e.alias(col))
    return x.select("league", "fixture_id", "home_team", "away_team", "n_home", "n_away", "n_either", "gate", *outs)


def promoted_prior(targets: DataFrame, strengths: DataFrame) -> DataFrame:
    """Teams without history (not in ``strengths``) get the league's
    bottom-quartile strength: 25th-percentile attack, 75th-percentile defence
    weakness (exact percentiles per league)."""
    teams = (targets.select("league", F.explode(F.array("home_team", "away_team")).alias("team")).distinct())
    q = strengths.groupBy("league").agg(F.percentile("attack", 0.25).alias("q_attack"),
                                        F.percentile("defence", 0.75).alias("q_defence"))
    s = strengths.select("league", "team", "attack", "defence", F.lit(False).alias("_known"))
    x = teams.join(s, ["league", "team"], "left").join(q, "league")
    return x.select("league", "team", F.col("_known").isNull().alias("promoted"),
                    F.round(F.coalesce("attack", "q_attack"), 6).alias("attack"),
                    F.round(F.coalesce("defence", "q_defence"), 6).alias("defence"))


def promoted_form(targets: DataFrame, latest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M11 (form): the latest form of every team of ``targets``; a team without a state (not in ``latest``: league,
    team, columns) gets the median of its league's states, column by column. ``promoted`` tells which; a team
    that has a state keeps it, nulls included."""
    teams = targets.select("league", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    # One state a team: the percentile holds as many values as a league has teams.
    medians = latest.groupBy("league").agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns])
    x = teams.join(latest.select("league", "team", *columns, F.lit(True).alias("_known")), ["league", "team"], "left").join(medians, "league", "left")
    new = F.col("_known").isNull()
    return x.select("league", "team", new.alias("promoted"), *[F.round(F.when(new, F.col(f"_m_{c}")).otherwise(F.col(c)), 6).alias(c) for c in columns])


def fixture_feature_rows(fixtures: DataFrame, wide: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """M7 (model path): one feature row per fixture from the home team's latest
    row as home side and the away team's latest row as away side (``max_by``, no
    sort): ``*_home`` columns come from the former, ``*_away`` from the latter, the
    rest are averaged over both; NULL → 0."""
    order = F.struct("match_datetime", "match_id")
    cols = [c for c in feature_cols if c in wide.columns]
    home_last = wide.groupBy("league", "home_team").agg(F.max_by(F.struct(*cols), order).alias("h"))
    away_last = wide.groupBy("league", "away_team").agg(F.max_by(F.struct(*cols), order).alias("a"))
    x = fixtures.join(home_last, ["league", "home_team"], "left").join(away_last, ["league", "away_team"], "left")

    def pick(c: str):
        if c.endswith("_home"):
            v = F.col(f"h.{c}")
        elif c.endswith("_away"):
            v = F.col(f"a.{c}")
        else:
            v = (F.col(f"h.{c}") + F.col(f"a.{c}")) / 2
        return F.coalesce(v.cast("double"), F.lit(0.0)).alias(c)

    return x.select("league", "fixture_id", "home_team", "away_team", *[pick(c) for c in cols])
