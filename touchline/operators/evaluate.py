"""Held-out evaluation of outcome predictions.

Inputs are a predictions frame ``(match_id, model_name, p_home, p_draw,
p_away)`` and the matches with their actual ``result``. Every metric is a
grouped aggregate per model (and league where useful) with conditional sums,
so empty classes keep their zero counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import OUTCOMES, argmax_outcome, one_hot_outcome

# The reference's constant prior (home, draw, away) used as a baseline model.
HOME_BIAS_PRIOR = (0.45, 0.25, 0.30)


def season_split(df: DataFrame, test_season: str, mode: str = "before") -> tuple[DataFrame, DataFrame]:
    """train = seasons ``< test`` (``mode="before"``, lexicographic) or ``!= test``
    (``mode="other"``); test = ``== test``."""
    s = F.col("season")
    train = df.where(s < test_season) if mode == "before" else df.where(s != test_season)
    return train, df.where(s == test_season)


def date_split(df: DataFrame, boundary: str) -> tuple[DataFrame, DataFrame]:
    """P6 (by date): train before ``boundary``, test on/after."""
    b = F.lit(boundary).cast("timestamp_ntz")
    return df.where(F.col("match_datetime") < b), df.where(F.col("match_datetime") >= b)


def fraction_split(df: DataFrame, fraction: float = 0.8, seed: int = 42, chronological: bool = True):
    """80/20 split. Chronological: per league by position — a row trains when
    its percent rank (position − 1)/(n − 1) in (match_datetime, match_id) order is
    below ``fraction``; positions come from ``bounded_row_number`` (range slices,
    numbered once) and n from a grouped count. Random: a stable hash bucket of
    (seed, match_id) — the same row always lands on the same side."""
    if chronological:
        from ..session import scratch_path
        from .chunked import bounded_row_number

        numbered = bounded_row_number(df, ["league"], ["match_datetime", "match_id"], "_pos")
        sizes = df.groupBy("league").agg(F.count(F.lit(1)).alias("_n"))
        # Written once: both sides of the split read the same numbering.
        path = scratch_path(df.sparkSession, "positions")
        numbered.write.parquet(path)
        numbered = df.sparkSession.read.schema(numbered.schema).parquet(path)
        ranked = numbered.join(sizes, "league").withColumn(
            "_pr", F.when(F.col("_n") > 1, (F.col("_pos") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0)))
        flag = F.col("_pr") < fraction
        cols = df.columns
        return ranked.where(flag).select(*cols), ranked.where(~flag).select(*cols)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("match_id")), F.lit(100))
    return df.where(bucket < int(fraction * 100)), df.where(bucket >= int(fraction * 100))


def constant_predictions(matches: DataFrame, model_name: str = "home_bias",
                         prior: tuple[float, float, float] = HOME_BIAS_PRIOR) -> DataFrame:
    return matches.select("match_id", F.lit(model_name).alias("model_name"),
                          F.lit(prior[0]).alias("p_home"), F.lit(prior[1]).alias("p_draw"), F.lit(prior[2]).alias("p_away"))


def scored(predictions: DataFrame, matches: DataFrame, tie: str = "first", carry: Sequence[str] = ()) -> DataFrame:
    """Predictions joined to results (and the ``carry`` columns) with the predicted class (tie rule ``tie``)."""
    m = matches.select("match_id", "league", "season", "match_datetime", "result", *carry)
    return predictions.join(m, "match_id").withColumn("predicted", argmax_outcome("p_home", "p_draw", "p_away", tie))


def accuracy_brier(predictions: DataFrame, matches: DataFrame, tie: str = "first") -> DataFrame:
    """Per model: matches, accuracy, Brier = mean Σ(1{outcome} − p)²."""
    s = scored(predictions, matches, tie)
    oh, od, oa = one_hot_outcome("result")
    brier = (oh - F.col("p_home")) ** 2 + (od - F.col("p_draw")) ** 2 + (oa - F.col("p_away")) ** 2
    return s.groupBy("model_name").agg(
        F.count(F.lit(1)).cast("long").alias("matches"),
        F.round(F.avg(F.when(F.col("predicted") == F.col("result"), 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round(F.avg(brier), 6).alias("brier"),
    )


def outcome_distribution(predictions: DataFrame, matches: DataFrame, tie: str = "strict") -> DataFrame:
    """Counts of predicted and actual H/D/A per model (zeros kept)."""
    s = scored(predictions, matches, tie)
    aggs = [F.sum(F.when(F.col("predicted") == o, 1).otherwise(0)).cast("long").alias(f"predicted_{o}") for o in OUTCOMES]
    aggs += [F.sum(F.when(F.col("result") == o, 1).otherwise(0)).cast("long").alias(f"actual_{o}") for o in OUTCOMES]
    return s.groupBy("model_name").agg(*aggs)


def accuracy_by_type(predictions: DataFrame, matches: DataFrame, tie: str = "strict") -> DataFrame:
    """Per model and actual class: correct/total·100, ROUND 2, 0 when the class is empty."""
    s = scored(predictions, matches, tie)
    aggs = []
    for o in OUTCOMES:
        total = F.sum(F.when(F.col("result") == o, 1).otherwise(0))
        correct = F.sum(F.when((F.col("result") == o) & (F.col("predicted") == o), 1).otherwise(0))
        aggs.append(F.coalesce(F.round(F.try_divide(correct * 100.0, total), 2), F.lit(0.0)).alias(f"accuracy_{o}"))
    return s.groupBy("model_name").agg(*aggs)


def matchweek_accuracy(predictions: DataFrame, weeks: DataFrame, tie: str = "strict") -> DataFrame:
    """correct/total and percent (1 decimal) per (model, league, matchweek);
    ``weeks`` is W5's output (match_id, matchweek)."""
    s = scored(predictions, weeks, tie, carry=["matchweek"])
    hit = F.when(F.col("predicted") == F.col("result"), 1).otherwise(0)
    per_week = s.groupBy("model_name", "league", "matchweek").agg(
        F.sum(hit).cast("long").alias("correct"), F.count(F.lit(1)).cast("long").alias("total"),
        F.round(100.0 * F.avg(hit), 1).alias("accuracy_pct"))
    # the flat baseline drawn under every week: the model's overall accuracy (one row per model)
    overall = s.groupBy("model_name").agg(F.round(100.0 * F.avg(hit), 1).alias("baseline_pct"))
    return per_week.join(overall, "model_name")


def model_showdown(metrics: DataFrame, models: tuple[str, str]) -> DataFrame:
    """Side-by-side accuracy and Brier of two models, accuracy difference and winner / tie."""
    a, b = models
    wide = metrics.groupBy().pivot("model_name", list(models)).agg(
        F.first("accuracy").alias("accuracy"), F.first("brier").alias("brier"))
    diff = F.col(f"{a}_accuracy") - F.col(f"{b}_accuracy")
    return wide.select("*", F.round(100.0 * diff, 1).alias("accuracy_diff_pct"),
                       F.when(diff > 0, a).when(diff < 0, b).otherwise("tie").alias("winner"),
                       F.when(diff > 0, a).otherwise(b).alias("best_model"))


def home_baseline(matches: DataFrame) -> DataFrame:
    """Accuracy (%) of always predicting a home win, per league."""
    return matches.groupBy("league").agg(
        F.count(F.lit(1)).cast("long").alias("matches"),
        F.round(100.0 * F.avg(F.when(F.col("result") == "H", 1.0).otherwise(0.0)), 2).alias("home_win_pct"))


def confusion_matrix(predictions: DataFrame, matches: DataFrame, tie: str = "strict") -> DataFrame:
    """Counts per (model, actual, predicted)."""
    s = scored(predictions, matches, tie)
    return s.groupBy("model_name", F.col("result").alias("actual"), "predicted").agg(F.count(F.lit(1)).cast("long").alias("n"))


def class_report(predictions: DataFrame, matches: DataFrame, tie: str = "strict") -> DataFrame:
    """Precision, recall, F1 and support per (model, class)."""
    s = scored(predictions, matches, tie)
    aggs = []
    for o in OUTCOMES:
        aggs += [F.sum(F.when((F.col("predicted") == o) & (F.col("result") == o), 1).otherwise(0)).alias(f"tp_{o}"),
                 F.sum(F.when(F.col("predicted") == o, 1).otherwise(0)).alias(f"pred_{o}"),
                 F.sum(F.when(F.col("result") == o, 1).otherwise(0)).alias(f"support_{o}")]
    per_model = s.groupBy("model_name").agg(*aggs)  # one pass; classes unpivoted in-row below
    u = per_model.select("model_name", F.explode(F.array(*[
        F.struct(F.lit(o).alias("class"), F.col(f"tp_{o}").alias("tp"), F.col(f"pred_{o}").alias("pred_n"),
                 F.col(f"support_{o}").alias("support")) for o in OUTCOMES])).alias("r")).select("model_name", "r.*")
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return u.select("model_name", "class", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
                    F.round(f1, 6).alias("f1"), F.col("support").cast("long").alias("support"))


def profile(df: DataFrame, numeric: list[str], slices: int | None = None) -> DataFrame:
    """Per numeric column: rows, NULLs, mean, std, min, exact quartiles, max.

    One scan of ``df`` counts each (column, value); all else reads those counts. The ranks the
    quartiles need are found by running sums over range slices of the values, so a column of
    any number of distinct values is never held or sorted in one task."""
    from ..session import written
    from .chunked import range_slices

    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("v")
    counts = written(df.select(entries).select("v.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    v, n = F.col("value"), F.col("n")
    known = F.when(v.isNotNull(), n)
    base = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"),
                                        F.sum(known).alias("_n"), (F.sum(v * n) / F.sum(known)).alias("_mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    base = written(base, "profile")  # one row a column
    spread = counts.join(base.select("column", "_mean", "_n"), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))), F.max("_n") - 1)).alias("_std"))

    marked = range_slices(counts.where("value IS NOT NULL"), ["column"], ["value"], slices)
    earlier = Window.partitionBy("column").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("column", "_chunk").agg(F.sum("n").alias("_s")).select("column", "_chunk", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("column", "_chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_in", F.sum("n").over(inside)).join(starts, ["column", "_chunk"]).join(base.select("column", "_n"), "column").withColumn("_end", F.col("_start") + F.col("_in"))
    picks = []
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = (F.col("_n") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        here = lambda i: F.max(F.when((F.col("_end") > i) & (F.col("_end") - n <= i), v))
        picks.append((here(low) + (here(high) - here(low)) * F.max(at - low)).alias(name))
    quartiles = placed.groupBy("column").agg(*picks)
    out = base.join(spread, "column").join(quartiles, "column", "left")
    return out.select("column", "rows", "nulls", F.round("_mean", 6).alias("mean"), F.round("_std", 6).alias("std"), "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts of one column."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def simple_team_means(train: DataFrame, test: DataFrame) -> DataFrame:
    """Fallback features fitted on ``train`` only (never on the rows scored):
    per team, mean scored = (home scoring mean + away scoring mean)/2 and mean
    conceded likewise (1.0 when a side has no matches); mapped to both sides of
    every ``test`` match with default 1.0."""
    home = train.groupBy("league", F.col("home_team").alias("team")).agg(
        F.avg("home_goals").alias("hs"), F.avg("away_goals").alias("hc"))
    away = train.groupBy("league", F.col("away_team").alias("team")).agg(
        F.avg("away_goals").alias("as_"), F.avg("home_goals").alias("ac"))
    one = F.lit(1.0)
    stats = home.join(away, ["league", "team"], "full").select(
        "league", "team",
        ((F.coalesce("hs", one) + F.coalesce("as_", one)) / 2).alias("avg_goals_scored"),
        ((F.coalesce("hc", one) + F.coalesce("ac", one)) / 2).alias("avg_goals_conceded"))
    h = stats.select("league", F.col("team").alias("home_team"), F.col("avg_goals_scored").alias("home_avg_goals_scored"),
                     F.col("avg_goals_conceded").alias("home_avg_goals_conceded"))
    a = stats.select("league", F.col("team").alias("away_team"), F.col("avg_goals_scored").alias("away_avg_goals_scored"),
                     F.col("avg_goals_conceded").alias("away_avg_goals_conceded"))
    out = test.join(h, ["league", "home_team"], "left").join(a, ["league", "away_team"], "left")
    cols = ["home_avg_goals_scored", "home_avg_goals_conceded", "away_avg_goals_scored", "away_avg_goals_conceded"]
    return out.select(*[c for c in out.columns if c not in cols], *[F.round(F.coalesce(c, one), 6).alias(c) for c in cols])
