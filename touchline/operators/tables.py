"""League tables, head-to-head, season summaries and the stored-prediction
and market queries (D1–D6, W1, W2, J4, J9, J10, J12, T4).

All operators work on every league and season at once. Aggregates are
``groupBy`` with map-side partial aggregation, so a hot team or pairing is
combined before the shuffle. Rankings are windows partitioned by
(league, season) — never an unpartitioned ``ROW_NUMBER``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correct_any_max, market_favourite, pair_key
from .chunked import bounded_window, last_rows
from .perspective import team_perspective


def _sum_int(c) -> F.Column:
    return F.sum(c).cast("long")


def team_season_goals(contests: DataFrame) -> DataFrame:
    """Matches, goals for and against per (league, season, team)."""
    long = team_perspective(contests, stats=[])
    return long.groupBy("league", "season", "team").agg(
        F.count(F.lit(1)).cast("long").alias("matches"),
        _sum_int("goals_scored").alias("goals_for"),
        _sum_int("goals_conceded").alias("goals_against"),
    )


def league_table_asof(contests: DataFrame, asof: str | None = None) -> DataFrame:
    """D2 + W1: points, goal difference and position per (league, season, team)
    over matches dated ``<= asof`` (all when None); position by points ↓,
    goal difference ↓, team ↑ within (league, season)."""
    src = contests if asof is None else contests.where(F.col("match_datetime") <= F.lit(asof).cast("timestamp_ntz"))
    long = team_perspective(src, stats=[])
    agg = long.groupBy("league", "season", "team").agg(
        F.count(F.lit(1)).cast("long").alias("played"),
        _sum_int("points").alias("total_points"),
        _sum_int(F.col("goals_scored") - F.col("goals_conceded")).alias("goals_difference"),
    )
    return table_position(agg)


def table_position(agg: DataFrame, points: str = "total_points", gd: str = "goals_difference") -> DataFrame:
    """ROW_NUMBER over aggregated sums, per (league, season)."""
    w = Window.partitionBy("league", "season").orderBy(F.col(points).desc(), F.col(gd).desc(), F.col("team").asc())
    return agg.withColumn("position", F.row_number().over(w).cast("long"))


def head_to_head(contests: DataFrame) -> DataFrame:
    """D3 (batch form): for every pairing {a, b} with a < b: matches, wins of a,
    draws, wins of b, goals of a, goals of b — grouped by the order-free pair key."""
    a, b = pair_key("home_team", "away_team")
    a_home = F.col("home_team") == F.col("team_a")
    hg, ag, r = F.col("home_goals"), F.col("away_goals"), F.col("result")
    keyed = contests.select(a.alias("team_a"), b.alias("team_b"), "home_team", "home_goals", "away_goals", "result")
    return keyed.groupBy("team_a", "team_b").agg(
        F.count(F.lit(1)).cast("long").alias("total_matches"),
        _sum_int(F.when((a_home & (r == "H")) | (~a_home & (r == "A")), 1).otherwise(0)).alias("team_a_wins"),
        _sum_int(F.when(r == "D", 1).otherwise(0)).alias("draws"),
        _sum_int(F.when((~a_home & (r == "H")) | (a_home & (r == "A")), 1).otherwise(0)).alias("team_b_wins"),
        _sum_int(F.when(a_home, hg).otherwise(ag)).alias("team_a_goals"),
        _sum_int(F.when(a_home, ag).otherwise(hg)).alias("team_b_goals"),
    )


def head_to_head_pair(contests: DataFrame, team_a: str, team_b: str) -> DataFrame:
    """D3 / J12 (single pair, the reference's parameterised query): one row;
    COUNT is 0 and the SUMs NULL when the teams never met."""
    pair = contests.where(
        ((F.col("home_team") == team_a) & (F.col("away_team") == team_b))
        | ((F.col("home_team") == team_b) & (F.col("away_team") == team_a))
    )
    a_home = F.col("home_team") == team_a
    r = F.col("result")
    return pair.agg(
        F.count(F.lit(1)).cast("long").alias("total_matches"),
        _sum_int(F.when((a_home & (r == "H")) | (~a_home & (r == "A")), 1).otherwise(0)).alias("team_a_wins"),
        _sum_int(F.when(r == "D", 1).otherwise(0)).alias("draws"),
        _sum_int(F.when((~a_home & (r == "H")) | (a_home & (r == "A")), 1).otherwise(0)).alias("team_b_wins"),
        _sum_int(F.when(a_home, F.col("home_goals")).otherwise(F.col("away_goals"))).alias("team_a_goals"),
        _sum_int(F.when(a_home, F.col("away_goals")).otherwise(F.col("home_goals"))).alias("team_b_goals"),
    )


def head_to_head_matches(contests: DataFrame) -> DataFrame:
    """Each match tagged with its order-free pairing key (team_a < team_b),
    ready for an equi join or a pair filter."""
    a, b = pair_key("home_team", "away_team")
    return contests.select("match_id", "league", "season", "match_datetime", a.alias("team_a"), b.alias("team_b"),
                           "home_team", "away_team", "home_goals", "away_goals", "result")


def team_season_summary(contests: DataFrame) -> DataFrame:
    """Played, wins, draws, losses, goals for/against per (league, season, team).
    The reference joins ``teams ON home = id OR away = id``; here the long frame
    makes that an equi grouping (no nested-loop join)."""
    long = team_perspective(contests, stats=[])
    h, r = F.col("is_home"), F.col("result")
    win = (h & (r == "H")) | (~h & (r == "A"))
    loss = (h & (r == "A")) | (~h & (r == "H"))
    return long.groupBy("league", "season", "team").agg(
        F.count(F.lit(1)).cast("long").alias("matches_played"),
        _sum_int(F.when(win, 1).otherwise(0)).alias("wins"),
        _sum_int(F.when(r == "D", 1).otherwise(0)).alias("draws"),
        _sum_int(F.when(loss, 1).otherwise(0)).alias("losses"),
        _sum_int("goals_scored").alias("goals_for"),
        _sum_int("goals_conceded").alias("goals_against"),
    )


def team_or_join(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """``matches ⋈ teams ON home_team_id = t.id OR away_team_id = t.id`` as an
    equi join of the two-sided explode against the team dimension."""
    sides = matches.select(
        "id", "season_id",
        F.explode(F.array(
            F.struct(F.col("home_team_id").alias("team_id"), F.lit(True).alias("is_home")),
            F.struct(F.col("away_team_id").alias("team_id"), F.lit(False).alias("is_home")),
        )).alias("s"),
    ).select(F.col("id").alias("match_id"), "season_id", "s.team_id", "s.is_home")
    return sides.join(teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name")), "team_id")


def points_last_n(contests: DataFrame, n: int = 5) -> DataFrame:
    """For every (league, team) match, the points of that match and the sum
    over it and the ``n-1`` before it (ROWS n-1 PRECEDING .. CURRENT ROW),
    ordered by (match_datetime, match_id). Hot teams are cut into range slices."""
    long = team_perspective(contests, stats=[]).select("league", "team", "match_datetime", "match_id", "points")
    specs = {f"points_last_{n}_matches": lambda w: F.sum("points").over(w.rowsBetween(-(n - 1), 0)).cast("long")}
    out = bounded_window(long, ["league", "team"], ["match_datetime", "match_id"], specs, lookback=n - 1,
                         carry=["points"])
    return out.select("league", "team", "match_id", "match_datetime",
                      F.col("points").cast("long").alias("points_for_match"), f"points_last_{n}_matches")


def latest_points_last_n(contests: DataFrame, before: str, n: int = 5) -> DataFrame:
    """T4 / W2 latest form: per (league, team), the most recent match strictly
    before ``before`` and its points over the last ``n`` matches. Only each team's
    last ``n`` rows are kept and summed; its history is not rolled."""
    src = contests.where(F.col("match_datetime") < F.lit(before).cast("timestamp_ntz"))
    long = team_perspective(src, stats=[]).select("league", "team", "match_datetime", "match_id", "points")
    latest = F.max_by(F.struct("match_datetime", "match_id", F.col("points").cast("long").alias("points_for_match")),
                      F.struct("match_datetime", "match_id"))
    return last_rows(long, ["league", "team"], ["match_datetime", "match_id"], n).groupBy("league", "team").agg(
        latest.alias("last"), F.sum("points").cast("long").alias(f"points_last_{n}_matches")
    ).select("league", "team", "last.*", f"points_last_{n}_matches")


def predictions_vs_actual(predictions: DataFrame, matches: DataFrame, top_scores: DataFrame) -> DataFrame:
    """Predictions ⋈ matches LEFT JOIN top score (rank 1) on (match, model).
    The rank filter sits on the right side before the join."""
    top1 = top_scores.where(F.col("rank_order") == 1).select(
        "match_id", "model_name", F.col("home_goals").alias("top_home"), F.col("away_goals").alias("top_away"))
    m = matches.select("match_id", F.col("result").alias("actual_result"),
                       F.col("home_goals").alias("actual_home_goals"), F.col("away_goals").alias("actual_away_goals"))
    return predictions.join(m, "match_id").join(top1, ["match_id", "model_name"], "left")


def model_accuracy(predictions: DataFrame, matches: DataFrame, top_scores: DataFrame) -> DataFrame:
    """Per model: matches, result accuracy % (the ``>=`` tie rule), exact-score
    accuracy % of the top-ranked scoreline, both ROUND 2."""
    ev = predictions_vs_actual(predictions, matches, top_scores).select(
        "model_name",
        correct_any_max("prob_home_win", "prob_draw", "prob_away_win", "actual_result").alias("correct_result"),
        F.when((F.col("top_home") == F.col("actual_home_goals")) & (F.col("top_away") == F.col("actual_away_goals")), 1)
        .otherwise(0).alias("correct_top_score"),
    )
    return ev.groupBy("model_name").agg(
        F.count(F.lit(1)).cast("long").alias("total_matches"),
        F.round(100 * F.avg("correct_result"), 2).alias("result_accuracy_pct"),
        F.round(100 * F.avg("correct_top_score"), 2).alias("top_score_accuracy_pct"),
    )


def odds_vs_actual(odds: DataFrame, matches: DataFrame,
                   cols: tuple[str, str, str] = ("home_odds", "draw_odds", "away_odds")) -> DataFrame:
    """J10 + H7: odds ⋈ matches with the market favourite (NULL when any odds missing)."""
    m = matches.select("match_id", F.col("result").alias("actual_result"))
    return odds.join(m, "match_id").select(
        "match_id", "actual_result", market_favourite(*cols).alias("market_predicted_result"))


def market_accuracy(odds: DataFrame, matches: DataFrame,
                    cols: tuple[str, str, str] = ("home_odds", "draw_odds", "away_odds"),
                    by_league: bool = False) -> DataFrame:
    """Count, correct and accuracy % of the market favourite over matches with full odds."""
    ev = odds_vs_actual(odds, matches, cols).where(F.col("market_predicted_result").isNotNull())
    keys = []
    if by_league:
        ev = ev.join(matches.select("match_id", "league"), "match_id")
        keys = ["league"]
    hit = F.when(F.col("market_predicted_result") == F.col("actual_result"), 1).otherwise(0)
    return ev.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("total_matches_with_market_data"),
        _sum_int(hit).alias("market_correct_predictions"),
        F.round(100 * F.avg(hit), 2).alias("market_accuracy_pct"),
    )
