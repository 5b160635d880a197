"""Elo ratings of one huge league, level by level.

A match depends only on the previous matches of its two teams. Its level is one
above the higher of theirs, so the matches of a level share no team and are all
rated at once: a join of the matches whose teams have both played all earlier
ones with the teams' state (matches played, rating). A league of T teams rates up
to T / 2 matches a level on as many tasks as the join has partitions, where the
fold of ``elo_ratings`` is one task a league. It pays with one job a level: use it
for leagues of many teams, the fold for many leagues of few teams.

Each match carries its number in either team's history, so the teams' state alone
tells which matches are ready, and matches far behind or ahead are pruned by the
files' statistics. Each level's state is written to the shared folder: a lost
executor costs one level, and lineage never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .chunked import bounded_row_number
from .elo import ELO_INITIAL, ELO_K

_STATE = ("league string, team string, played long, rating double, match_id long, is_home boolean, elo_home_pre double, elo_away_pre double, level long")


def numbered(contests: DataFrame) -> DataFrame:
    """(league, match_id, home_team, away_team, result, home_nth, away_nth): each match with its number in both
    teams' histories, ordered by (match_datetime, match_id)."""
    sides = contests.select("league", "match_id", "match_datetime", "result", F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team").alias("team"), F.lit(False).alias("is_home")))).alias("v")).select("league", "match_id", "match_datetime", "result", "v.*")
    nth = bounded_row_number(sides, ["league", "team"], ["match_datetime", "match_id"], "nth")
    home = lambda c: F.max(F.when(F.col("is_home"), F.col(c)))
    away = lambda c: F.max(F.when(~F.col("is_home"), F.col(c)))
    return nth.groupBy("league", "match_id").agg(home("team").alias("home_team"), away("team").alias("away_team"), F.max("result").alias("result"),
                                                 home("nth").alias("home_nth"), away("nth").alias("away_nth"))


def _rated(ready: DataFrame, k: float, level: int) -> DataFrame:
    """Both sides of every ready match: the state after it, with the match's ratings before it."""
    score = F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)
    x = ready.withColumn("_s", score).withColumn("_e", 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("ra") - F.col("rh")) / 400.0)))
    pre = [F.col("match_id"), F.col("rh").alias("elo_home_pre"), F.col("ra").alias("elo_away_pre")]
    side = lambda who, nth, rating, home: F.struct(F.col(who).alias("team"), F.col(nth).alias("played"), rating.alias("rating"), F.lit(home).alias("is_home"))
    both = F.array(side("home_team", "home_nth", F.col("rh") + k * (F.col("_s") - F.col("_e")), True),
                   side("away_team", "away_nth", F.col("ra") + k * ((1.0 - F.col("_s")) - (1.0 - F.col("_e"))), False))
    return x.select("league", *pre, F.explode(both).alias("v")).select(
        "league", "v.team", "v.played", "v.rating", "match_id", "v.is_home", "elo_home_pre", "elo_away_pre", F.lit(level).cast("long").alias("level"))


def elo_by_level(contests: DataFrame, k: float = ELO_K, initial: float = ELO_INITIAL) -> DataFrame:
    """E8 for leagues of many teams: the columns of ``elo_ratings`` and the match's ``level`` (1: no earlier match
    of either team). Equal to the fold. Rows with a missing team, or with one team on both sides, are left out."""
    spark = contests.sparkSession
    games = contests.where("home_team <> away_team")
    first = F.greatest("home_nth", "away_nth")
    # By the lowest level a match can have: whole files lie behind or ahead of a level.
    matches = written(numbered(games).withColumn("lowest", first).repartitionByRange("lowest").sortWithinPartitions("lowest"), "elo-matches")
    last = matches.agg(F.max("lowest")).first()[0] or 0
    teams = matches.select("league", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("match_id", "long"), ("is_home", "boolean"), ("elo_home_pre", "double"), ("elo_away_pre", "double"), ("level", "long"))]
    root = scratch_path(spark, "elo-levels")
    columns = [c.split()[0] for c in _STATE.split(", ")]
    teams.select("league", "team", F.lit(0).cast("long").alias("played"), F.lit(float(initial)).alias("rating"), *none).write.parquet(f"{root}/0")
    level, behind, left, paths = 0, 0, matches.count(), []
    while left:
        state = spark.read.schema(_STATE).parquet(f"{root}/{level}").select("league", "team", "played", "rating")
        level += 1
        # A match whose number is passed by every team is done; one numbered above the level cannot be ready.
        open_ = matches.where((F.col("lowest") > behind) & (F.col("lowest") <= min(level, last)))
        h = state.select("league", F.col("team").alias("home_team"), (F.col("played") + 1).alias("home_nth"), F.col("rating").alias("rh"))
        a = state.select("league", F.col("team").alias("away_team"), (F.col("played") + 1).alias("away_nth"), F.col("rating").alias("ra"))
        ready = open_.join(h, ["league", "home_team", "home_nth"]).join(a, ["league", "away_team", "away_nth"])
        held = state.select("*", *none)
        # The later state of each team: its match's if it played, else the one it held.
        merged = held.unionByName(_rated(ready, k, level)).groupBy("league", "team").agg(
            F.max_by(F.struct(*columns[2:]), "played").alias("s")).select("league", "team", "s.*")
        done = Observation()
        merged.select(columns).observe(done, F.count("match_id").alias("n"), F.min("played").alias("least")).write.parquet(f"{root}/{level}")
        left, behind = left - done.get["n"] // 2, done.get["least"]
        paths.append(f"{root}/{level}")
    rated = spark.read.schema(_STATE).parquet(*(paths or [f"{root}/0"])).where("is_home")
    return rated.select("match_id", "league", F.round("elo_home_pre", 6).alias("elo_home_pre"), F.round("elo_away_pre", 6).alias("elo_away_pre"),
                        F.round(F.col("elo_home_pre") - F.col("elo_away_pre"), 6).alias("elo_diff"), "level")
