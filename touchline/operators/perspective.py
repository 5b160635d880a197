"""Team-perspective ("long") frame and set operators.

U1 turns one row per match into two rows per match (home view, away view)
with ``explode(array(struct, struct))``: a single scan of the input, no
self-union and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import away_points, home_points

KEY_COLS = ("match_id", "league", "season", "match_datetime", "result")


def side_stats(df: DataFrame) -> list[str]:
    """Statistic names X for which both ``home_X`` and ``away_X`` exist (goals and team excluded)."""
    cols = set(df.columns)
    out = []
    for c in df.columns:
        if c.startswith("home_") and c not in ("home_team", "home_goals"):
            stat = c[len("home_"):]
            if f"away_{stat}" in cols:
                out.append(stat)
    return out


def team_perspective(contests: DataFrame, stats: list[str] | None = None, unknown_points_as_zero: bool = True) -> DataFrame:
    """``(match_id, league, season, match_datetime, result, team, opponent, is_home,
    goals_scored, goals_conceded, points, <stats…>)`` — two rows per match (``result``
    stays the match's H/D/A code)."""
    stats = side_stats(contests) if stats is None else list(stats)
    keys = [c for c in KEY_COLS if c in contests.columns]

    def view(me: str, other: str, is_home: bool):
        pts = home_points("result", unknown_points_as_zero) if is_home else away_points("result", unknown_points_as_zero)
        fields = [F.col(f"{me}_team").alias("team"), F.col(f"{other}_team").alias("opponent"),
                  F.lit(is_home).alias("is_home"),
                  F.col(f"{me}_goals").alias("goals_scored"), F.col(f"{other}_goals").alias("goals_conceded"),
                  pts.cast("int").alias("points")]
        fields += [F.col(f"{me}_{s}").alias(s) for s in stats]
        return F.struct(*fields)

    exploded = contests.select(*keys, F.explode(F.array(view("home", "away", True), view("away", "home", False))).alias("v"))
    return exploded.select(*keys, "v.*")


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """Row concatenation aligned by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_teams(contests: DataFrame, by_league: bool = True) -> DataFrame:
    """Distinct non-blank team names over both sides (per league by default)."""
    keys = ["league"] if by_league and "league" in contests.columns else []
    names = contests.select(*keys, F.explode(F.array(F.trim("home_team"), F.trim("away_team"))).alias("team"))
    return names.where(F.col("team").isNotNull() & (F.col("team") != "")).distinct()


def distinct_seasons(contests: DataFrame, by_league: bool = True) -> DataFrame:
    """Distinct seasons (per league by default)."""
    keys = ["league"] if by_league and "league" in contests.columns else []
    return contests.select(*keys, "season").where(F.col("season").isNotNull()).distinct()
