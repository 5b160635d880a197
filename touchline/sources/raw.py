"""Raw season frames derived from the contest relation.

Shapes contests the way raw season files look: string columns named as in
the source feeds, day-first dates (two-digit years before 1998, four-digit
after), corner counts recorded only from 1998, a kickoff time, and the
source line. Used to drive the file readers and cleaning operators on data
that grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRIFT_SEASON = "1998"


def raw_from_contests(contests: DataFrame, wide: bool = False) -> DataFrame:
    early = F.col("season") < DRIFT_SEASON
    date = F.when(early, F.date_format("match_datetime", "dd/MM/yy")).otherwise(F.date_format("match_datetime", "dd/MM/yyyy"))
    cols = [
        F.col("league").alias("Div"), date.alias("Date"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        F.col("home_goals").cast("string").alias("FTHG"), F.col("away_goals").cast("string").alias("FTAG"),
        F.col("result").alias("FTR"),
        F.col("home_shots").cast("string").alias("HS"), F.col("away_shots").cast("string").alias("AS"),
        F.when(~early, F.col("home_corners").cast("string")).alias("HC"),
        F.when(~early, F.col("away_corners").cast("string")).alias("AC"),
    ]
    if wide:
        hour = F.lpad((F.lit(12) + F.pmod(F.col("home_corners"), F.lit(9))).cast("string"), 2, "0")
        cols.append(F.concat(hour, F.lit(":00")).alias("Time"))
    return contests.select(*cols, F.col("league"), F.col("season"), F.col("match_id").alias("source_line"),
                           F.when(early, F.lit("early")).otherwise(F.lit("late")).alias("header_group"))


def wide_raw(contests: DataFrame, odds: DataFrame) -> DataFrame:
    """Raw season frame with all columns of the wide map, every one a string.

    Statistics that the contests lack follow from those they have by rule, so they grow with the driver tables;
    every fiftieth attendance is no number. Odds of the market are the bookmaker's and five hundredths."""
    def text(x):
        return x.cast("string")

    def half(side):
        return F.floor(F.col(f"{side}_goals") / 2)

    cols = []
    for side, s in (("home", "H"), ("away", "A")):
        shots, corners = F.col(f"{side}_shots"), F.col(f"{side}_corners")
        fouls = F.pmod(shots, F.lit(17))
        cols += [text(F.col(f"{side}_goals")).alias(f"FT{s}G"), text(half(side)).alias(f"HT{s}G"), text(shots).alias(f"{s}S"),
                 text(F.col(f"{side}_shots_on_target")).alias(f"{s}ST"), text(F.pmod(shots, F.lit(3))).alias(f"{s}HW"),
                 text(corners).alias(f"{s}C"), text(fouls).alias(f"{s}F"), text(fouls + 1).alias(f"{s}FKC"),
                 text(F.pmod(corners, F.lit(5))).alias(f"{s}O"), text(F.pmod(fouls, F.lit(5))).alias(f"{s}Y"),
                 text(F.floor(fouls / 13)).alias(f"{s}R")]
    for side, s in (("home", "H"), ("draw", "D"), ("away", "A")):
        price = F.col(f"{side}_odds_c")
        cols += [text(price / 100).alias(f"B365{s}"), text((price + 5) / 100).alias(f"Avg{s}")]
    hour = F.lpad(text(F.lit(12) + F.pmod(F.col("home_corners"), F.lit(9))), 2, "0")
    return contests.join(odds, "match_id", "left").select(
        F.col("league").alias("Div"), F.date_format("match_datetime", "dd/MM/yyyy").alias("Date"),
        F.concat(hour, F.lit(":00")).alias("Time"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        F.concat(F.lit("Referee "), text(F.pmod(F.col("match_id"), F.lit(40)))).alias("Referee"),
        F.when(F.pmod(F.col("match_id"), F.lit(50)) == 0, "n/a")
        .otherwise(text(F.lit(1000) + F.col("home_shots") * 37 + F.col("away_shots"))).alias("Attendance"),
        F.col("result").alias("FTR"),
        F.when(half("home") > half("away"), "H").when(half("home") < half("away"), "A").otherwise("D").alias("HTR"),
        *cols, "league", "season", F.col("match_id").alias("source_line"))
