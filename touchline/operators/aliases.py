"""Team names: abbreviations and spellings resolved to one canonical team.

The alias dimension has one row a known spelling: ``(alias, team, abbreviation)``.
Names are resolved before any key is formed, in both directions: an
abbreviation or another spelling gives the canonical team, a team gives its
abbreviation. Spellings are compared trimmed, without case, and with single
spaces. A name the dimension does not know stays as it is (trimmed), and its
abbreviation is its first three letters in capitals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import abbreviation_fallback, clean_text, iso_date
from .form import ORDER, dedupe_keep_first, matchweek_index

# The abbreviation of each team, its canonical name first, then the other spellings.
TEAM_NAMES = {
    "ARS": ["Arsenal"], "AVL": ["Aston Villa"], "BOU": ["Bournemouth"], "BRE": ["Brentford"], "BHA": ["Brighton"],
    "CHE": ["Chelsea"], "CRY": ["Crystal Palace"], "COV": ["Coventry City", "Coventry"], "EVE": ["Everton"], "FUL": ["Fulham"],
    "HUL": ["Hull", "Hull City"], "IPS": ["Ipswich", "Ipswich Town"], "LEE": ["Leeds"], "LEI": ["Leicester", "Leicester City"],
    "LIV": ["Liverpool"], "MCI": ["Man City", "Manchester City"], "MUN": ["Man United", "Man Utd", "Manchester United"],
    "NEW": ["Newcastle"], "NFO": ["Nott'm Forest", "Nottingham Forest"], "SOU": ["Southampton"], "SUN": ["Sunderland"],
    "TOT": ["Tottenham", "Spurs"], "WHU": ["West Ham"], "WOL": ["Wolves"],
}


def spelling(name: Column | str) -> Column:
    """What spellings are compared by."""
    return F.lower(F.regexp_replace(clean_text(name), "\\s+", " "))


def alias_dimension(teams: DataFrame) -> DataFrame:
    """(alias, team, abbreviation) from (team, abbreviation, spellings array): the team, its abbreviation and every
    other spelling each resolve to the team. A spelling of two teams goes to the first by name."""
    rows = teams.select("team", "abbreviation", F.explode(F.array_union(F.array("team", "abbreviation"), F.coalesce("spellings", F.array().cast("array<string>")))).alias("alias"))
    return dedupe_keep_first(rows.select(spelling("alias").alias("alias"), "team", "abbreviation").where("alias <> ''"), ["alias"], ["team", "abbreviation"])


def known_teams(spark: SparkSession) -> DataFrame:
    """The alias dimension of the fixed names."""
    rows = [(names[0], abbr, names[1:]) for abbr, names in TEAM_NAMES.items()]
    return alias_dimension(spark.createDataFrame(rows, "team string, abbreviation string, spellings array<string>"))


def resolve_teams(df: DataFrame, aliases: DataFrame, columns: Sequence[str] = ("home_team", "away_team")) -> DataFrame:
    """``df`` with each named column replaced by its canonical team, and ``<column>_abbr`` and ``<column>_known`` beside it."""
    for c in columns:
        a = aliases.select(F.col("alias").alias("_alias"), F.col("team").alias("_team"), F.col("abbreviation").alias("_abbr"))
        j = df.withColumn("_spelling", spelling(c)).join(a, F.col("_spelling") == F.col("_alias"), "left")
        name = F.coalesce("_team", clean_text(c))
        df = j.select(*[name.alias(c) if x == c else F.col(x) for x in df.columns], abbreviation_fallback(name, "_abbr").alias(f"{c}_abbr"),
                      F.col("_team").isNotNull().alias(f"{c}_known"))
    return df


def next_rounds(contests: DataFrame, aliases: DataFrame, today: str, n: int = 4, per_week: int = 10) -> DataFrame:
    """T2 with the alias dimension: per league the first ``n`` matches on or after ``today`` with canonical teams,
    their abbreviations, ISO date and round number (``matchday``: the match's week of its season)."""
    w = Window.partitionBy("league").orderBy(*ORDER)
    upcoming = matchweek_index(contests, per_week).where(F.col("match_datetime") >= F.lit(today).cast("timestamp_ntz"))
    ranked = upcoming.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return resolve_teams(ranked, aliases).select(
        "league", "rank", "match_id", iso_date("match_datetime").alias("match_date"), F.col("matchweek").alias("matchday"), "home_team", "away_team",
        F.col("home_team_abbr").alias("home_abbr"), F.col("away_team_abbr").alias("away_abbr"), "home_team_known", "away_team_known")
