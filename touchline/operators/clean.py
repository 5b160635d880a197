"""Projection, cleaning and leak guards.

Raw season files arrive as all-string columns whose set and case drift by
season. ``map_columns`` renames case-insensitively from a fixed column map,
``clean_matches`` parses, trims, coerces, drops rows without keys and keeps
the first row per match key in source order — all column expressions plus
one keyed aggregate (``min_by``), so nothing is sorted globally.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, parse_date_time, parse_day_first, safe_int, to_number

# Raw → clean column names (results and match statistics), as in the reference.
RAW_COLUMN_MAP = {
    "date": "date",
    "hometeam": "home_team",
    "awayteam": "away_team",
    "ftr": "result",
    "fthg": "home_goals",
    "ftag": "away_goals",
    "hs": "home_shots",
    "as": "away_shots",
    "hst": "home_shots_on_target",
    "ast": "away_shots_on_target",
    "hc": "home_corners",
    "ac": "away_corners",
    "hf": "home_fouls_committed",
    "af": "away_fouls_committed",
    "hy": "home_yellow",
    "ay": "away_yellow",
    "hr": "home_red",
    "ar": "away_red",
}

# The wide map (adds division, kickoff, referee, attendance, half time,
# woodwork, free kicks, offsides and bookmaker odds), as in the reference.
WIDE_COLUMN_MAP = {
    "div": "league_division",
    "date": "date",
    "time": "kickoff_time",
    "hometeam": "home_team",
    "awayteam": "away_team",
    "referee": "referee",
    "attendance": "attendance",
    "ftr": "result",
    "fthg": "home_goals",
    "ftag": "away_goals",
    "hthg": "half_time_home_goals",
    "htag": "half_time_away_goals",
    "htr": "half_time_result",
    "hs": "home_shots",
    "as": "away_shots",
    "hst": "home_shots_on_target",
    "ast": "away_shots_on_target",
    "hhw": "home_hit_woodwork",
    "ahw": "away_hit_woodwork",
    "hc": "home_corners",
    "ac": "away_corners",
    "hf": "home_fouls_committed",
    "af": "away_fouls_committed",
    "hfkc": "home_free_kicks_conceded",
    "afkc": "away_free_kicks_conceded",
    "ho": "home_offsides",
    "ao": "away_offsides",
    "hy": "home_yellow",
    "ay": "away_yellow",
    "hr": "home_red",
    "ar": "away_red",
    "b365h": "b365_home_win_odds",
    "b365d": "b365_draw_odds",
    "b365a": "b365_away_win_odds",
    "avgh": "market_avg_home_win_odds",
    "avgd": "market_avg_draw_odds",
    "avga": "market_avg_away_win_odds",
}

# Text columns, numeric columns and required columns of the clean frame.
TEXT_COLUMNS = ("home_team", "away_team", "result")
NUMERIC_COLUMNS = ("home_goals", "away_goals", "home_shots", "away_shots", "home_shots_on_target",
                   "away_shots_on_target", "home_corners", "away_corners", "home_fouls_committed",
                   "away_fouls_committed", "home_yellow", "away_yellow", "home_red", "away_red")
REQUIRED_COLUMNS = ("match_datetime", "home_team", "away_team", "result", "home_goals", "away_goals")

# Further columns of the wide frame by kind: text, whole numbers, decimal odds.
WIDE_TEXT_COLUMNS = ("league_division", "referee", "half_time_result")
WIDE_NUMERIC_COLUMNS = ("attendance", "half_time_home_goals", "half_time_away_goals", "home_hit_woodwork", "away_hit_woodwork",
                        "home_free_kicks_conceded", "away_free_kicks_conceded", "home_offsides", "away_offsides")
WIDE_DECIMAL_COLUMNS = tuple(c for c in WIDE_COLUMN_MAP.values() if c.endswith("_odds"))

# Columns known before kickoff, and the odds table, as in the reference.
PREMATCH_COLUMNS = ("league_division", "match_datetime", "home_team", "away_team", "referee", "attendance",
                    "b365_home_win_odds", "b365_draw_odds", "b365_away_win_odds",
                    "market_avg_home_win_odds", "market_avg_draw_odds", "market_avg_away_win_odds")
ODDS_COLUMNS = ("match_datetime", "home_team", "away_team", "b365_home_win_odds", "b365_draw_odds",
                "b365_away_win_odds", "market_avg_home_win_odds", "market_avg_draw_odds", "market_avg_away_win_odds")

KEEP_ALWAYS = ("season", "league", "source_line", "source_file", "file_row")


def map_columns(raw: DataFrame, column_map: Mapping[str, str] = RAW_COLUMN_MAP,
                keep: Sequence[str] = KEEP_ALWAYS) -> DataFrame:
    """Case-insensitive select + rename; absent columns are ignored,
    bookkeeping columns (season, league, source line) are kept. Season files name
    the league in their division column only; it becomes ``league``."""
    by_lower = {c.lower(): c for c in raw.columns}
    if "league" in keep and "league" not in by_lower and "div" in by_lower:
        raw = raw.withColumn("league", clean_text(f"`{by_lower['div']}`"))
    cols = [F.col(f"`{by_lower[k]}`").alias(v) for k, v in column_map.items() if k in by_lower]
    kept = [F.col(c) for c in keep if c in raw.columns and c not in column_map.values()]
    return raw.select(*cols, *kept)


def clean_matches(raw: DataFrame | None, column_map: Mapping[str, str] = RAW_COLUMN_MAP,
                  key: Sequence[str] = ("league", "season", "match_datetime", "home_team", "away_team"),
                  order: Sequence[str] = ("source_line",)) -> DataFrame:
    """Map → parse date (day first) → trim text → coerce numbers → drop rows
    without date/home/away → keep the first row per key in source order.
    ``raw`` must not be None (the reference raises too)."""
    if raw is None:
        raise ValueError("raw frame cannot be None")
    df = map_columns(raw, column_map)
    if "kickoff_time" in df.columns:
        df = df.withColumn("match_datetime", parse_date_time("date", "kickoff_time")).drop("date", "kickoff_time")
    else:
        df = df.withColumn("match_datetime", parse_day_first("date")).drop("date")
    df = df.withColumns({c: clean_text(c) for c in (*TEXT_COLUMNS, *WIDE_TEXT_COLUMNS) if c in df.columns})
    df = df.withColumns({c: safe_int(to_number(c)) for c in (*NUMERIC_COLUMNS, *WIDE_NUMERIC_COLUMNS) if c in df.columns})
    df = df.withColumns({c: to_number(c) for c in WIDE_DECIMAL_COLUMNS if c in df.columns})
    df = df.na.drop(subset=["match_datetime", "home_team", "away_team"])
    key = [k for k in key if k in df.columns]
    order = [o for o in order if o in df.columns] or [o for o in ("source_file", "file_row") if o in df.columns] \
        or ["match_datetime", "home_team", "away_team"]
    from .form import dedupe_keep_first

    return dedupe_keep_first(df, key, order)


def prematch_projection(clean_wide: DataFrame) -> DataFrame:
    """Keep only columns known before kickoff."""
    return clean_wide.select(*[c for c in PREMATCH_COLUMNS if c in clean_wide.columns])


def odds_projection(clean_wide: DataFrame) -> DataFrame:
    """The separate odds table."""
    return clean_wide.select(*[c for c in ODDS_COLUMNS if c in clean_wide.columns])


def leak_guard(feature_cols: Sequence[str], allowed: Sequence[str]) -> None:
    """V7: refuse any feature outside the pre-match allow-list (e.g. same-match shots)."""
    bad = [c for c in feature_cols if c not in set(allowed)]
    if bad:
        raise ValueError(f"features not known before kickoff: {bad}")


def to_int_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H14 over several columns."""
    return df.select(*[safe_int(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def matches_from_files(raw: DataFrame) -> DataFrame:
    """S1 → P3: raw season files to matches with a league and a stable 64-bit ``match_id`` of the
    natural key (which stays beside it); ready for the features and the star load."""
    from .star import stable_match_id

    cleaned = clean_matches(raw)
    return stable_match_id(cleaned.drop("source_file", "file_row"))
