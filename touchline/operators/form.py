"""Pre-match form features.

All windows are ordered by (match_datetime, match_id) — a team can play more
than once on a date, so ``match_id`` breaks ties deterministically. Windows
over a team's history run through ``bounded_window``, which cuts every key
into range slices, so one busy team never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import abbreviation_fallback, iso_date
from .chunked import bounded_row_number, bounded_window, last_rows
from .perspective import team_perspective

# The rolled statistics and the default window, as in the reference.
FORM_FEATURES = ("goals_scored", "goals_conceded", "shots", "shots_on_target", "corners", "points")
DEFAULT_WINDOWS = (5,)
ORDER = ("match_datetime", "match_id")


def form_column(feature: str, window: int) -> str:
    return f"avg_{feature}_last_{window}_matches"


def present_features(long: DataFrame) -> list[str]:
    """The rolled statistics that the frame has."""
    return [f for f in FORM_FEATURES if f in long.columns]


def lag_one(long: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Previous match value within (league, team): ``prev_<feature>``."""
    features = present_features(long) if features is None else features
    specs = {f"prev_{f}": (lambda w, f=f: F.max(f).over(w.rowsBetween(-1, -1))) for f in features}
    return bounded_window(long, ["league", "team"], ORDER, specs, lookback=1, carry=list(features))


def rolling_form(long: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS,
                 features: Sequence[str] | None = None) -> DataFrame:
    """Mean of the previous ≤ n matches (current excluded, NULLs skipped),
    ROUND 2, for every feature and window size — one sort for all of them."""
    features = present_features(long) if features is None else features
    specs = {}
    for n in windows:
        for f in features:
            specs[form_column(f, n)] = (lambda w, f=f, n=n: F.round(F.avg(f).over(w.rowsBetween(-n, -1)), 2))
    return bounded_window(long, ["league", "team"], ORDER, specs, lookback=max(windows), carry=list(features))


def unpivot_sides(contests: DataFrame, rolled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach the home row's and the away row's columns to each match as
    ``<col>_home`` / ``<col>_away``. Keyed on ``match_id`` (never on date+team),
    one grouped shuffle, no fan-out."""
    sided = rolled.groupBy("match_id").agg(
        *[F.max(F.when(F.col("is_home"), F.col(c))).alias(f"{c}_home") for c in columns],
        *[F.max(F.when(~F.col("is_home"), F.col(c))).alias(f"{c}_away") for c in columns],
    )
    return contests.join(sided, "match_id", "left")


def matchweek_index(contests: DataFrame, per_week: int | None = 10) -> DataFrame:
    """matchweek = (position − 1) // per_week + 1 in (league, season) order.

    ``per_week=None`` takes half the number of teams of each (league, season), one at least."""
    numbered = bounded_row_number(contests, ["league", "season"], ORDER, "season_position")
    if per_week is not None:
        return numbered.withColumn("matchweek", F.floor((F.col("season_position") - 1) / per_week).cast("long") + 1)
    sides = contests.select("league", "season", F.explode(F.array("home_team", "away_team")).alias("_team"))
    size = sides.distinct().groupBy("league", "season").agg(F.greatest(F.floor(F.count("_team") / 2), F.lit(1)).alias("_size"))
    week = (F.floor((F.col("season_position") - 1) / F.col("_size")).cast("long") + 1).alias("matchweek")
    return numbered.join(size, ["league", "season"]).select(*numbered.columns, week)


def latest_per_team(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("league", "team")) -> DataFrame:
    """The last row per team (``iloc[-1]``) with ``max_by`` — an aggregate
    with map-side partial combine, no sort, safe for hot teams."""
    payload = F.struct(*ORDER, *columns)
    return rows.groupBy(*keys).agg(F.max_by(payload, F.struct(*ORDER)).alias("_last")).select(*keys, "_last.*")


def dedupe_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("match_id",)) -> DataFrame:
    """First row per key in source order. ``min_by`` over a struct is an
    aggregate, so a key with a huge number of copies is combined map-side
    instead of being sorted in one task."""
    others = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return agg.select(*key, "_first.*").select(*df.columns)


def sort_matches(contests: DataFrame) -> DataFrame:
    """Global sort by (datetime, home, away, match_id) — range-partitioned, only at a sink."""
    return contests.orderBy("match_datetime", "home_team", "away_team", "match_id")


def next_matches(contests: DataFrame, today: str, n: int = 4) -> DataFrame:
    """Per league, the first ``n`` matches on or after ``today`` with
    abbreviations and ISO date (``row_number() <= n`` → WindowGroupLimit)."""
    upcoming = contests.where(F.col("match_datetime") >= F.lit(today).cast("timestamp_ntz"))
    w = Window.partitionBy("league").orderBy(*ORDER)
    ranked = upcoming.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return ranked.select("league", "rank", "match_id", iso_date("match_datetime").alias("match_date"),
                         "home_team", "away_team",
                         abbreviation_fallback("home_team").alias("home_abbr"),
                         abbreviation_fallback("away_team").alias("away_abbr"))


def build_features(contests: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS, k: float = 32.0,
                   initial: float = 1500.0, with_elo: bool = True) -> DataFrame:
    """Rolling form for each window size attached per side (J8), then Elo."""
    from .elo import elo_ratings

    long = team_perspective(contests)
    features = present_features(long)
    rolled = rolling_form(long, windows, features)
    cols = [form_column(f, n) for n in windows for f in features]
    wide = unpivot_sides(contests, rolled, cols)
    if with_elo:
        elo = elo_ratings(contests, k=k, initial=initial).select("match_id", "elo_home_pre", "elo_away_pre", "elo_diff")
        wide = wide.join(elo, "match_id", "left")
    return wide


def feature_columns(windows: Sequence[int] = DEFAULT_WINDOWS, features: Sequence[str] = FORM_FEATURES,
                    elo: bool = True) -> list[str]:
    """Strictly pre-match feature names produced by ``build_features`` (the allow-list, V7)."""
    cols = [f"{form_column(f, n)}_{side}" for n in windows for f in features for side in ("home", "away")]
    return cols + (["elo_home_pre", "elo_away_pre", "elo_diff"] if elo else [])


def state_before_last(long: DataFrame, side: Column, features: Sequence[str], windows: Sequence[int] = DEFAULT_WINDOWS,
                      slices: int = 32) -> DataFrame:
    """Per (league, team): the form before its last row where ``side`` holds, as ``rolling_form`` has it on that
    row, from the last ``max(windows)`` earlier rows alone.

    A team's rows meet its last row in ``slices`` hash slices, and each slice keeps its own last rows before
    they come together, so a team of any size is never sorted in one task."""
    keys = ["league", "team"]
    last = long.where(side).groupBy(*keys).agg(F.max(F.struct(*ORDER)).alias("_last"))
    salted = last.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    rows = long.withColumn("_slice", F.pmod(F.xxhash64("match_id"), F.lit(slices)).cast("int"))
    earlier = rows.join(salted, [*keys, "_slice"]).where(F.struct(*ORDER) < F.col("_last"))
    n = max(windows)
    kept = last_rows(last_rows(earlier, [*keys, "_slice"], ORDER, n).drop("_nth"), keys, ORDER, n)
    means = kept.groupBy(*keys).agg(*[F.round(F.avg(F.when(F.col("_nth") <= w, F.col(f))), 2).alias(form_column(f, w))
                                      for w in windows for f in features])
    return last.select(*keys).join(means, keys, "left")


def latest_state_join(fixtures: DataFrame, contests: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
    """Per fixture, the home team's latest home-row form and the away team's
    latest away-row form (as-of "now": the end of the history)."""
    long = team_perspective(contests)
    features = present_features(long)
    cols = [form_column(f, n) for n in windows for f in features]
    home_last = state_before_last(long, F.col("is_home"), features, windows).select(
        "league", F.col("team").alias("home_team"), *[F.col(c).alias(f"{c}_home") for c in cols])
    away_last = state_before_last(long, ~F.col("is_home"), features, windows).select(
        "league", F.col("team").alias("away_team"), *[F.col(c).alias(f"{c}_away") for c in cols])
    return (fixtures.join(home_last, ["league", "home_team"], "left")
            .join(away_last, ["league", "away_team"], "left"))
