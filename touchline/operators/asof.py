"""Backward as-of join over range slices (J11 for dated fixtures).

Each left row meets the last right row of its key before it. Both sides are
cut by range of (key, order) into slices of about equal rows (``range_slices``),
so a key that holds a third of all rows is spread over many tasks. Within a
slice the last right row is a running window; what a slice inherits is the last
right row of the key's earlier slices, from a table with one row per (key,
slice): a key has no more of them than there are slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .chunked import range_slices, split_rows, split_slices
from .form import DEFAULT_WINDOWS, ORDER, form_column, present_features, rolling_form
from .perspective import team_perspective


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], strict: bool = True,
              slices: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of the same keys whose ``order`` is before the left
    row's (``strict``; else before or equal; equal right rows count as one, the greatest by its columns).
    No such row, or a null key or order: nulls."""
    keys, order, columns = list(keys), list(order), list(columns)
    kind = 0 if strict else 1
    ours, theirs = F.struct(*[F.col(c) for c in left.columns]), F.struct(*columns)
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, *order]])
    both = left.select(*keys, *order, F.lit(kind).alias("_kind"), ours.alias("_left"), F.lit(None).cast(right.select(theirs.alias("s")).schema["s"].dataType).alias("_right")).unionByName(
        right.where(usable).select(*keys, *order, F.lit(1 - kind).alias("_kind"), F.lit(None).cast(left.select(ours.alias("s")).schema["s"].dataType).alias("_left"), theirs.alias("_right")))
    line = [*order, "_kind"]
    marked = range_slices(both, keys, line, slices)
    here = Window.partitionBy(*keys, "_chunk").orderBy(*line, F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumn("_seen", F.last("_right", ignorenulls=True).over(here)).where(F.col("_left").isNotNull())
    # Only a key that lies in several slices inherits anything.
    cut, same = split_rows(keys, split_slices(marked, keys), bounded=True)
    per = marked.join(cut, same, "left_semi").groupBy(*keys, "_chunk").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(*line, "_right"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = per.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where(F.col("_before").isNotNull()).drop("_last")
    # Keys of unusable left rows may be null: they find nothing, which is their result.
    found = within.join(inherited, [*keys, "_chunk"], "left").withColumn("_state", F.when(usable, F.coalesce("_seen", "_before")))
    return found.select("_left.*", *[F.col(f"_state.{c}").alias(c) for c in columns])


def dated_state_join(fixtures: DataFrame, contests: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS, slices: int | None = None) -> DataFrame:
    """J11 for dated fixtures: (league, home_team, away_team, match_datetime, match_id, …) with the form of the home
    side's last home row and of the away side's last away row strictly before the fixture, as
    ``<form>_home`` / ``<form>_away``. A past match used as a fixture never meets its own row."""
    long = team_perspective(contests)
    features = present_features(long)
    cols = [form_column(f, n) for n in windows for f in features]
    # Each as-of join reads its input twice, for the ranges and for the slices, so what it reads is stored.
    rolled = written(rolling_form(long, windows, features), "rolled")
    for side, cond in (("home", "is_home"), ("away", "NOT is_home")):
        states = rolled.where(cond).select("league", F.col("team").alias(f"{side}_team"), *ORDER, *[F.col(c).alias(f"{c}_{side}") for c in cols])
        fixtures = asof_join(fixtures if side == "home" else written(fixtures, "home-states"), states, ["league", f"{side}_team"], ORDER, [f"{c}_{side}" for c in cols], slices=slices)
    return fixtures
