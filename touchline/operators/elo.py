"""Sequential Elo ratings.

Elo is a fold through every match of a league in (match_datetime, match_id)
order: each match reads both teams' current ratings and writes both back.
Leagues are independent, so they run in parallel; within a league the
dependency is genuine. A league is a bounded competition (the derived relation
makes more leagues, not larger ones, as data grows), so tasks grow with the data.

Execution (no group is ever materialised whole):

* rows are hash-partitioned by league and sorted within the partition by
  (league, kind, match_datetime, match_id) — Spark's external sort spills;
* ``mapInArrow`` streams the sorted partition in Arrow batches keeping only
  the rating state (one float per team) in memory, so memory is bounded by
  the batch size and the number of teams, not by the league's match count;
* initial ratings ride along as ``kind = 0`` rows that sort ahead of the
  matches, so no broadcast is needed.

``chunk`` (e.g. ``"season"``) runs the fold chunk by chunk: each chunk is one
job whose final ratings seed the next, and every chunk's output is
checkpointed to the shared checkpoint folder. A lost executor then costs one
chunk, and lineage never grows with the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# K factor and starting rating, as in the reference.
ELO_K = 32.0
ELO_INITIAL = 1500.0

_OUT_SCHEMA = ("kind int, league string, match_id long, team string, "
               "elo_home_pre double, elo_away_pre double, rating double")
_OUT_ARROW = pa.schema([("kind", pa.int32()), ("league", pa.string()), ("match_id", pa.int64()), ("team", pa.string()),
                        ("elo_home_pre", pa.float64()), ("elo_away_pre", pa.float64()), ("rating", pa.float64())])


def _fold(k: float, initial: float):
    # The helpers are nested, so that the function travels whole and tasks need not import this module.
    def codes(column: pa.Array) -> tuple[np.ndarray, list]:
        """(the number of each row's value, the values by number); a null is a value."""
        d = column.dictionary_encode(null_encoding="encode")
        return np.asarray(d.indices).astype(np.int64), d.dictionary.to_pylist()

    def out(kind, league, match_id, team, elo_home_pre, elo_away_pre, rating) -> pa.RecordBatch:
        columns = (kind, league, match_id, team, elo_home_pre, elo_away_pre, rating)
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _OUT_ARROW, strict=True)],
                                          schema=_OUT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}  # (league, team) -> its place in ratings
        ratings: list[float] = []

        def places(league: np.ndarray, leagues: list, team: np.ndarray, teams: list) -> np.ndarray:
            """Each row's place; a batch holds few different (league, team) pairs, so only those are looked up."""
            pairs, row = np.unique(league * len(teams) + team, return_inverse=True)
            at = np.empty(len(pairs), np.int64)
            for i, p in enumerate(pairs.tolist()):
                at[i] = known.setdefault((leagues[p // len(teams)], teams[p % len(teams)]), len(known))
            ratings.extend([initial] * (len(known) - len(ratings)))
            return at[row]

        for b in batches:
            if not b.num_rows:
                continue
            match = np.asarray(b.column("kind")) == 1
            league, leagues = codes(b.column("league"))
            home, homes = codes(b.column("home_team"))
            away, aways = codes(b.column("away_team"))
            res = pc.fill_null(b.column("result"), "")
            score = np.where(np.asarray(pc.equal(res, "H")), 1.0, np.where(np.asarray(pc.equal(res, "D")), 0.5, 0.0)).tolist()
            h_at = places(league, leagues, home, homes)
            # A carried-in rating has no away side.
            a_at = h_at.copy()
            a_at[match] = places(league[match], leagues, away[match], aways)
            seeds = None if match.all() else b.column("rating").to_numpy(zero_copy_only=False)
            pre_h, pre_a = [], []
            for i, (h, a, sh) in enumerate(zip(h_at.tolist(), a_at.tolist(), score, strict=True)):
                if seeds is not None and not match[i]:
                    ratings[h] = float(seeds[i])
                    continue
                rh, ra = ratings[h], ratings[a]
                expected_home = 1.0 / (1.0 + 10.0 ** ((ra - rh) / 400.0))
                ratings[h] = rh + k * (sh - expected_home)
                ratings[a] = ra + k * ((1.0 - sh) - (1.0 - expected_home))
                pre_h.append(rh)
                pre_a.append(ra)
            if pre_h:
                m, n = b.filter(pa.array(match)), len(pre_h)
                yield out([1] * n, m.column("league"), m.column("match_id"), pa.nulls(n), pre_h, pre_a, pa.nulls(n))
        if known:
            n = len(known)
            yield out([2] * n, pa.array([lg for lg, _ in known], pa.string()), pa.nulls(n), pa.array([t for _, t in known], pa.string()),
                       pa.nulls(n), pa.nulls(n), ratings)

    return run


def _elo_pass(matches: DataFrame, state: DataFrame | None, k: float, initial: float) -> DataFrame:
    m = matches.select(F.lit(1).alias("kind"), "league", "match_datetime", "match_id", "home_team", "away_team",
                       "result", F.lit(None).cast("double").alias("rating"))
    if state is not None:
        s = state.select(F.lit(0).alias("kind"), "league", F.lit(None).cast("timestamp_ntz").alias("match_datetime"),
                         F.lit(0).cast("long").alias("match_id"), F.col("team").alias("home_team"),
                         F.lit(None).cast("string").alias("away_team"), F.lit(None).cast("string").alias("result"),
                         F.col("rating").cast("double"))
        m = m.unionByName(s)
    # One partition a core: they are small in bytes, and AQE would merge them until one task folds all leagues;
    # more would start idle Python tasks.
    ordered = m.repartition(m.sparkSession.sparkContext.defaultParallelism, "league").sortWithinPartitions("league", "kind", "match_datetime", "match_id")
    return ordered.drop("match_datetime").mapInArrow(_fold(k, initial), _OUT_SCHEMA)


def _finish(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 1").select(
        "match_id", "league",
        F.round("elo_home_pre", 6).alias("elo_home_pre"),
        F.round("elo_away_pre", 6).alias("elo_away_pre"),
        F.round(F.col("elo_home_pre") - F.col("elo_away_pre"), 6).alias("elo_diff"),
    )


def elo_ratings(contests: DataFrame, k: float = ELO_K, initial: float = ELO_INITIAL,
                chunk: str | None = None) -> DataFrame:
    """Pre-match ratings per match: ``(match_id, league, elo_home_pre,
    elo_away_pre, elo_diff)``, rounded to 6 decimals."""
    cols = ["league", "match_datetime", "match_id", "home_team", "away_team", "result"]
    if chunk is None:
        return _finish(_elo_pass(contests.select(*cols), None, k, initial))
    matches = contests.select(*cols, chunk)
    # Chunk values (e.g. seasons) are a small, bounded list, in order of time.
    values = [r[0] for r in matches.groupBy(chunk).agg(F.min("match_datetime").alias("t")).orderBy("t").collect()]
    state = None
    parts = []
    for v in values:
        folded = _elo_pass(matches.where(F.col(chunk) == v).drop(chunk), state, k, initial).checkpoint(eager=True)
        parts.append(_finish(folded))
        state = folded.where("kind = 2").select("league", "team", "rating")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def final_ratings(contests: DataFrame, k: float = ELO_K, initial: float = ELO_INITIAL) -> DataFrame:
    """Ratings after the last match: ``(league, team, rating)``."""
    matches = contests.select("league", "match_datetime", "match_id", "home_team", "away_team", "result")
    return _elo_pass(matches, None, k, initial).where("kind = 2").select("league", "team", "rating")


def rating_range(contests: DataFrame, k: float = ELO_K, initial: float = ELO_INITIAL) -> DataFrame:
    """Min / max final rating per league (rounded to 6)."""
    return final_ratings(contests, k, initial).groupBy("league").agg(
        F.round(F.min("rating"), 6).alias("min_rating"), F.round(F.max("rating"), 6).alias("max_rating"))
