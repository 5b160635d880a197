"""As-of join against brute force, with a team that holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import asof, form
from touchline.operators.perspective import team_perspective


def rows(spark, n, salt, hot=3):
    return spark.range(n).select(
        F.xxhash64("id", F.lit(salt)).alias("rid"), F.when(F.col("id") % hot == 0, "HOT").otherwise(F.concat(F.lit("K"), F.pmod(F.xxhash64("id"), F.lit(20)))).alias("k"),
        F.pmod(F.xxhash64("id", F.lit(salt), F.lit("t")), F.lit(n // 3)).alias("t"))


def brute(left, right, strict):
    out = {}
    for a in left:
        seen = [(b["t"], b["v"]) for b in right if a["k"] is not None and a["t"] is not None and b["k"] == a["k"] and b["t"] is not None
                and (b["t"] < a["t"] if strict else b["t"] <= a["t"])]
        out[a["rid"]] = max(seen)[1] if seen else None
    return out


def test_matches_brute_force(spark):
    left = rows(spark, 600, "l").unionByName(spark.createDataFrame([(1, None, 5), (2, "HOT", None), (3, "nobody", 9)], "rid long, k string, t long"))
    right = rows(spark, 500, "r").withColumn("v", F.col("rid")).unionByName(spark.createDataFrame([(7, None, 1, 7), (8, "HOT", None, 8)], "rid long, k string, t long, v long"))
    for strict in (True, False):
        got = {r["rid"]: r["v"] for r in asof.asof_join(left, right.drop("rid"), ["k"], ["t"], ["v"], strict, slices=9).collect()}
        assert got == brute(left.collect(), right.collect(), strict)


def test_hot_key_is_cut(spark):
    from touchline.operators.chunked import range_slices

    marked = range_slices(rows(spark, 3000, "x"), ["k"], ["t"], 12).where("k = 'HOT'")
    assert marked.select("_chunk").distinct().count() >= 4


def test_a_fixture_between_matches(spark, sample):
    fixtures = spark.createDataFrame([(900, "PL", "Brighton", "New Castle", "2024-08-20"), (901, "PL", "Brighton", "New Castle", "2024-08-01")],
                                     "match_id long, league string, home_team string, away_team string, d string").select(
        "match_id", "league", "home_team", "away_team", F.to_timestamp_ntz("d").alias("match_datetime"))
    got = {r["match_id"]: r for r in asof.dated_state_join(fixtures, sample, slices=3).collect()}
    rolled = {(r["match_id"], r["team"]): r["avg_points_last_5_matches"] for r in form.rolling_form(team_perspective(sample)).collect()}
    # The last home row of Brighton by 20 August is match 2, the last away row of New Castle too.
    assert got[900]["avg_points_last_5_matches_home"] == rolled[2, "Brighton"] and got[900]["avg_points_last_5_matches_away"] == rolled[2, "New Castle"]
    assert got[901]["avg_points_last_5_matches_home"] is None


def test_empty(spark, sample):
    assert asof.dated_state_join(sample.limit(0), sample).count() == 0
    assert asof.dated_state_join(sample, sample.limit(0)).where("avg_points_last_5_matches_home is not null").count() == 0


def test_joined_states_are_stored(sample, monkeypatch):
    """Ranges are sampled before rows are dealt: both sides of a join are read twice, so their windows are run before."""
    seen, real = [], asof.asof_join
    monkeypatch.setattr(asof, "asof_join", lambda left, right, *more, **named: seen.extend([left, right]) or real(left, right, *more, **named))
    asof.dated_state_join(sample, sample)
    assert len(seen) == 4 and not any("Window" in df._jdf.queryExecution().toString() for df in seen)


def test_only_keys_in_several_slices_are_listed(spark):
    from touchline.operators.chunked import range_slices, split_slices

    marked = range_slices(rows(spark, 3000, "x").unionByName(rows(spark, 400, "y").withColumn("k", F.lit(None).cast("string"))), ["k"], ["t"], 12)
    many = {r["k"] for r in marked.groupBy("k").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").collect()}
    got = split_slices(marked, ["k"]).collect()
    assert {r["k"] for r in got} == many and "HOT" in many and len(many) < 21 and len(got) <= 24
