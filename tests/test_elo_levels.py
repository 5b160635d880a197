"""Elo level by level equals the fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import elo, elo_levels


def ladder(spark, teams, matches, leagues=1):
    """Matches of pseudo-random pairs under hashed 64-bit ids, several a day."""
    x = spark.range(matches * leagues).select(
        F.xxhash64("id").alias("match_id"), F.concat(F.lit("L"), F.col("id") % leagues).alias("league"),
        (F.lit("2020-01-01").cast("date") + (F.col("id") / 50).cast("int")).cast("timestamp_ntz").alias("match_datetime"),
        F.pmod(F.xxhash64("id", F.lit("h")), F.lit(teams)).alias("h"), F.pmod(F.xxhash64("id", F.lit("s")), F.lit(teams - 1)).alias("s"),
        F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.pmod(F.xxhash64("id", F.lit("r")), F.lit(3)) + 1).cast("int")).alias("result"))
    return x.select("match_id", "league", "match_datetime", F.concat(F.lit("T"), "h").alias("home_team"),
                    F.concat(F.lit("T"), (F.col("h") + 1 + F.col("s")) % teams).alias("away_team"), "result")


def test_equals_the_fold(spark):
    c = ladder(spark, 150, 400, leagues=2).cache()
    cols = ["match_id", "league", "elo_home_pre", "elo_away_pre", "elo_diff"]
    got = elo_levels.elo_by_level(c).cache()
    near = lambda rows: sorted((r[0], r[1], *[round(x, 5) for x in r[2:]]) for r in rows)
    assert near(got.select(*cols).collect()) == near(elo.elo_ratings(c).select(*cols).collect())
    # A level holds many matches of one league, none of them sharing a team.
    sides = got.join(c.drop("league"), "match_id").select("league", "level", F.explode(F.array("home_team", "away_team")).alias("t"))
    assert sides.groupBy("league", "level", "t").count().where("count > 1").count() == 0
    assert got.where("league = 'L0' and level = 1").count() > 20


def test_levels_are_the_longest_chain(spark, sample):
    got = {r["match_id"]: r["level"] for r in elo_levels.elo_by_level(sample).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_empty(spark, sample):
    assert elo_levels.elo_by_level(sample.limit(0)).count() == 0


def test_leagues_are_folded_in_many_tasks(spark, sample):
    """Few bytes are not few matches to fold: the leagues are dealt to one partition a core."""
    assert elo.elo_ratings(sample).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_fold_of_arrow_batches(spark, sample):
    """The fold takes Arrow batches; teams without a name, one team on both sides and rows seeded by an earlier season keep their order."""
    odd = sample.withColumn("away_team", F.expr("CASE match_id WHEN 2 THEN NULL WHEN 3 THEN home_team ELSE away_team END")).withColumn(
        "league", F.expr("CASE WHEN match_id > 1 THEN 'PL' END"))
    c = odd.unionByName(odd.withColumns({"match_id": F.col("match_id") + 10, "season": F.lit("2526"), "match_datetime": F.expr("match_datetime + INTERVAL '1' YEAR")}))
    table, want = {}, {}
    for r in c.orderBy("match_datetime", "match_id").collect():
        h, a = (r["league"], r["home_team"]), (r["league"], r["away_team"])
        rh, ra = table.get(h, 1500.0), table.get(a, 1500.0)
        e, s = 1.0 / (1.0 + 10.0 ** ((ra - rh) / 400.0)), {"H": 1.0, "D": 0.5}.get(r["result"], 0.0)
        table[h] = rh + 32.0 * (s - e)
        table[a] = ra + 32.0 * ((1.0 - s) - (1.0 - e))
        want[r["match_id"]] = (round(rh, 6), round(ra, 6))
    for chunk in (None, "season"):
        x = elo.elo_ratings(c, chunk=chunk)
        assert {r["match_id"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in x.collect()} == want
    assert "MapInArrow" in elo.elo_ratings(c)._jdf.queryExecution().executedPlan().toString()
