"""Hand goldens on the reference's four-match sample (worked out from the definitions)."""

from __future__ import annotations

import pytest

from touchline.operators import elo, perspective, tables


def test_league_table(sample):
    rows = {r["team"]: r for r in tables.league_table_asof(sample).collect()}
    assert (rows["Brighton"]["total_points"], rows["Brighton"]["goals_difference"], rows["Brighton"]["position"]) == (7, 3, 1)
    assert (rows["New Castle"]["total_points"], rows["New Castle"]["goals_difference"], rows["New Castle"]["position"]) == (4, 0, 2)
    assert (rows["Manchester City"]["total_points"], rows["Manchester City"]["goals_difference"]) == (0, -3)


def test_goals_for_against(sample):
    rows = {r["team"]: (r["goals_for"], r["goals_against"]) for r in tables.team_season_goals(sample).collect()}
    assert rows == {"Brighton": (6, 3), "New Castle": (4, 4), "Manchester City": (1, 4)}


def test_head_to_head_pair(sample):
    r = tables.head_to_head_pair(sample, "Brighton", "New Castle").collect()[0]
    assert (r["total_matches"], r["team_a_wins"], r["draws"], r["team_b_wins"], r["team_a_goals"], r["team_b_goals"]) == (2, 1, 1, 0, 4, 2)


def test_head_to_head_no_meeting_counts_zero_sums_null(sample):
    r = tables.head_to_head_pair(sample, "Brighton", "Nobody").collect()[0]
    assert r["total_matches"] == 0 and r["team_a_wins"] is None


def test_elo_goldens(sample):
    got = {r["match_id"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in elo.elo_ratings(sample).collect()}
    assert got[1] == (1500.0, 1500.0)
    assert got[2] == (1516.0, 1500.0)
    assert got[3] == pytest.approx((1484.0, 1500.736307), abs=1e-6)
    assert got[4] == pytest.approx((1515.966167, 1515.263693), abs=1e-6)
    final = {r["team"]: r["rating"] for r in elo.final_ratings(sample).collect()}
    assert final["Brighton"] == pytest.approx(1531.296043, abs=1e-6)
    assert final["Manchester City"] == pytest.approx(1468.770140, abs=1e-6)
    assert final["New Castle"] == pytest.approx(1499.933817, abs=1e-6)
    assert sum(final.values()) == pytest.approx(3 * 1500.0)  # Elo is conserved per match


def test_elo_chunked_equals_single_pass(spark, sample):
    one = sorted(elo.elo_ratings(sample).collect())
    chunked = sorted(elo.elo_ratings(sample.withColumn("season", sample.match_id.cast("string")), chunk="season").collect())
    assert one == chunked


def test_team_perspective_two_rows_per_match(sample):
    long = perspective.team_perspective(sample)
    assert long.count() == 8
    assert {r["team"] for r in long.where("is_home").collect()} == {"Brighton", "Manchester City", "New Castle"}


def test_elo_by_season_keeps_64_bit_ids(spark):
    """Seeds carried between seasons never turn ids into floats."""
    from pyspark.sql import functions as F

    base = spark.range(400).select(
        F.xxhash64("id").alias("match_id"), F.lit("L").alias("league"), (F.lit(2000) + F.col("id") % 4).cast("string").alias("season"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 4 as int) * 400 + cast(id div 4 as int))").alias("match_datetime"),
        F.concat(F.lit("t"), F.col("id") % 7).alias("home_team"), F.concat(F.lit("t"), (F.col("id") + 3) % 7).alias("away_team"),
        F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.col("id") % 3 + 1).cast("int")).alias("result"))
    once = sorted(elo.elo_ratings(base).collect())
    assert sorted(elo.elo_ratings(base, chunk="season").collect()) == once
    assert {r.match_id for r in base.select("match_id").collect()} == {r.match_id for r in once}
