"""Batches added to stored tables: idempotent, whole or not at all, rejects kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from touchline.operators import elo
from touchline.operators.star_store import KEYS, StarStore


def odds(c):
    return c.select("match_id", F.lit(1.5).alias("b365_home_win_odds"), F.lit(1.75).alias("market_avg_home_win_odds"))


def counts(store, upto=None):
    return {n: t.count() for n, t in store.tables(upto).items()}


def test_two_loads_of_one_batch(spark, sample, tmp_path):
    store = StarStore(spark, str(tmp_path))
    extra = odds(sample).unionByName(odds(sample.limit(1)).withColumn("match_id", F.lit(99).cast("long")))
    assert store.load("a", sample, extra, elo.elo_ratings(sample))
    once = counts(store)
    assert once == {"leagues": 1, "seasons": 1, "teams": 3, "matches": 4, "match_stats": 4, "match_market_odds": 4, "team_ratings": 8}
    assert not store.load("a", sample, extra)
    assert store.load("again", sample.withColumn("match_id", F.col("match_id") + 500), odds(sample).withColumn("match_id", F.col("match_id") + 500), None)
    assert counts(store) == once and store.batches() == ["a", "again"]
    assert [(r["table"], r["reason"], r["source_id"]) for r in store.table("quarantine").collect()] == [("match_market_odds", "no_match", 99)]


def test_later_batches_keep_ids_and_add_rows(spark, sample, tmp_path):
    store = StarStore(spark, str(tmp_path))
    store.load("early", sample.where("match_id <= 2"))
    before = {r["name"]: r["id"] for r in store.table("teams").collect()}
    store.load("all", sample.withColumn("league", F.when(F.col("match_id") == 4, " Second ").otherwise(F.col("league"))))
    after = {r["name"]: r["id"] for r in store.table("teams").collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    assert sorted(r["name"] for r in store.table("leagues").collect()) == ["PL", "Second"]
    assert counts(store, "early")["matches"] == 2 and counts(store)["matches"] == 4
    for name, key in KEYS.items():
        assert store.table(name).groupBy(*key).count().where("count > 1").count() == 0


def test_a_killed_load_leaves_nothing(spark, sample, tmp_path, monkeypatch):
    store = StarStore(spark, str(tmp_path))
    store.load("a", sample.where("match_id = 1"))
    seen = counts(store)

    def die(batch):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_commit", die)
    with pytest.raises(RuntimeError):
        store.load("b", sample)
    assert counts(store) == seen and counts(StarStore(spark, str(tmp_path))) == seen
    again = StarStore(spark, str(tmp_path))
    assert again.load("b", sample) and counts(again)["matches"] == 4


def test_rejects_have_reasons(spark, sample, tmp_path):
    bad = (sample.withColumn("home_team", F.when(F.col("match_id") == 1, "  ").otherwise(F.col("home_team")))
           .withColumn("home_goals", F.when(F.col("match_id") == 2, None).otherwise(F.col("home_goals")))
           .withColumn("result", F.when(F.col("match_id") == 3, "X").otherwise(F.col("result"))))
    store = StarStore(spark, str(tmp_path))
    store.load("a", bad, odds(sample))
    got = {(r["table"], r["source_id"]): r["reason"] for r in store.table("quarantine").collect()}
    assert got == {("matches", 1): "unknown_team", ("matches", 2): "missing_goals", ("matches", 3): "bad_result",
                   **{("match_market_odds", i): "no_match" for i in (1, 2, 3)}}
    assert counts(store)["matches"] == 1 and counts(store)["teams"] == 2


def test_empty_batch(spark, sample, tmp_path):
    store = StarStore(spark, str(tmp_path))
    assert store.load("nothing", sample.limit(0)) and set(counts(store).values()) == {0}


def test_a_load_reads_its_matches_few_times(spark, sample, tmp_path):
    """The judged matches are written once; dimensions, facts and rejects do not derive them again."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    odds = sample.select("match_id", F.lit(2.0).alias("b365_home_win_odds"))
    ratings = sample.select("match_id", F.lit(1500.0).alias("elo_home_pre"), F.lit(1490.0).alias("elo_away_pre"))
    store = StarStore(spark, str(tmp_path))
    assert store.load("a", sample.withColumn("result", seen("result")), odds, ratings)
    assert store.table("matches").count() == 4 and store.table("team_ratings").count() == 8
    assert read.value <= 2 * 4
