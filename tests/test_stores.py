"""Stored predictions, market odds and team names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from touchline.operators import aliases, odds
from touchline.operators.prediction_store import PredictionStore


def predictions(spark, rows):
    return spark.createDataFrame(rows, "match_id long, model_name string, p_home double, p_draw double, p_away double")


def test_a_second_run_replaces_its_own_rows(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path), buckets=3)
    assert store.summary().count() == 0
    store.upsert_summary(predictions(spark, [(i, m, 0.5, 0.25, 0.25) for i in range(10) for m in ("a", "b")]), "v1")
    store.upsert_summary(predictions(spark, [(i, "a", 0.123456, 0.5, 0.376544) for i in (3, 7, 42)]), "v2")
    got = {(r["match_id"], r["model_name"]): (r["model_version"], str(r["prob_home_win"])) for r in store.summary().collect()}
    assert got == {**{(i, m): ("v1", "0.5000") for i in range(10) for m in ("a", "b")}, **{(i, "a"): ("v2", "0.1235") for i in (3, 7, 42)}}
    assert dict(store.summary().dtypes)["prob_draw"] == "decimal(5,4)"
    store.upsert_summary(predictions(spark, []), "v3")
    assert store.summary().count() == 21


def test_fewer_top_scores_replace_more(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path))
    schema = "match_id long, model_name string, rank_order int, home_goals int, away_goals int, probability double"
    store.upsert_top_scores(spark.createDataFrame([(1, "a", r, r, 0, 0.1) for r in (1, 2, 3)] + [(2, "a", 1, 0, 0, 0.2)], schema))
    store.upsert_top_scores(spark.createDataFrame([(1, "a", 1, 4, 4, 0.3)], schema))
    assert sorted((r["match_id"], r["rank_order"], r["home_goals"]) for r in store.top_scores().collect()) == [(1, 1, 4), (2, 1, 0)]


def test_bad_runs_raise_and_change_nothing(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path))
    store.upsert_summary(predictions(spark, [(1, "a", 0.5, 0.25, 0.25)]), "v1")
    for rows in ([(1, "a", 1.5, 0.0, 0.0)], [(1, "a", None, 0.5, 0.5)], [(2, "a", 0.5, 0.25, 0.25)] * 2):
        with pytest.raises(ValueError):
            store.upsert_summary(predictions(spark, rows), "v2")
    assert [(r["match_id"], r["model_version"]) for r in store.summary().collect()] == [(1, "v1")]


def test_market_odds_take_odds_columns_only(spark):
    header = ["B365H", "bwh", "B365D", "PSA", "VCCH", "HTH", "FTHG", "YH", "Avg", "B365>2.5", "HTR", "AHH"]
    assert odds.odds_families(header) == {"H": ["B365H", "bwh"], "D": ["B365D"], "A": ["PSA"]}
    raw = spark.createDataFrame([(1, "1.5", "2", "3.1", "x", "9"), (2, None, "1.333", None, None, "9"), (3, None, "", "n/a", " ", "9")],
                                "match_id long, B365H string, BWH string, B365D string, PSA string, HTH string")
    got = [[None if v is None else str(v) for v in r] for r in odds.market_odds(raw).orderBy("match_id").collect()]
    assert got == [["1", "1.500", "3.100", None, "1.750", "3.100", None], ["2", None, None, None, "1.333", None, None], ["3"] + [None] * 6]


def test_names_resolve_both_ways(spark):
    dim = aliases.known_teams(spark)
    rows = [("MUN", " man utd "), ("Spurs", "TOT"), ("Nottingham   Forest", "Brighton"), ("Real", None)]
    got = [tuple(r) for r in aliases.resolve_teams(spark.createDataFrame(rows, "home_team string, away_team string"), dim).orderBy("home_team").collect()]
    assert got == [("Man United", "Man United", "MUN", True, "MUN", True), ("Nott'm Forest", "Brighton", "NFO", True, "BHA", True),
                   ("Real", None, "REA", False, None, False), ("Tottenham", "Tottenham", "TOT", True, "TOT", True)]
    # Every team's own abbreviation leads back to it.
    back = aliases.resolve_teams(dim.select(F.col("abbreviation").alias("name"), F.col("team").alias("want")).distinct(), dim, ["name"])
    assert back.count() == len(aliases.TEAM_NAMES) and back.where("name <> want or not name_known").count() == 0
