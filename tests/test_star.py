"""Star load on the reference's four-match sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import elo, star


def test_star_from_sample(sample):
    st = star.load_star(sample, ratings=elo.elo_ratings(sample))
    counts = {r["table"]: r["rows"] for r in star.load_counts(st).collect()}
    assert counts == {"leagues": 1, "seasons": 1, "teams": 3, "matches": 4, "match_stats": 4, "team_ratings": 8}
    assert st["seasons"].collect()[0]["name"] == "2024/2025"  # two-year code 2425
    assert sorted((r["id"], r["name"]) for r in st["teams"].collect()) == [
        (1, "Brighton"), (2, "Manchester City"), (3, "New Castle")]
    report = {(r["child"], r["column"]): r["orphans"] for r in star.foreign_key_report(st).collect()}
    absent = {k for k in report if k[0] in ("match_market_odds", "predictions_summary", "predicted_top_scores")}
    assert len(report) == 11 and all(report[k] is None if k in absent else report[k] == 0 for k in report)
    back = star.clean_from_star(st).orderBy("match_id").collect()
    assert [(r["home_team"], r["away_team"], r["home_goals"], r["away_goals"], r["season"]) for r in back][0] == (
        "Brighton", "Manchester City", 2, 1, "2425")


def test_insert_if_absent_keeps_first_and_skips_existing(spark, sample):
    key = list(star.NATURAL_MATCH_KEY)
    batch = sample.select("match_id", *key)
    dup = batch.where("match_id = 2").withColumn("match_id", batch.match_id + 100)
    target = batch.where("match_id = 1")
    out = star.insert_if_absent(target, batch.unionByName(dup), key, ["match_id"])
    assert sorted(r["match_id"] for r in out.collect()) == [1, 2, 3, 4]


def test_reject_rows_quarantines_unknown_teams(spark, sample):
    seasons = sample.select("league", "season").distinct()
    teams = spark.createDataFrame([("Brighton",), ("New Castle",)], "name string")
    accepted, rejected = star.reject_rows(sample, seasons, teams)
    assert sorted(r["match_id"] for r in accepted.collect()) == [2, 4]
    assert {r["reason"] for r in rejected.collect()} == {"unknown_team"}


def test_load_honours_the_match_key_and_trims_names(spark, sample):
    """A repeated match with padded names is ignored; a load of both batches has each match once."""
    again = sample.where("match_id < 3").withColumn("match_id", sample.match_id + 100).withColumn("home_team", F.concat(F.lit("  "), "home_team"))
    st = star.load_star(sample.unionByName(again))
    counts = {r["table"]: r["rows"] for r in star.load_counts(st).collect()}
    assert counts["matches"] == counts["match_stats"] == 4 and counts["teams"] == 3
    keys = {"matches": ["season_id", "date", "home_team_id", "away_team_id"], "absent": ["id"]}
    assert {r["table"]: r["duplicate_rows"] for r in star.check_unique(st, keys).collect()} == {"matches": 0, "absent": None}


def test_required_columns_in_one_pass(sample):
    got = {r["column"]: (r["present"], r["nulls"]) for r in star.check_required(sample, ["home_team", "result", "nothing"]).collect()}
    assert got == {"home_team": (True, 0), "result": (True, 0), "nothing": (False, None)}


def test_dimensions_are_read_before_repeats_are_dropped(sample, monkeypatch):
    """The names of the dimensions come from the rows as they are; only the facts shuffle whole rows."""
    seen, real = [], star.assign_surrogate_keys
    monkeypatch.setattr(star, "assign_surrogate_keys", lambda names, key, *more: seen.append(names) or real(names, key, *more))
    star.load_star(sample)
    assert len(seen) == 3 and not any("min_by" in names._jdf.queryExecution().toString() for names in seen)


def test_foreign_keys_are_counted_without_joins(spark):
    """An orphan counts once, however often the id of another parent repeats; a null reference is none."""
    st = {"matches": spark.createDataFrame([(1, 1, 1, 7), (1, 1, 1, None), (2, None, 1, 1)], "id long, season_id long, home_team_id long, away_team_id long"),
          "teams": spark.createDataFrame([(1,)], "id long"), "seasons": spark.createDataFrame([(1, None)], "id long, league_id long"),
          "team_ratings": spark.createDataFrame([(1, 9, 1), (3, 1, None), (3, 1, 1)], "match_id long, team_id long, season_id long")}
    report = star.foreign_key_report(st)
    got = {(r["child"], r["column"]): r["orphans"] for r in report.collect()}
    assert len(got) == 11 and {k: v for k, v in got.items() if v is not None} == {
        ("matches", "season_id"): 0, ("matches", "home_team_id"): 0, ("matches", "away_team_id"): 1,
        ("team_ratings", "match_id"): 2, ("team_ratings", "team_id"): 1, ("team_ratings", "season_id"): 0}
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()
