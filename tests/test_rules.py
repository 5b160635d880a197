"""Rarer branches: seeded split, header job, quartiles, gates, promoted form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.operators import evaluate, forest
from touchline.plans import queries_rules
from touchline.sources import files


def test_seeded_split_is_stable(spark):
    a, b = ({r["match_id"]: r["part"] for r in queries_rules.q_fraction_split_seeded(spark, SMALL).collect()} for _ in range(2))
    share = sum(p == "train" for p in a.values()) / len(a)
    assert a == b and 0.75 < share < 0.85


def test_headers_in_one_job(spark, tmp_path):
    """Layouts of many small files, latin-1 names, odd paths, an empty file and equal headers."""
    bodies = {"a b.csv": "Date,Café\n1,2\n", "c%.csv": "Date,Café\n3,4\n", "d.csv": "Date,Other\n", "empty.csv": "", "e.csv": "Date,Café\n"}
    for name, text in bodies.items():
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    got = files.layouts(files.read_headers(spark, files.list_files(spark, f"{tmp_path}/*.csv")))
    assert [(cols, sorted(p.rsplit("/", 1)[1] for p in paths)) for cols, paths in got] == [
        (("Date", "Café"), ["a b.csv", "c%.csv", "e.csv"]), (("Date", "Other"), ["d.csv"])]
    df = files.read_seasons(spark, files.list_files(spark, f"{tmp_path}/*.csv"))
    assert sorted((r["Date"], r["Café"]) for r in df.select("Date", "Café").collect()) == [("1", "2"), ("3", "4")]


def test_planning_of_ten_thousand_files(spark):
    headers = spark.range(10000).select(F.concat(F.lit("file:/s/"), "id").alias("path"), F.concat(F.lit("Date,X"), F.col("id") % 3).alias("line"))
    got = files.layouts(headers)
    assert [c for c, _ in got] == [("Date", "X0"), ("Date", "X1"), ("Date", "X2")] and sum(len(p) for _, p in got) == 10000


def test_profile_of_any_values(spark):
    rows = [(None, 1.5), (2, None), (2, -3.25), (9, 1.5), (4, 100.0)]
    df = spark.createDataFrame(rows, "a int, b double")
    got = {r["column"]: r for r in evaluate.profile(df, ["a", "b"], slices=3).collect()}
    want = df.select(*[F.percentile(c, q).alias(f"{c}{i}") for c in ("a", "b") for i, q in enumerate((0.25, 0.5, 0.75))], F.round(F.stddev_samp("b"), 6).alias("s")).first()
    assert [got["a"][p] for p in ("p25", "p50", "p75")] == [want["a0"], want["a1"], want["a2"]]
    assert [got["b"][p] for p in ("p25", "p50", "p75")] == [want["b0"], want["b1"], want["b2"]] and got["b"]["std"] == want["s"]
    assert (got["a"]["rows"], got["a"]["nulls"], got["a"]["min"], got["a"]["max"]) == (5, 1, 2, 9)
    empty = evaluate.profile(df.where("a = -1").unionByName(df.limit(0)), ["a"]).collect()
    assert empty == []


def test_a_side_without_matches_has_its_gate(spark):
    """Six matches each, but the home side never at home."""
    rows = [(i, "L", "x", "A" if i % 2 else "B") for i in range(12)]
    history = spark.createDataFrame([(i, lg, o + str(i), t) for i, lg, o, t in rows], "match_id long, league string, home_team string, away_team string").select(
        "*", F.lit("H").alias("result"), F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"), F.lit("s").alias("season"), F.lit("2020-01-01").cast("timestamp_ntz").alias("match_datetime"))
    fixtures = spark.createDataFrame([("L", 1, "A", "B"), ("L", 2, "A", "new")], "league string, fixture_id long, home_team string, away_team string")
    got = {r["fixture_id"]: (r["league"], r["gate"], r["prior_home"]) for r in forest.fixture_gates(fixtures, history).collect()}
    assert got == {1: ("L", "no_side", 0.45), 2: ("L", "away_new", 0.65)}


def test_promoted_teams_get_the_median(spark):
    latest = spark.createDataFrame([("L", "A", 1.0), ("L", "B", 2.0), ("L", "C", None), ("M", "D", 9.0)], "league string, team string, f double")
    targets = spark.createDataFrame([("L", "A", "N"), ("L", "C", "B"), ("Z", "N", "O")], "league string, home_team string, away_team string")
    got = {(r["league"], r["team"]): (r["promoted"], r["f"]) for r in forest.promoted_form(targets, latest, ["f"]).collect()}
    assert got == {("L", "A"): (False, 1.0), ("L", "B"): (False, 2.0), ("L", "C"): (False, None), ("L", "N"): (True, 1.5), ("Z", "N"): (True, None), ("Z", "O"): (True, None)}
