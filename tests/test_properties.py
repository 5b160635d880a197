"""Invariants: probabilities, sliced windows, idempotence, order independence, leak guard."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.operators import chunked, clean, evaluate, form, poisson, star
from touchline.sources.tables import contests, fixtures_from_contests


@pytest.fixture(scope="module")
def c(spark):
    return contests(spark, SMALL)


def test_probabilities_sum_to_one(c):
    train, test = evaluate.season_split(c, "2001")
    p = poisson.outcome_probabilities(poisson.expected_goals(test, poisson.team_strengths(train)))
    worst = p.agg(F.max(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1))).collect()[0][0]
    assert worst < 1e-9


def test_leak_guard_rejects_same_match_stats():
    with pytest.raises(ValueError):
        clean.leak_guard(["avg_points_last_5_matches_home", "home_shots"], form.feature_columns())


def test_insert_if_absent_idempotent(spark, c):
    key = list(star.NATURAL_MATCH_KEY)
    base = c.select("match_id", *key)
    target = base.where(F.col("season") < "1998")
    once = star.insert_if_absent(target, base, key, ["match_id"])
    twice = star.insert_if_absent(once, base, key, ["match_id"])
    assert once.count() == twice.count()
    assert sorted(once.collect()) == sorted(twice.collect())


def test_order_independence(spark, c):
    shuffled = c.orderBy(F.rand(11)).repartition(7)
    from touchline.operators import tables

    a = sorted(tables.league_table_asof(c).collect())
    b = sorted(tables.league_table_asof(shuffled).collect())
    assert a == b


def test_fraction_split_matches_percent_rank(spark, c):
    w = Window.partitionBy("league").orderBy("match_datetime", "match_id")
    expected = sorted(r[0] for r in c.select("match_id", F.percent_rank().over(w).alias("pr")).where("pr < 0.8").collect())
    train, test = evaluate.fraction_split(c, 0.8)
    assert sorted(r[0] for r in train.select("match_id").collect()) == expected
    assert train.count() + test.count() == c.count()


def test_star_constraints_hold(spark, c):
    st = star.load_star(c)
    assert all(r["orphans"] in (0, None) for r in star.foreign_key_report(st).collect())
    assert all(r["duplicate_rows"] == 0 for r in star.check_unique(st, {"teams": ["name"], "matches": ["id"]}).collect())
    violations = {r["rule"]: r["violations"] for r in star.check_domain(st["matches"]).collect()}
    assert violations["distinct_sides"] == 0 and violations["result_domain"] == 0


def _timed(spark, days: int, per_day: int, hashed: bool):
    """Matches of three teams with several kick-off times a day, equal times, and small or 64-bit hashed ids."""
    n = days * per_day
    ids = F.xxhash64("id") if hashed else F.col("id")
    at = F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id div {per_day} as int), cast(id % {per_day} div 2 as int))")
    team = lambda k: F.concat(F.lit("t"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) + k) % 3)
    return spark.range(n).select(ids.alias("match_id"), F.lit("L").alias("league"), F.lit("1").alias("season"), at.alias("match_datetime"),
                                 team(0).alias("home_team"), team(1).alias("away_team"), (F.col("id") % 4).cast("int").alias("home_goals"),
                                 (F.col("id") % 3).cast("int").alias("away_goals"))


@pytest.mark.parametrize("hashed", [False, True])
def test_sliced_windows_equal_plain_windows(spark, hashed):
    """Kick-off times, equal timestamps, hashed ids; one day holds most rows of a key."""
    long = _timed(spark, 3, 160, hashed).select("match_id", "league", F.col("home_team").alias("team"), "match_datetime", "home_goals")
    keys, order = ["league", "team"], ["match_datetime", "match_id"]
    spec = {"v": lambda w: F.sum(F.col("home_goals") * F.col("home_goals")).over(w.rowsBetween(-5, -1)),
            "p": lambda w: F.max("match_id").over(w.rowsBetween(-1, -1))}
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = long.select("match_id", *[f(w).alias(k) for k, f in spec.items()], F.row_number().over(w).cast("long").alias("rn"))
    for slices in (1, 7, 40):
        split = chunked.bounded_window(long, keys, order, spec, 5, ["home_goals"], slices).select("match_id", "v", "p")
        number = chunked.bounded_row_number(long, keys, order, "rn", slices).select("match_id", "rn")
        assert sorted(split.join(number, "match_id").collect()) == sorted(plain.collect())


def test_slices_cut_a_hot_key(spark):
    long = _timed(spark, 2, 400, True)
    marked = chunked.range_slices(long, ["league"], ["match_datetime", "match_id"], 8)
    sizes = [r["count"] for r in marked.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 300


def _form_of(c):
    from touchline.operators.perspective import team_perspective

    return {(r.match_id, r.team): r.avg_shots_last_5_matches
            for r in form.rolling_form(team_perspective(c)).select("match_id", "team", "avg_shots_last_5_matches").collect()}


def test_one_match_moves_only_later_features(spark, c):
    """V7: raising one match's shots leaves its own features alone and moves its teams' next ones."""
    one = c.orderBy("match_datetime", "match_id").limit(1).collect()[0]
    hit = F.col("match_id") == one.match_id
    bumped = c.withColumns({s: F.when(hit, F.col(s) + 1000).otherwise(F.col(s)) for s in ("home_shots", "away_shots")})
    before, after = _form_of(c), _form_of(bumped)
    moved = {k for k in before if before[k] != after[k]}
    assert moved and one.match_id not in {m for m, _ in moved}
    assert {t for _, t in moved} == {one.home_team, one.away_team}


def test_the_leak_test_sees_a_leak(spark, c):
    """A window that includes the current match does change its own row."""
    from touchline.operators.perspective import team_perspective

    one = c.orderBy("match_datetime", "match_id").limit(1).collect()[0]
    w = Window.partitionBy("league", "team").orderBy("match_datetime", "match_id").rowsBetween(-4, 0)
    leaky = lambda d: {(r.match_id, r.team): r.v for r in team_perspective(d).select(
        "match_id", "team", F.avg("shots").over(w).alias("v")).collect()}
    a, b = leaky(c), leaky(c.withColumn("home_shots", F.when(F.col("match_id") == one.match_id, F.col("home_shots") + 1000).otherwise(F.col("home_shots"))))
    assert one.match_id in {m for (m, t) in a if a[m, t] != b[m, t]}


def test_checkpoint_dir_must_be_named_off_local_mode(monkeypatch, spark):
    from touchline import session

    monkeypatch.setattr(session, "is_local", lambda s: False)

    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Unset())


def test_forest_depth_is_not_lowered_in_silence():
    from touchline.operators import forest

    with pytest.raises(ValueError):
        forest.train_forest(None, [], max_depth=31)


def test_state_before_last_equals_the_rolled_history(spark):
    """From the last rows alone, a team with most of the rows included: the rolled value on each side's last row."""
    from pyspark.sql import functions as F

    from touchline.operators import form

    rows = [(1 + i // 7, "A", "hot" if i % 3 else f"t{i % 5}", i, i % 4 == 0, (i * 7) % 11) for i in range(400)]
    long = spark.createDataFrame(rows, "d int, league string, team string, match_id long, is_home boolean, points int").select(
        F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz").alias("match_datetime"), "league", "team", "match_id", "is_home", "points")
    rolled = form.rolling_form(long, (5, 3), ["points"])
    cols = [form.form_column("points", n) for n in (5, 3)]
    for side in (F.col("is_home"), ~F.col("is_home")):
        want = {(r.team, r[cols[0]], r[cols[1]]) for r in form.latest_per_team(rolled.where(side), cols).collect()}
        got = {(r.team, r[cols[0]], r[cols[1]]) for r in form.state_before_last(long, side, ["points"], (5, 3), slices=4).collect()}
        assert got == want and len(got) > 4
