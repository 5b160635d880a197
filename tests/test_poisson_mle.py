"""The maximum-likelihood Poisson model against MLlib's solver, with many leagues, and at its edges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from touchline.operators import poisson


def round_robin(spark, leagues, teams):
    """Every ordered pairing once a league; goals by a hash, with more at home."""
    n = leagues * teams * teams
    x = spark.range(n).select(F.col("id").alias("match_id"), (F.col("id") % teams).alias("h"), (F.floor(F.col("id") / teams) % teams).alias("a"),
                              F.floor(F.col("id") / (teams * teams)).alias("l")).where("h <> a")
    u = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000
    league = F.concat(F.lit("L"), F.col("l"))
    goals = lambda side, extra: F.floor((u("match_id", F.lit(side)) + extra) * (1 + u("l", side) + u(F.lit("d"), "l", "a")) * 2).cast("int")
    return x.select("match_id", league.alias("league"), F.concat(F.lit("T"), "h").alias("home_team"), F.concat(F.lit("T"), "a").alias("away_team"),
                    goals("h", 0.3).alias("home_goals"), goals("a", 0.0).alias("away_goals"), F.lit("H").alias("result"))


def test_ninety_leagues(spark):
    m = round_robin(spark, 90, 25)
    fit = poisson.fit_poisson_mle(m)
    got = poisson.score_equations(m, fit)
    assert fit.rounds < 40 and got.count() == 90 * (25 + 25 + 1) and got.where("not balanced").count() == 0
    terms = poisson.mle_terms(fit)
    assert terms.count() == 90 * (25 + 25 + 2)
    # The reference level of each league, and names for all others.
    assert terms.where("team = 'T0' and estimate <> 0").count() == 0


def test_equals_the_general_solver(spark):
    """One league: the terms of MLlib's Poisson regression with the first team as reference."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from touchline.operators.perspective import team_perspective

    m = round_robin(spark, 1, 5)
    long = team_perspective(m, stats=[])
    names = [f"T{i}" for i in range(1, 5)]
    x = long.select(F.col("goals_scored").cast("double").alias("label"), F.col("is_home").cast("double").alias("home"),
                    *[(F.col("team") == t).cast("double").alias(f"a{t}") for t in names],
                    *[(-(F.col("opponent") == t).cast("double")).alias(f"d{t}") for t in names])
    cols = x.columns[1:]
    model = GeneralizedLinearRegression(family="poisson", link="log").fit(VectorAssembler(inputCols=cols, outputCol="features").transform(x))
    want = dict(zip(cols, model.coefficients, strict=True)) | {"intercept": model.intercept}
    got = {r["term"] if r["team"] is None else r["term"][0] + r["team"]: r["estimate"]
           for r in poisson.mle_terms(poisson.fit_poisson_mle(m, tolerance=1e-7)).collect()}
    assert got.pop("aT0") == 0 and got.pop("dT0") == 0
    assert set(got) == set(want)
    assert {k: (got[k], want[k]) for k in want if not math.isclose(got[k], want[k], abs_tol=1e-4)} == {}


def test_teams_without_goals(spark, sample):
    """A team that never scored has factor 0 and no finite term; the other equations still hold."""
    m = sample.withColumn("home_goals", F.when(F.col("home_team") == "Brighton", 0).otherwise(F.col("home_goals"))).withColumn(
        "away_goals", F.when(F.col("away_team") == "Brighton", 0).otherwise(F.col("away_goals")))
    fit = poisson.fit_poisson_mle(m, max_rounds=10)
    assert fit.teams.where("team = 'Brighton'").first()["attack"] == 0
    assert poisson.mle_terms(fit).where("term = 'attack' and team = 'Brighton'").first()["estimate"] is None


def test_empty(spark, sample):
    fit = poisson.fit_poisson_mle(sample.limit(0))
    assert fit.teams.count() == 0 and poisson.mle_terms(fit).count() == 0


def test_nothing_is_broadcast(spark):
    """The rounds and the score equations run where no table may be broadcast: states would else pass the driver."""
    m = round_robin(spark, 3, 6)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        fit = poisson.fit_poisson_mle(m, tolerance=1e-5)
        assert poisson.score_equations(m, fit).where("balanced").count() == 3 * 13
        assert poisson.mle_terms(fit).count() == 3 * 14
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
