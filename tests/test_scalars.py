"""Golden unit tests for the scalar functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as H


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_day_first_dates(spark):
    assert one(spark, H.parse_day_first(F.lit("09/08/2019"))) == dt.datetime(2019, 8, 9)
    assert one(spark, H.parse_day_first(F.lit("09/08/19"))) == dt.datetime(2019, 8, 9)
    assert one(spark, H.parse_day_first(F.lit("05/03/96"))) == dt.datetime(1996, 3, 5)
    assert one(spark, H.parse_day_first(F.lit("31/02/2020"))) is None
    assert one(spark, H.parse_day_first(F.lit("not a date"))) is None


def test_date_time(spark):
    assert one(spark, H.parse_date_time(F.lit("17/08/2024"), F.lit("15:00"))) == dt.datetime(2024, 8, 17, 15, 0)
    assert one(spark, H.parse_date_time(F.lit("17/08/2024"), F.lit(None).cast("string"))) == dt.datetime(2024, 8, 17)


def test_text_and_numbers(spark):
    assert one(spark, H.clean_text(F.lit("  Spurs "))) == "Spurs"
    assert one(spark, H.clean_text(F.lit("   "))) is None
    assert one(spark, H.to_number(F.lit("x1"))) is None
    assert one(spark, H.safe_int(F.lit("3.0"))) == 3


def test_points_and_argmax(spark):
    assert one(spark, H.home_points(F.lit("H"))) == 3 and one(spark, H.away_points(F.lit("H"))) == 0
    assert one(spark, H.home_points(F.lit("X"), unknown_as_zero=False)) is None
    assert one(spark, H.argmax_outcome(F.lit(0.4), F.lit(0.4), F.lit(0.2), "first")) == "H"
    assert one(spark, H.argmax_outcome(F.lit(0.4), F.lit(0.4), F.lit(0.2), "strict")) == "A"
    assert one(spark, H.correct_any_max(F.lit(0.4), F.lit(0.4), F.lit(0.2), F.lit("D"))) == 1


def test_market(spark):
    assert one(spark, H.implied_probability(F.lit(0))) is None
    assert one(spark, H.market_favourite(F.lit(1.5), F.lit(4.0), F.lit(6.0))) == "H"
    assert one(spark, H.market_favourite(F.lit(None), F.lit(4.0), F.lit(6.0))) is None


def test_season_codes(spark):
    assert one(spark, H.season_name(F.lit("1920"))) == "2019/2020"
    assert one(spark, H.season_name(F.lit("9900"))) == "2099/2100"
    assert one(spark, H.season_name(F.lit("1995"))) == "1995"
    assert one(spark, H.season_code(F.lit("2019/2020"))) == "1920"


def test_abbreviation_and_format(spark):
    assert one(spark, H.abbreviation_fallback(F.lit("Coventry"))) == "COV"
    assert one(spark, H.iso_date(F.lit(dt.datetime(2026, 8, 1)))) == "2026-08-01"


def test_poisson_helpers(spark):
    import math

    pmf = one(spark, H.poisson_pmf_array(F.lit(1.3)))
    assert pmf[2] == pytest.approx(math.exp(-1.3) * 1.3 ** 2 / 2)
    cdf = one(spark, H.poisson_cdf_array(F.lit(1.3)))
    assert cdf[-1] == pytest.approx(sum(pmf)) and all(a <= b for a, b in zip(cdf, cdf[1:]))
    assert one(spark, H.poisson_log_pmf(F.lit(3), F.lit(2.0))) == pytest.approx(3 * math.log(2) - 2 - math.log(6))
    assert one(spark, H.clip(F.lit(12.0), 0.01, 10.0)) == 10.0


def test_means_and_importance(spark):
    assert one(spark, H.mean_non_null([F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0)])) == 2.5
    assert one(spark, H.mean_non_null([F.lit(None).cast("double")])) is None
    assert one(spark, H.importance_score(F.lit(1800.0), F.lit(1800.0), F.lit(0.4), F.lit(0.4))) == pytest.approx(1.0)
    assert one(spark, H.importance_score(F.lit(1800.0), F.lit(1800.0), F.lit(None).cast("double"), F.lit(0.4))) == 0.0
    assert one(spark, H.importance_score(F.lit(2100.0), F.lit(1500.0), F.lit(0.5), F.lit(0.5))) == pytest.approx(0.6 * 1.0 + 0.4)
    assert one(spark, H.round_half_even(F.lit(2.665), 2)) == pytest.approx(2.66)
    assert one(spark, H.round_half_up(F.lit(2.665), 2)) == pytest.approx(2.67)


def test_defaults_pairs_percent_onehot(spark):
    assert one(spark, H.fill_default(F.lit(None).cast("int"), 0)) == 0
    a, b = H.pair_key(F.lit("Spurs"), F.lit("Arsenal"))
    assert (one(spark, a), one(spark, b)) == ("Arsenal", "Spurs")
    assert one(spark, H.percent(F.lit(0.53421), 1)) == 53.4
    assert [one(spark, c) for c in H.one_hot_outcome(F.lit("D"))] == [0.0, 1.0, 0.0]
    assert one(spark, H.min_max_normalise(F.lit(1950.0))) == pytest.approx(1.25)  # not clipped


def test_short_years_skip_the_four_digit_layouts(spark):
    """The same dates as with every layout tried in turn, which costs an exception for each that fails."""
    from touchline.functions import scalars

    texts = ["09/08/19", "9/8/19", " 09/08/99 ", "09/08/70", "09/08/69", "32/08/19", "9/13/19", "09/08/2019", "9/8/2019", "2019-08-09", "9/8/201",
             "09-08-19", "1/2/03/04", "", "x", None, "29/02/00", "29/02/1900", "09/08/19 12:00", "09/08/02019", "-9/08/19"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[scalars._parse(F.trim("t"), f) for f in scalars.DAY_FIRST_DATE_FORMATS])
    got = df.select("t", scalars.parse_day_first("t").alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got), [r for r in got if r["a"] != r["b"]]
    assert sum(r["a"] is not None for r in got) >= 9
    assert "RLIKE" in df.select(scalars.parse_day_first("t"))._jdf.queryExecution().toString()
