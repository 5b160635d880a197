"""Scalar column functions.

Every helper returns a ``Column`` built from built-in Spark SQL functions so
it stays inside whole-stage codegen; none of them is a Python UDF. ANSI mode
is on by default in Spark 4, so parsing/casting/division use the ``try_``
variants that turn bad input into NULL (the reference's "coerce" behaviour).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome codes and points, as in the reference.
OUTCOMES = ("H", "D", "A")
POINTS_WIN, POINTS_DRAW, POINTS_LOSS = 3, 1, 0

# Accepted day-first date layouts (four-digit years first, then two-digit).
DAY_FIRST_DATE_FORMATS = ("dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd/MM/yy", "d/M/yy")
SHORT_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"  # no layout with a four-digit year takes these
TWO_DIGIT_YEAR_PIVOT = 2069  # two-digit years above this (parsed as 20yy) belong to the 1900s
DAY_FIRST_DATETIME_FORMATS = ("dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yy HH:mm")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_day_first(x: Column | str, formats: Sequence[str] = DAY_FIRST_DATE_FORMATS) -> Column:
    """H1: day-first date parse; unparseable → NULL. Result is ``timestamp_ntz``.

    A two-digit pattern never wins over a four-digit one because every
    pattern is tried in order and the four-digit ones come first. A text that
    ends in a two-digit year skips them: each would fail, which costs an exception a row.
    """
    s = F.trim(_c(x).cast("string"))
    short = s.rlike(SHORT_DATE)
    return F.coalesce(*[F.when(~short, _parse(s, f)) if "yyyy" in f else _parse(s, f) for f in formats])


def _parse(s: Column, fmt: str) -> Column:
    """One layout; two-digit years (read by Spark as 20yy) get the century pivot."""
    ts = F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")
    if "yyyy" not in fmt and "yy" in fmt:
        ts = F.when(F.year(ts) > TWO_DIGIT_YEAR_PIVOT, ts - F.expr("INTERVAL '100' YEAR")).otherwise(ts)
    return ts


def parse_date_time(date: Column | str, time: Column | str | None) -> Column:
    """H2: date plus optional ``HH:mm`` kickoff → timestamp; date alone if no time."""
    d = F.trim(_c(date).cast("string"))
    if time is None:
        return parse_day_first(d)
    t = F.trim(_c(time).cast("string"))
    with_time = F.coalesce(*[_parse(F.concat_ws(" ", d, t), f) for f in DAY_FIRST_DATETIME_FORMATS])
    return F.when(t.isNull() | (t == ""), parse_day_first(d)).otherwise(F.coalesce(with_time, parse_day_first(d)))


def clean_text(x: Column | str) -> Column:
    """H3: trim; empty string → NULL."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def to_number(x: Column | str, dtype: str = "double") -> Column:
    """H4: numeric coercion, bad → NULL (``try_cast``)."""
    return F.trim(_c(x).cast("string")).try_cast(dtype)


def home_points(result: Column | str, unknown_as_zero: bool = True) -> Column:
    """H5: result → home points (H=3, D=1, A=0). Unknown codes → 0 (SQL) or NULL (features)."""
    r = _c(result)
    out = F.when(r == "H", POINTS_WIN).when(r == "D", POINTS_DRAW).when(r == "A", POINTS_LOSS)
    return out.otherwise(POINTS_LOSS) if unknown_as_zero else out


def away_points(result: Column | str, unknown_as_zero: bool = True) -> Column:
    """H5: result → away points (A=3, D=1, H=0)."""
    r = _c(result)
    out = F.when(r == "A", POINTS_WIN).when(r == "D", POINTS_DRAW).when(r == "H", POINTS_LOSS)
    return out.otherwise(POINTS_LOSS) if unknown_as_zero else out


def argmax_outcome(p_home: Column | str, p_draw: Column | str, p_away: Column | str, tie: str = "first") -> Column:
    """H6: predicted outcome from three probabilities with an explicit tie rule.

    * ``first``  – first of H, D, A among the maxima (Python ``max`` over a dict).
    * ``strict`` – H if strictly greatest, else D if strictly greatest, else A.
    """
    h, d, a = _c(p_home), _c(p_draw), _c(p_away)
    if tie == "first":
        return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")
    if tie == "strict":
        return F.when((h > d) & (h > a), "H").when((d > h) & (d > a), "D").otherwise("A")
    raise ValueError(f"unknown tie rule {tie!r}")


def correct_any_max(p_home, p_draw, p_away, result) -> Column:
    """H6 (``>=`` rule of the stored-prediction query): 1 when the actual outcome is
    among the maximal probabilities, else 0."""
    h, d, a, r = _c(p_home), _c(p_draw), _c(p_away), _c(result)
    return (
        F.when((h >= d) & (h >= a) & (r == "H"), 1)
        .when((d >= h) & (d >= a) & (r == "D"), 1)
        .when((a >= h) & (a >= d) & (r == "A"), 1)
        .otherwise(0)
    )


def implied_probability(odds: Column | str) -> Column:
    """H7: 1/odds; zero or NULL odds → NULL (``try_divide``)."""
    return F.try_divide(F.lit(1.0), _c(odds).cast("double"))


def market_favourite(home_odds, draw_odds, away_odds) -> Column:
    """H7: outcome with the highest implied probability (ties → H, then D); NULL when any odds missing."""
    ph, pd_, pa = implied_probability(home_odds), implied_probability(draw_odds), implied_probability(away_odds)
    return F.when(
        ph.isNotNull() & pd_.isNotNull() & pa.isNotNull(),
        F.when((ph >= pd_) & (ph >= pa), "H").when((pd_ >= ph) & (pd_ >= pa), "D").otherwise("A"),
    )


def season_name(code: Column | str, any_code: bool = False) -> Column:
    """H8: two-year season code ``1920`` → ``2019/2020`` (start = 2000 + first two
    digits, end = start + 1). Only codes whose second half follows the first
    (``1920``, ``9900``) are converted, so a calendar-year season such as
    ``1995`` stays as it is; anything else is returned trimmed. ``any_code``
    converts every four digits, whatever the second half says."""
    t = F.trim(_c(code).cast("string"))
    first = F.substring(t, 1, 2).try_cast("int")
    second = F.substring(t, 3, 2).try_cast("int")
    start = (F.lit(2000) + first).cast("string")
    end = (F.lit(2001) + first).cast("string")
    is_code = t.rlike("^[0-9]{4}$")
    if not any_code:
        is_code = is_code & (second == F.pmod(first + 1, F.lit(100)))
    return F.when(is_code, F.concat(start, F.lit("/"), end)).otherwise(t)


def season_code(name: Column | str) -> Column:
    """H9: season name ``2019/2020`` → code ``1920``; anything else unchanged."""
    t = F.trim(_c(name).cast("string"))
    return F.when(
        t.rlike("^[0-9]{4}/[0-9]{4}$"),
        F.concat(F.substring(t, 3, 2), F.substring(t, 8, 2)),
    ).otherwise(t)


def abbreviation_fallback(name: Column | str, abbr: Column | str | None = None) -> Column:
    """Mapped abbreviation, else upper-case first three letters of the name."""
    fallback = F.upper(F.substring(_c(name), 1, 3))
    return fallback if abbr is None else F.coalesce(_c(abbr), fallback)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def log_factorial(k: Column | str) -> Column:
    """ln(k!) for a non-negative integer column: sum of ln(1..k) (valid for any k)."""
    kk = _c(k).cast("int")
    return F.when(kk <= 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(2), kk), F.lit(0.0), lambda acc, x: acc + F.log(x.cast("double")))
    )


def poisson_log_pmf(k: Column | str, lam: Column) -> Column:
    """Log P(K=k | λ) = k ln λ − λ − ln k!; λ floored at 1e-12."""
    lam_f = F.greatest(lam, F.lit(1e-12))
    return _c(k).cast("double") * F.log(lam_f) - lam_f - log_factorial(k)


def log_factorial_table(max_k: int) -> list[float]:
    """[ln 0!, ln 1!, …, ln max_k!] from the log-gamma function (a rule, not a table)."""
    import math

    return [math.lgamma(k + 1) for k in range(max_k + 1)]


def poisson_pmf_array(lam: Column, max_goals: int = 10) -> Column:
    """Array [P(0), …, P(max_goals)] for one λ, computed in-row (no shuffle).
    Each entry is a plain codegen'd expression; ln k! comes from a literal table."""
    lam_f = F.greatest(lam, F.lit(1e-12))
    log_lam = F.log(lam_f)
    lf = log_factorial_table(max_goals)
    return F.array(*[F.exp(F.lit(float(k)) * log_lam - lam_f - F.lit(lf[k])) for k in range(max_goals + 1)])


def poisson_cdf_array(lam: Column, max_goals: int = 10) -> Column:
    """Array [P(K≤0), …, P(K≤max_goals)] (left-to-right running sums of the pmf)."""
    lam_f = F.greatest(lam, F.lit(1e-12))
    log_lam = F.log(lam_f)
    lf = log_factorial_table(max_goals)
    terms = [F.exp(F.lit(float(k)) * log_lam - lam_f - F.lit(lf[k])) for k in range(max_goals + 1)]
    sums, acc = [], None
    for t in terms:
        acc = t if acc is None else acc + t
        sums.append(acc)
    return F.array(*sums)


def round_half_up(x: Column | str, n: int) -> Column:
    """SQL ROUND (half-up)."""
    return F.round(_c(x), n)


def round_half_even(x: Column | str, n: int) -> Column:
    """pandas/numpy rounding (half-even)."""
    return F.bround(_c(x), n)


def mean_non_null(cols: Iterable[Column | str], digits: int | None = 3) -> Column:
    """Row-wise mean of the non-NULL values; NULL when none; rounded to ``digits``."""
    arr = F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    mean = F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr))
    return F.round(mean, digits) if digits is not None else mean


def safe_int(x: Column | str) -> Column:
    """NULL-safe integer cast (bad → NULL, doubles truncated)."""
    c = _c(x)
    return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))


def fill_default(x: Column | str, default) -> Column:
    """NULL → default."""
    return F.coalesce(_c(x), F.lit(default))


def min_max_normalise(x: Column | str, lo: float = 1200.0, hi: float = 1800.0) -> Column:
    """H16 part: (x − lo)/(hi − lo) — not clipped (ratings outside the range go past 0 or 1)."""
    return (_c(x).cast("double") - F.lit(lo)) / F.lit(hi - lo)


def importance_score(elo_home: Column | str, elo_away: Column | str, p_home: Column | str, p_away: Column | str) -> Column:
    """0.6 · mean normalised Elo (missing rating → 1500) + 0.4 · (1 − |p_home − p_away|);
    a match without a prediction scores 0."""
    elo_term = (min_max_normalise(F.coalesce(_c(elo_home), F.lit(1500.0)))
                + min_max_normalise(F.coalesce(_c(elo_away), F.lit(1500.0)))) / 2
    balance = 1 - F.abs(_c(p_home) - _c(p_away))
    return F.when(_c(p_home).isNull() | _c(p_away).isNull(), F.lit(0.0)).otherwise(0.6 * elo_term + 0.4 * balance)


def iso_date(x: Column | str) -> Column:
    """``yyyy-MM-dd``."""
    return F.date_format(_c(x), "yyyy-MM-dd")


def pair_key(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Order-free key of a pairing: (least, greatest)."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def percent(x: Column | str, digits: int = 1) -> Column:
    """100·x rounded."""
    return F.round(F.lit(100.0) * _c(x), digits)


def one_hot_outcome(result: Column | str) -> tuple[Column, Column, Column]:
    """(1{H}, 1{D}, 1{A}) as doubles."""
    r = _c(result)
    return tuple(F.when(r == o, 1.0).otherwise(0.0) for o in OUTCOMES)  # type: ignore[return-value]
