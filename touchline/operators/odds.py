"""Market odds of raw season rows: one bookmaker's and the market's average (H13, the odds of S7)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column prefixes of bookmakers in season files; a column is prefix + optional C (closing) + H, D or A.
# A suffix alone would take in HTHG-like statistics and the half-time result.
BOOKMAKERS = ("B365", "BFD", "BMGM", "BV", "BW", "BS", "CL", "GB", "IW", "LB", "PS", "P", "SB", "SJ", "SO", "SY", "VC", "WH", "1XB", "BF")
SIDES = {"H": "home_win", "D": "draw", "A": "away_win"}


def odds_families(columns: Sequence[str]) -> dict[str, list[str]]:
    """H, D, A → the columns of the header that hold that side's pre-match odds of any bookmaker (any case)."""
    book = re.compile(f"({'|'.join(sorted(BOOKMAKERS, key=len, reverse=True))})([HDA])", re.IGNORECASE)
    out: dict[str, list[str]] = {s: [] for s in SIDES}
    for c in columns:
        m = book.fullmatch(c.strip())
        if m:
            out[m.group(2).upper()].append(c)
    return out


def market_odds(raw: DataFrame, key: Sequence[str] = ("match_id",), book: str = "B365") -> DataFrame:
    """``key``, ``b365_<side>_odds`` and ``market_avg_<side>_odds`` as decimals of 3 places: the mean of the side's
    odds that are present in the row (half up); null where none is. Odds that are no number count as absent."""
    families = odds_families(raw.columns)
    out = [F.col(c) for c in key]
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("decimal(12,4)")
    for s, name in SIDES.items():
        mine = [c for c in families[s] if c.strip().upper() == (book + s).upper()]
        out.append((number(mine[0]) if mine else F.lit(None)).cast("decimal(8,3)").alias(f"b365_{name}_odds"))
    for s, name in SIDES.items():
        if not families[s]:
            out.append(F.lit(None).cast("decimal(8,3)").alias(f"market_avg_{name}_odds"))
            continue
        values = [number(c) for c in families[s]]
        total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0).cast("decimal(12,4)")) for v in values])
        n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
        out.append(F.round(F.try_divide(total, n.cast("decimal(4,0)")), 3).cast("decimal(8,3)").alias(f"market_avg_{name}_odds"))
    return raw.select(*out)
