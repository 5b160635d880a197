from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="touchline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """The reference's four-match sample (two days, three teams) as a contest frame."""
    rows = [
        (1, "2024-08-17 15:00:00", "Brighton", "Manchester City", 2, 1, "H", 15, 8, 7, 4),
        (2, "2024-08-17 17:30:00", "Brighton", "New Castle", 1, 1, "D", 12, 10, 5, 5),
        (3, "2024-08-24 15:00:00", "Manchester City", "New Castle", 0, 2, "A", 9, 14, 3, 6),
        (4, "2024-08-24 17:30:00", "New Castle", "Brighton", 1, 3, "A", 11, 18, 4, 8),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "match_id long, ts string, home_team string, away_team string, home_goals int, "
                                     "away_goals int, result string, home_shots int, away_shots int, home_corners int, "
                                     "away_corners int")
    return df.select("match_id", F.lit("PL").alias("league"), F.lit("2425").alias("season"),
                     F.to_timestamp_ntz("ts").alias("match_datetime"), *[c for c in df.columns if c not in ("match_id", "ts")])
