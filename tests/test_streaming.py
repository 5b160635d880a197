"""Incremental load: a replayed or repeated stream never duplicates matches."""

from __future__ import annotations

import tempfile
from pathlib import Path

from touchline.streaming.incremental_load import start_incremental_load

COLS = ["Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"]


def test_incremental_load_is_idempotent(spark):
    base = Path(tempfile.mkdtemp(prefix="touchline-stream-"))
    land = base / "landing"
    land.mkdir()
    (land / "season_1920.csv").write_text(
        "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nE0,09/08/2019,Liverpool,Norwich,4,1,H\n"
        "E0,09/08/2019,Liverpool,Norwich,4,1,H\nE0,10/08/2019,West Ham,Man City,0,5,A\n")
    target, ckpt = str(base / "matches"), str(base / "ckpt")
    q = start_incremental_load(spark, str(land), COLS, target, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
    # a second file repeating one match and adding one new match
    (land / "season_1920_late.csv").write_text(
        "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nE0,10/08/2019,West Ham,Man City,0,5,A\nE0,17/08/2019,Arsenal,Burnley,2,1,H\n")
    q = start_incremental_load(spark, str(land), COLS, target, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 3
