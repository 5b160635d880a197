"""Season files written by the test itself: drifting headers, BOM, padded names,
duplicates, a bad date, a non-numeric statistic, a missing team (FIXTURES §3)."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

from touchline.operators import clean
from touchline.sources import files


def _write(dirpath: Path, name: str, text: str, encoding="latin-1") -> str:
    p = dirpath / name
    p.write_bytes(text.encode(encoding) if encoding != "utf-8-sig" else ("﻿" + text).encode("utf-8"))
    return str(p)


def test_drifting_season_files(spark):
    d = Path(tempfile.mkdtemp(prefix="touchline-files-"))
    a = _write(d, "season_1920.csv",
               "Div,Date, HomeTeam ,AwayTeam,FTHG,FTAG,FTR,HS,AS\n"
               "E0,09/08/19,Liverpool,Norwich,4,1,H,15,12\n"
               "E0,09/08/19,Liverpool,Norwich,4,1,H,15,12\n"
               "E0,32/08/19,West Ham,Man City,0,5,A,5,14\n"
               "E0,10/08/2019,Burnley,,3,0,H,x,10\n", "utf-8-sig")
    b = _write(d, "season_2021.csv",
               "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,hc,AC\n"
               "E0,12/09/2020,Fulham,Arsenal,0,3,A,5,3\n")
    raw = files.read_seasons(spark, [a, b], encoding="UTF-8")
    assert set(raw.columns) >= {"Div", "Date", "HomeTeam", "HS", "hc", "season"}
    assert sorted(r["season"] for r in raw.select("season").distinct().collect()) == ["1920", "2021"]
    out = clean.clean_matches(raw).orderBy("match_datetime").collect()
    # the duplicate, the bad date and the missing team are gone
    assert len(out) == 2
    assert out[0]["match_datetime"] == dt.datetime(2019, 8, 9) and out[0]["home_goals"] == 4
    assert out[1]["home_corners"] == 5 and out[1]["home_shots"] is None


def test_fixture_file(spark):
    d = Path(tempfile.mkdtemp(prefix="touchline-fix-"))
    p = _write(d, "fixtures.csv",
               "Match Number,Round Number,Date,Location,Home Team,Away Team,Result\n"
               "1,1,14/08/2026 20:00,Old Trafford,Man Utd,Spurs,\n"
               "2,1,bad,Anfield,Liverpool,Coventry,\n")
    rows = files.read_fixtures(spark, p).orderBy("match_number").collect()
    assert rows[0]["match_datetime"] == dt.datetime(2026, 8, 14, 20, 0)
    assert rows[1]["match_datetime"] is None


def test_header_normalisation():
    assert files.normalise_header(["﻿Div", " Date ", "ï»¿HomeTeam"]) == ["Div", "Date", "HomeTeam"]


def test_headers_that_differ_by_case_and_league_from_division(spark):
    d = Path(tempfile.mkdtemp(prefix="touchline-files-"))
    a = _write(d, "season_1920.csv", "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,AHh,AHH,Referee,Attendance,B365H\n"
                                     "E0,09/08/2019, Liverpool ,Norwich,4,1,H,1,2, M Oliver ,53333,1.14\n")
    raw = files.read_seasons(spark, [a])
    assert {"AHh", "AHH_2"} <= set(raw.columns)
    m = clean.matches_from_files(raw).collect()[0]
    assert (m.league, m.season, m.home_team) == ("E0", "1920", "Liverpool") and isinstance(m.match_id, int)
    wide = clean.clean_matches(raw, clean.WIDE_COLUMN_MAP).collect()[0]
    assert (wide.attendance, wide.b365_home_win_odds, wide.referee) == (53333, 1.14, "M Oliver")


def test_features_of_the_files_reach_the_load_and_the_counts(spark, monkeypatch):
    """Two teams, six matches over the season that brings corners, one with a bad date: the load's ratings come from
    the written features, and the sides with a form, of points and of corners, are counted."""
    from touchline.operators import star
    from touchline.plans import queries_sources
    from touchline.sources.tables import CONTEST_SCHEMA

    rows = [(i, *(("X", "Y") if i % 2 else ("Y", "X")), dt.datetime(year, 3, i % 28 + 1), 1, 0, "H", 3, 2, 1, 1, 4, 5, "L", str(year))
            for i, year in ((10, 1996), (11, 1997), (12, 1998), (13, 1998), (14, 1999), (51, 1999))]  # 51 % 50 = 1: a bad date
    contests = spark.createDataFrame(rows, CONTEST_SCHEMA)
    seen, load = [], star.load_star
    monkeypatch.setattr(queries_sources, "contests", lambda *_: contests)
    monkeypatch.setattr(star, "load_star", lambda *a, **kw: (seen.append(kw["ratings"]), load(*a, **kw))[1])
    got = queries_sources.q_load_from_files(spark, "none").collect()[0].asDict()
    assert got == {"rows_read": 6, "bad_dates": 1, "blank_teams": 0, "bad_numbers": 0, "matches": 5, "loaded": 5, "rated_sides": 10, "leagues": 1,
                   "teams": 2, "formed_sides": 8, "corner_formed_sides": 4}
    stored = seen[0].orderBy("match_datetime").collect()
    assert len({r.match_id for r in stored}) == 5 and all("features-from-files" in f for f in seen[0].inputFiles())
    assert [r.avg_points_last_5_matches_home for r in stored] == [None, 0.0, 1.5, 1.0, 1.5]
    assert [r.avg_corners_last_5_matches_away for r in stored] == [None, None, None, 4.0, 4.5]
    assert stored[0].elo_home_pre == 1500.0 and stored[1].elo_home_pre < 1500.0
