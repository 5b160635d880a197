"""Registered queries: form and rating features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elo, form
from ..operators.perspective import team_perspective
from ..sources.tables import contests, fixtures_from_contests
from .catalog import register
from .oracle_sql import CONTESTS, SIDES, with_ctes

UPCOMING_FROM = "2001-06-01 00:00:00"
FEATS = form.FORM_FEATURES
AVG_COLS = [form.form_column(f, 5) for f in FEATS]

ROLLING_SQL_COLS = ",\n  ".join(
    f"round(avg({f}) OVER (PARTITION BY league, team ORDER BY match_datetime, match_id "
    f"ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 2) AS {form.form_column(f, 5)}" for f in FEATS)

ROLLED = f"""
rolled AS (
  SELECT match_id, league, season, match_datetime, team, is_home,
  {ROLLING_SQL_COLS}
  FROM sides
)"""

ELO_CTE = """
elo AS (
  WITH RECURSIVE s AS (
    SELECT *, row_number() OVER (PARTITION BY league ORDER BY match_datetime, match_id) AS rn,
      CAST(substr(home_team, 8) AS INT) + 1 AS h, CAST(substr(away_team, 8) AS INT) + 1 AS a FROM contests),
  r(league, rn, match_id, eh, ea, st) AS (
    SELECT league, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE,
      list_transform(range(25), lambda x: 1500.0::DOUBLE) FROM (SELECT DISTINCT league FROM s)
    UNION ALL
    SELECT league, rn, match_id, eh, ea, list_transform(st, lambda x, i:
      CASE WHEN i = h THEN eh + 32 * (sc - xh) WHEN i = a THEN ea + 32 * ((1 - sc) - (1 - xh)) ELSE x END)
    FROM (SELECT r.league, s.rn, s.match_id, st, h, a, st[h] AS eh, st[a] AS ea,
        1 / (1 + pow(10, (st[a] - st[h]) / 400)) AS xh,
        CASE result WHEN 'H' THEN 1.0::DOUBLE WHEN 'D' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sc
      FROM r JOIN s ON s.league = r.league AND s.rn = r.rn + 1))
  SELECT league, rn, match_id, eh, ea, st FROM r
)"""


def _long(spark, sf_dir):
    return team_perspective(contests(spark, sf_dir))


@register("lag_one", with_ctes(CONTESTS, SIDES, body="""
SELECT match_id, league, team, is_home,
  CAST(lag(goals_scored) OVER w AS BIGINT) AS prev_goals_scored,
  CAST(lag(points) OVER w AS BIGINT) AS prev_points
FROM sides WINDOW w AS (PARTITION BY league, team ORDER BY match_datetime, match_id)"""))
def q_lag_one(spark, sf_dir):
    out = form.lag_one(_long(spark, sf_dir), ["goals_scored", "points"])
    return out.select("match_id", "league", "team", "is_home",
                      F.col("prev_goals_scored").cast("long").alias("prev_goals_scored"),
                      F.col("prev_points").cast("long").alias("prev_points"))


@register("rolling_form", with_ctes(CONTESTS, SIDES, ROLLED, body="SELECT * FROM rolled"))
def q_rolling_form(spark, sf_dir):
    out = form.rolling_form(_long(spark, sf_dir))
    return out.select("match_id", "league", "season", "match_datetime", "team", "is_home", *AVG_COLS)


SIDED_COLS = ",\n  ".join(
    [f"max(CASE WHEN is_home THEN {c} END) AS {c}_home" for c in AVG_COLS]
    + [f"max(CASE WHEN NOT is_home THEN {c} END) AS {c}_away" for c in AVG_COLS])

SIDED = f"""
sided AS (SELECT match_id, {SIDED_COLS} FROM rolled GROUP BY match_id)"""


@register("unpivot_sides", with_ctes(CONTESTS, SIDES, ROLLED, SIDED,
                                     body="SELECT c.*, sided.* EXCLUDE (match_id) FROM contests c LEFT JOIN sided USING (match_id)"))
def q_unpivot_sides(spark, sf_dir):
    c = contests(spark, sf_dir)
    rolled = form.rolling_form(team_perspective(c))
    return form.unpivot_sides(c, rolled, AVG_COLS)


@register("elo_ratings", with_ctes(CONTESTS, ELO_CTE, body="""
SELECT match_id, league, round(eh, 6) AS elo_home_pre, round(ea, 6) AS elo_away_pre,
  round(eh - ea, 6) AS elo_diff
FROM elo WHERE rn > 0"""))
def q_elo_ratings(spark, sf_dir):
    """Sequential Elo per league (sorted streaming fold)."""
    return elo.elo_ratings(contests(spark, sf_dir))


@register("rating_range", with_ctes(CONTESTS, ELO_CTE, body="""
SELECT f.league, round(min(rating), 6) AS min_rating, round(max(rating), 6) AS max_rating
FROM (
  SELECT e.league, 'NATION_' || CAST(i - 1 AS VARCHAR) AS team, st[i] AS rating
  FROM elo e JOIN (SELECT league, max(rn) AS rn FROM elo GROUP BY league) m USING (league, rn),
       range(1, 26) t(i)
) f
JOIN (SELECT DISTINCT league, home_team AS team FROM contests UNION SELECT DISTINCT league, away_team FROM contests) d
  ON d.league = f.league AND d.team = f.team
GROUP BY f.league"""))
def q_rating_range(spark, sf_dir):
    """Min / max final rating per league."""
    return elo.rating_range(contests(spark, sf_dir))


@register("build_features", with_ctes(CONTESTS, SIDES, ROLLED, SIDED, ELO_CTE, body="""
SELECT c.*, sided.* EXCLUDE (match_id), round(e.eh, 6) AS elo_home_pre, round(e.ea, 6) AS elo_away_pre,
  round(e.eh - e.ea, 6) AS elo_diff
FROM contests c LEFT JOIN sided USING (match_id) LEFT JOIN (SELECT * FROM elo WHERE rn > 0) e USING (match_id)"""))
def q_build_features(spark, sf_dir):
    """Rolling form per side + Elo, one row per match."""
    return form.build_features(contests(spark, sf_dir))


@register("matchweek_index", with_ctes(CONTESTS, body="""
SELECT match_id, league, season, season_position, (season_position - 1) // 10 + 1 AS matchweek FROM (
  SELECT match_id, league, season,
    row_number() OVER (PARTITION BY league, season ORDER BY match_datetime, match_id) AS season_position
  FROM contests)"""))
def q_matchweek_index(spark, sf_dir):
    out = form.matchweek_index(contests(spark, sf_dir))
    return out.select("match_id", "league", "season", "season_position", "matchweek")


@register("latest_per_team", with_ctes(CONTESTS, SIDES, ROLLED, body=f"""
SELECT league, team, match_datetime, match_id, {", ".join(AVG_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY match_datetime DESC, match_id DESC) AS rn FROM rolled)
WHERE rn = 1"""))
def q_latest_per_team(spark, sf_dir):
    rolled = form.rolling_form(_long(spark, sf_dir))
    return form.latest_per_team(rolled, AVG_COLS)


@register("dedupe_keep_first", with_ctes(CONTESTS, body="""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY league, season, match_datetime, home_team, away_team ORDER BY match_id) AS rn
  FROM contests) WHERE rn = 1"""))
def q_dedupe_keep_first(spark, sf_dir):
    """One match per (league, season, datetime, home, away), first by match_id."""
    return form.dedupe_keep_first(contests(spark, sf_dir),
                                  ["league", "season", "match_datetime", "home_team", "away_team"])


@register("sort_matches", with_ctes(CONTESTS, body="SELECT * FROM contests ORDER BY match_datetime, home_team, away_team, match_id"))
def q_sort_matches(spark, sf_dir):
    return form.sort_matches(contests(spark, sf_dir))


@register("next_matches", with_ctes(CONTESTS, body=f"""
SELECT league, rank, match_id, strftime(match_datetime, '%Y-%m-%d') AS match_date, home_team, away_team,
  upper(substr(home_team, 1, 3)) AS home_abbr, upper(substr(away_team, 1, 3)) AS away_abbr FROM (
  SELECT *, row_number() OVER (PARTITION BY league ORDER BY match_datetime, match_id) AS rank
  FROM contests WHERE match_datetime >= TIMESTAMP '{UPCOMING_FROM}') WHERE rank <= 4"""))
def q_next_matches(spark, sf_dir):
    """The next four matches per league from a given day."""
    return form.next_matches(contests(spark, sf_dir), UPCOMING_FROM, 4)


LATEST_SIDE = """
{side}_last AS (
  SELECT league, team AS {side}_team, {cols} FROM (
    SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY match_datetime DESC, match_id DESC) AS rn
    FROM rolled WHERE {cond}) WHERE rn = 1)"""

FIXTURES_CTE = """
fixtures AS (
  SELECT league, home_team, away_team,
    row_number() OVER (PARTITION BY league ORDER BY home_team, away_team) AS fixture_id
  FROM (SELECT DISTINCT league, home_team, away_team FROM contests))"""


@register("latest_state_join", with_ctes(
    CONTESTS, SIDES, ROLLED, FIXTURES_CTE,
    LATEST_SIDE.format(side="home", cond="is_home", cols=", ".join(f"{c} AS {c}_home" for c in AVG_COLS)),
    LATEST_SIDE.format(side="away", cond="NOT is_home", cols=", ".join(f"{c} AS {c}_away" for c in AVG_COLS)),
    body="""
SELECT f.*, h.* EXCLUDE (league, home_team), a.* EXCLUDE (league, away_team)
FROM fixtures f LEFT JOIN home_last h USING (league, home_team) LEFT JOIN away_last a USING (league, away_team)"""))
def q_latest_state_join(spark, sf_dir):
    """Each fixture with the home side's latest home form and the away side's latest away form."""
    c = contests(spark, sf_dir)
    return form.latest_state_join(fixtures_from_contests(c), c)


@register("elo_ratings_by_season", with_ctes(CONTESTS, ELO_CTE, body="""
SELECT match_id, league, round(eh, 6) AS elo_home_pre, round(ea, 6) AS elo_away_pre,
  round(eh - ea, 6) AS elo_diff
FROM elo WHERE rn > 0"""))
def q_elo_ratings_by_season(spark, sf_dir):
    """E8 (chunked form): the fold run season by season, ratings carried and
    checkpointed between seasons; must equal the single pass."""
    return elo.elo_ratings(contests(spark, sf_dir), chunk="season")
