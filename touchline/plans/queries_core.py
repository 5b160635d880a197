"""Registered queries: relational core (U, D1–D6, W1–W2, J4, J10, J12, T4, P5, P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import perspective, tables
from ..sources.tables import contest_odds, contests, derive_contests
from .catalog import register
from .oracle_sql import CONTESTS, ODDS, SIDES, with_ctes

# Fixed query parameters (the operators' own parameters, not data subsets).
ASOF_DATE = "1998-06-30 00:00:00"
FORM_BEFORE = "2000-01-01 00:00:00"
PAIR = ("NATION_1", "NATION_2")


def odds_decimal(spark, sf_dir):
    """Odds in the sink's decimal form (hundredths / 100)."""
    o = contest_odds(spark, sf_dir)
    return o.select("match_id", *[(F.col(f"{s}_odds_c").cast("decimal(10,0)") / 100).cast("decimal(8,3)").alias(f"{s}_odds")
                                  for s in ("home", "draw", "away")])


@register("contests", with_ctes(CONTESTS, body="SELECT * FROM contests"))
def q_contests(spark, sf_dir):
    """The contest relation derived from the driver tables (joins + per-order aggregate)."""
    return derive_contests(spark, sf_dir)


@register("team_perspective", with_ctes(CONTESTS, SIDES, body="""
SELECT match_id, league, season, match_datetime, team, opponent, is_home,
  CAST(goals_scored AS BIGINT) AS goals_scored, CAST(goals_conceded AS BIGINT) AS goals_conceded,
  CAST(points AS BIGINT) AS points, CAST(shots AS BIGINT) AS shots,
  CAST(shots_on_target AS BIGINT) AS shots_on_target, CAST(corners AS BIGINT) AS corners
FROM sides"""))
def q_team_perspective(spark, sf_dir):
    long = perspective.team_perspective(contests(spark, sf_dir))
    return long.select("match_id", "league", "season", "match_datetime", "team", "opponent", "is_home",
                       *[F.col(c).cast("long").alias(c) for c in ("goals_scored", "goals_conceded", "points", "shots", "shots_on_target", "corners")])


@register("concat_seasons", with_ctes(CONTESTS, body="""
SELECT match_id, league, season, home_team, away_team, home_goals, away_goals,
  CASE WHEN season < '1998' THEN home_shots END AS home_shots,
  CASE WHEN season >= '1998' THEN home_corners END AS home_corners
FROM contests"""))
def q_concat_seasons(spark, sf_dir):
    """Season frames whose column sets drift (shots recorded before 1998,
    corners from 1998), concatenated by name; absent columns become NULL."""
    c = contests(spark, sf_dir)
    cols = ["match_id", "league", "season", "home_team", "away_team", "home_goals", "away_goals"]
    early = c.where(F.col("season") < "1998").select(*cols, "home_shots")
    late = c.where(F.col("season") >= "1998").select(*cols, "home_corners")
    return perspective.concat_frames([early, late])


@register("distinct_teams", with_ctes(CONTESTS, body="""
SELECT DISTINCT league, team FROM (
  SELECT league, trim(home_team) AS team FROM contests UNION ALL SELECT league, trim(away_team) FROM contests)
WHERE team IS NOT NULL AND team <> ''"""))
def q_distinct_teams(spark, sf_dir):
    return perspective.distinct_teams(contests(spark, sf_dir))


@register("distinct_seasons", with_ctes(CONTESTS, body="SELECT DISTINCT league, season FROM contests"))
def q_distinct_seasons(spark, sf_dir):
    return perspective.distinct_seasons(contests(spark, sf_dir))


@register("team_season_goals", with_ctes(CONTESTS, SIDES, body="""
SELECT league, season, team, count(*) AS matches, CAST(sum(goals_scored) AS BIGINT) AS goals_for,
  CAST(sum(goals_conceded) AS BIGINT) AS goals_against
FROM sides GROUP BY league, season, team"""))
def q_team_season_goals(spark, sf_dir):
    return tables.team_season_goals(contests(spark, sf_dir))


LEAGUE_TABLE_SQL = """
SELECT league, season, team, count(*) AS played, CAST(sum(points) AS BIGINT) AS total_points,
  CAST(sum(goals_scored - goals_conceded) AS BIGINT) AS goals_difference,
  row_number() OVER (PARTITION BY league, season
    ORDER BY sum(points) DESC, sum(goals_scored - goals_conceded) DESC, team ASC) AS position
FROM sides {where} GROUP BY league, season, team"""


@register("league_table_asof", with_ctes(CONTESTS, SIDES, body=LEAGUE_TABLE_SQL.format(where="")))
def q_league_table(spark, sf_dir):
    """D2 + W1 over every league and season (final tables)."""
    return tables.league_table_asof(contests(spark, sf_dir))


@register("asof_filter", with_ctes(CONTESTS, SIDES, body=LEAGUE_TABLE_SQL.format(
    where=f"WHERE match_datetime <= TIMESTAMP '{ASOF_DATE}'")))
def q_asof_filter(spark, sf_dir):
    """P5: the league table as of a date (``date <= :d`` pushed to the scan)."""
    return tables.league_table_asof(contests(spark, sf_dir), asof=ASOF_DATE)


@register("table_position", with_ctes(CONTESTS, SIDES, body="""
SELECT league, season, team, total_points, goals_difference,
  row_number() OVER (PARTITION BY league, season ORDER BY total_points DESC, goals_difference DESC, team) AS position
FROM (SELECT league, season, team, CAST(sum(points) AS BIGINT) AS total_points,
        CAST(sum(goals_scored - goals_conceded) AS BIGINT) AS goals_difference
      FROM sides WHERE is_home GROUP BY league, season, team)"""))
def q_table_position(spark, sf_dir):
    """W1 on a home-only table (a second ranking input)."""
    long = perspective.team_perspective(contests(spark, sf_dir), stats=[]).where("is_home")
    agg = long.groupBy("league", "season", "team").agg(
        F.sum("points").cast("long").alias("total_points"),
        F.sum(F.col("goals_scored") - F.col("goals_conceded")).cast("long").alias("goals_difference"))
    return tables.table_position(agg)


HEAD_TO_HEAD_BODY = """
SELECT team_a, team_b, count(*) AS total_matches,
  CAST(sum(CASE WHEN (home_team = team_a AND result = 'H') OR (away_team = team_a AND result = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS team_a_wins,
  CAST(sum(CASE WHEN result = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS draws,
  CAST(sum(CASE WHEN (home_team = team_b AND result = 'H') OR (away_team = team_b AND result = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS team_b_wins,
  CAST(sum(CASE WHEN home_team = team_a THEN home_goals ELSE away_goals END) AS BIGINT) AS team_a_goals,
  CAST(sum(CASE WHEN home_team = team_a THEN away_goals ELSE home_goals END) AS BIGINT) AS team_b_goals
FROM (SELECT *, least(home_team, away_team) AS team_a, greatest(home_team, away_team) AS team_b FROM contests)
GROUP BY team_a, team_b"""


@register("head_to_head", with_ctes(CONTESTS, body=HEAD_TO_HEAD_BODY))
def q_head_to_head(spark, sf_dir):
    return tables.head_to_head(contests(spark, sf_dir))


@register("head_to_head_join", with_ctes(CONTESTS, body="""
SELECT match_id, league, season, match_datetime, least(home_team, away_team) AS team_a,
  greatest(home_team, away_team) AS team_b, home_team, away_team, home_goals, away_goals, result
FROM contests"""))
def q_head_to_head_join(spark, sf_dir):
    return tables.head_to_head_matches(contests(spark, sf_dir))


@register("head_to_head_pair", with_ctes(CONTESTS, body=f"""
SELECT count(*) AS total_matches,
  CAST(sum(CASE WHEN (home_team = '{PAIR[0]}' AND result = 'H') OR (away_team = '{PAIR[0]}' AND result = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS team_a_wins,
  CAST(sum(CASE WHEN result = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS draws,
  CAST(sum(CASE WHEN (home_team = '{PAIR[1]}' AND result = 'H') OR (away_team = '{PAIR[1]}' AND result = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS team_b_wins,
  CAST(sum(CASE WHEN home_team = '{PAIR[0]}' THEN home_goals ELSE away_goals END) AS BIGINT) AS team_a_goals,
  CAST(sum(CASE WHEN home_team = '{PAIR[1]}' THEN home_goals ELSE away_goals END) AS BIGINT) AS team_b_goals
FROM contests
WHERE (home_team = '{PAIR[0]}' AND away_team = '{PAIR[1]}') OR (home_team = '{PAIR[1]}' AND away_team = '{PAIR[0]}')"""))
def q_head_to_head_pair(spark, sf_dir):
    """D3 parameterised form (the reference's query 2) for one pairing."""
    return tables.head_to_head_pair(contests(spark, sf_dir), *PAIR)


@register("team_filter", with_ctes(CONTESTS, body=f"""
SELECT match_id, league, season, home_team, away_team, result FROM contests
WHERE home_team IN ('{PAIR[0]}', '{PAIR[1]}') OR away_team IN ('{PAIR[0]}', '{PAIR[1]}')"""))
def q_team_filter(spark, sf_dir):
    """Matches involving either of two teams (``isin`` pushed to the filter)."""
    c = contests(spark, sf_dir)
    return c.where(F.col("home_team").isin(*PAIR) | F.col("away_team").isin(*PAIR)).select(
        "match_id", "league", "season", "home_team", "away_team", "result")


@register("team_season_summary", with_ctes(CONTESTS, SIDES, body="""
SELECT league, season, team, count(*) AS matches_played,
  CAST(sum(CASE WHEN (is_home AND result = 'H') OR (NOT is_home AND result = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(sum(CASE WHEN result = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS draws,
  CAST(sum(CASE WHEN (is_home AND result = 'A') OR (NOT is_home AND result = 'H') THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  CAST(sum(goals_scored) AS BIGINT) AS goals_for, CAST(sum(goals_conceded) AS BIGINT) AS goals_against
FROM sides GROUP BY league, season, team"""))
def q_team_season_summary(spark, sf_dir):
    return tables.team_season_summary(contests(spark, sf_dir))


POINTS_LAST_5_SQL = """
SELECT league, team, match_id, match_datetime, CAST(points AS BIGINT) AS points_for_match,
  CAST(sum(points) OVER (PARTITION BY league, team ORDER BY match_datetime, match_id
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS points_last_5_matches
FROM sides"""


@register("points_last_5", with_ctes(CONTESTS, SIDES, body=POINTS_LAST_5_SQL))
def q_points_last_5(spark, sf_dir):
    return tables.points_last_n(contests(spark, sf_dir), 5)


@register("latest_one", with_ctes(CONTESTS, SIDES, body=f"""
SELECT league, team, match_datetime, match_id, points_for_match, points_last_5_matches FROM (
  SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY match_datetime DESC, match_id DESC) AS rn
  FROM ({POINTS_LAST_5_SQL.replace('FROM sides', f"FROM sides WHERE match_datetime < TIMESTAMP '{FORM_BEFORE}'")}))
WHERE rn = 1"""))
def q_latest_one(spark, sf_dir):
    """Each team's latest match before a date and its last-5 points."""
    return tables.latest_points_last_n(contests(spark, sf_dir), FORM_BEFORE, 5)


MARKET_SQL = """
SELECT {keys} count(*) AS total_matches_with_market_data,
  CAST(sum(CASE WHEN fav = result THEN 1 ELSE 0 END) AS BIGINT) AS market_correct_predictions,
  round(100 * avg(CASE WHEN fav = result THEN 1 ELSE 0 END), 2) AS market_accuracy_pct
FROM (
  SELECT c.league, c.result,
    CASE WHEN home_odds_c IS NOT NULL AND draw_odds_c IS NOT NULL AND away_odds_c IS NOT NULL THEN
      CASE WHEN 1.0 / home_odds_c >= 1.0 / draw_odds_c AND 1.0 / home_odds_c >= 1.0 / away_odds_c THEN 'H'
           WHEN 1.0 / draw_odds_c >= 1.0 / home_odds_c AND 1.0 / draw_odds_c >= 1.0 / away_odds_c THEN 'D'
           ELSE 'A' END END AS fav
  FROM contest_odds o JOIN contests c ON c.match_id = o.match_id)
WHERE fav IS NOT NULL {group}"""


@register("market_accuracy", with_ctes(CONTESTS, ODDS, body=MARKET_SQL.format(keys="league,", group="GROUP BY league")))
def q_market_accuracy(spark, sf_dir):
    """D6 per league: bookmaker favourite (highest implied probability) vs result."""
    return tables.market_accuracy(odds_decimal(spark, sf_dir), contests(spark, sf_dir), by_league=True)


@register("odds_vs_actual", with_ctes(CONTESTS, ODDS, body="""
SELECT o.match_id, c.result AS actual_result,
  CASE WHEN home_odds_c IS NOT NULL AND draw_odds_c IS NOT NULL AND away_odds_c IS NOT NULL THEN
    CASE WHEN 1.0 / home_odds_c >= 1.0 / draw_odds_c AND 1.0 / home_odds_c >= 1.0 / away_odds_c THEN 'H'
         WHEN 1.0 / draw_odds_c >= 1.0 / home_odds_c AND 1.0 / draw_odds_c >= 1.0 / away_odds_c THEN 'D'
         ELSE 'A' END END AS market_predicted_result
FROM contest_odds o JOIN contests c ON c.match_id = o.match_id"""))
def q_odds_vs_actual(spark, sf_dir):
    """Odds ⋈ matches with the implied favourite."""
    return tables.odds_vs_actual(odds_decimal(spark, sf_dir), contests(spark, sf_dir))


@register("market_accuracy_overall", with_ctes(CONTESTS, ODDS, body=MARKET_SQL.format(keys="", group="")))
def q_market_accuracy_overall(spark, sf_dir):
    """D6 as the reference states it: one row over every match with full odds."""
    return tables.market_accuracy(odds_decimal(spark, sf_dir), contests(spark, sf_dir), by_league=False)
