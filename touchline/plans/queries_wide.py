"""Queries over the wide season frame: all columns of the wide map cleaned, and its pre-match and odds projections."""

from __future__ import annotations

from ..operators import clean, form
from ..sources.raw import wide_raw
from ..sources.tables import contest_odds, contests
from .catalog import register
from .oracle_sql import CONTESTS, ODDS, with_ctes


def _side(side: str) -> str:
    fouls = f"{side}_shots % 17"
    return f"""{side}_goals, {side}_goals // 2 AS half_time_{side}_goals, {side}_shots, {side}_shots_on_target,
    {side}_shots % 3 AS {side}_hit_woodwork, {side}_corners, {fouls} AS {side}_fouls_committed,
    {fouls} + 1 AS {side}_free_kicks_conceded, {side}_corners % 5 AS {side}_offsides,
    ({fouls}) % 5 AS {side}_yellow, ({fouls}) // 13 AS {side}_red"""


def _prices(side: str, name: str) -> str:
    return f"{side}_odds_c / 100.0 AS b365_{name}_odds, ({side}_odds_c + 5) / 100.0 AS market_avg_{name}_odds"


WIDE = f"""
wide AS (
  SELECT league AS league_division, kickoff AS match_datetime, home_team, away_team, 'Referee ' || (match_id % 40) AS referee,
    CASE WHEN match_id % 50 <> 0 THEN 1000 + home_shots * 37 + away_shots END AS attendance, result,
    CASE WHEN home_goals // 2 > away_goals // 2 THEN 'H' WHEN home_goals // 2 < away_goals // 2 THEN 'A' ELSE 'D' END AS half_time_result,
    {_side("home")},
    {_side("away")},
    {_prices("home", "home_win")}, {_prices("draw", "draw")}, {_prices("away", "away_win")},
    season, league, match_id AS source_line
  FROM (SELECT *, row_number() OVER (PARTITION BY league, season, kickoff, home_team, away_team ORDER BY match_id) AS rn
        FROM (SELECT c.*, o.* EXCLUDE (match_id), CAST(c.match_datetime +
                (lpad(CAST(12 + home_corners % 9 AS VARCHAR), 2, '0') || ':00:00')::INTERVAL AS TIMESTAMP) AS kickoff
              FROM contests c LEFT JOIN contest_odds o USING (match_id)))
  WHERE rn = 1)"""


def _wide(spark, sf_dir):
    return clean.clean_matches(wide_raw(contests(spark, sf_dir), contest_odds(spark, sf_dir)), clean.WIDE_COLUMN_MAP)


@register("clean_matches_wide", with_ctes(CONTESTS, ODDS, WIDE, body="SELECT * FROM wide"))
def q_clean_matches_wide(spark, sf_dir):
    """P2 + P3: all 37 columns of the wide map parsed, trimmed, typed and de-duplicated by kick-off."""
    return _wide(spark, sf_dir)


@register("prematch_projection_wide", with_ctes(CONTESTS, ODDS, WIDE, body=f"SELECT {', '.join(clean.PREMATCH_COLUMNS)} FROM wide"))
def q_prematch_projection_wide(spark, sf_dir):
    """The twelve columns known before kick-off."""
    return clean.prematch_projection(_wide(spark, sf_dir))


@register("odds_projection_wide", with_ctes(CONTESTS, ODDS, WIDE, body=f"SELECT {', '.join(clean.ODDS_COLUMNS)} FROM wide"))
def q_odds_projection_wide(spark, sf_dir):
    """The odds table, typed by the cleaning."""
    return clean.odds_projection(_wide(spark, sf_dir))


@register("matchweek_index_by_teams", with_ctes(CONTESTS, body="""
SELECT match_id, league, season, season_position, (season_position - 1) // size + 1 AS matchweek
FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY match_datetime, match_id) AS season_position FROM contests)
JOIN (SELECT league, season, greatest(count(DISTINCT team) // 2, 1) AS size
      FROM (SELECT league, season, unnest([home_team, away_team]) AS team FROM contests) GROUP BY league, season) USING (league, season)"""))
def q_matchweek_index_by_teams(spark, sf_dir):
    """W5 + D13: match weeks as long as half the teams of the league's season."""
    out = form.matchweek_index(contests(spark, sf_dir), per_week=None)
    return out.select("match_id", "league", "season", "season_position", "matchweek")
