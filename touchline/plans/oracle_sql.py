"""DuckDB oracle SQL: shared CTEs for the relations derived from the driver tables.

The driver pre-registers the parquet tables as views; every oracle query
starts from the same contest derivation as ``sources.tables.contests``.
"""

CONTESTS = """
contests AS (
  WITH agg AS (
    SELECT l_orderkey, min(l_suppkey) AS suppkey,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS home_goals,
      CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS away_goals,
      CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS INT) AS home_shots,
      CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS INT) AS away_shots,
      CAST(sum(CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS INT) AS home_shots_on_target,
      CAST(sum(CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS INT) AS away_shots_on_target,
      CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INT) AS home_corners,
      CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INT) AS away_corners
    FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey AS match_id, c_mktsegment || '-' || (c_custkey // 1500) AS league, CAST(year(o_orderdate) AS VARCHAR) AS season,
    o_orderdate AS match_datetime, hn.n_name AS home_team, an.n_name AS away_team, home_goals, away_goals,
    CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result,
    home_shots, away_shots, home_shots_on_target, away_shots_on_target, home_corners, away_corners
  FROM orders JOIN agg ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation hn ON hn.n_nationkey = c_nationkey
  JOIN supplier ON s_suppkey = suppkey JOIN nation an ON an.n_nationkey = s_nationkey
  WHERE c_nationkey <> s_nationkey
)"""

SIDES = """
sides AS (
  SELECT match_id, league, season, match_datetime, home_team AS team, away_team AS opponent, TRUE AS is_home,
    home_goals AS goals_scored, away_goals AS goals_conceded,
    CASE result WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points,
    home_shots AS shots, home_shots_on_target AS shots_on_target, home_corners AS corners, result
  FROM contests
  UNION ALL
  SELECT match_id, league, season, match_datetime, away_team, home_team, FALSE,
    away_goals, home_goals,
    CASE result WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END,
    away_shots, away_shots_on_target, away_corners, result
  FROM contests
)"""

ODDS = """
contest_odds AS (
  SELECT o_orderkey AS match_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(150 + max(CAST(round(l_discount * 100) AS INT)) * 20 AS INT) END AS home_odds_c,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(220 + max(l_linenumber) * 20 AS INT) END AS draw_odds_c,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(150 + max(CAST(round(l_tax * 100) AS INT)) * 25 AS INT) END AS away_odds_c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderpriority
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
