"""Registered queries for the rarer branches: splits by date and by other seasons, season codes, gates of a short
history, form of promoted teams (P6, H8, H9, M7, M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import season_code, season_name
from ..operators import evaluate, forest, form
from ..operators.perspective import team_perspective
from ..sources.tables import contests, fixtures_from_contests
from .catalog import register
from .oracle_sql import CONTESTS, SIDES, with_ctes
from .queries_features import AVG_COLS, FIXTURES_CTE, ROLLED
from .queries_models import TEST_SEASON

BOUNDARY = "1999-03-15 00:00:00"
MIDDLE_SEASON = "1998"
#: The end of a history so short that every gate has fixtures.
EARLY = "1995-04-15 00:00:00"


def _parts(train, test):
    both = train.select(F.lit("train").alias("part"), "league").unionByName(test.select(F.lit("test").alias("part"), "league"))
    return both.groupBy("part", "league").agg(F.count(F.lit(1)).alias("matches"))


@register("date_split", with_ctes(CONTESTS, body=f"""
SELECT CASE WHEN match_datetime < TIMESTAMP '{BOUNDARY}' THEN 'train' ELSE 'test' END AS part, league, count(*) AS matches FROM contests GROUP BY ALL"""))
def q_date_split(spark, sf_dir):
    """Split at a date."""
    return _parts(*evaluate.date_split(contests(spark, sf_dir), BOUNDARY))


@register("season_split_other", with_ctes(CONTESTS, body=f"""
SELECT CASE WHEN season = '{MIDDLE_SEASON}' THEN 'test' ELSE 'train' END AS part, league, count(*) AS matches FROM contests GROUP BY ALL"""))
def q_season_split_other(spark, sf_dir):
    """One season tested, all others, earlier and later, trained on."""
    return _parts(*evaluate.season_split(contests(spark, sf_dir), MIDDLE_SEASON, mode="other"))


@register("fraction_split_seeded")
def q_fraction_split_seeded(spark, sf_dir):
    """The seeded 80/20 split, by a hash of seed and id; ``tests/test_rules.py`` holds it to its share and stability."""
    train, test = evaluate.fraction_split(contests(spark, sf_dir), 0.8, seed=7, chronological=False)
    return train.select("match_id", F.lit("train").alias("part")).unionByName(test.select("match_id", F.lit("test").alias("part")))


@register("season_names_any", with_ctes(CONTESTS, body="""
SELECT season, CAST(2000 + CAST(season AS INT) // 100 AS VARCHAR) || '/' || CAST(2001 + CAST(season AS INT) // 100 AS VARCHAR) AS name,
  count(*) AS matches
FROM contests GROUP BY season"""))
def q_season_names_any(spark, sf_dir):
    """H8: the loader's rule, which reads any four digits as a code."""
    return contests(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("matches")).select(
        "season", season_name("season", any_code=True).alias("name"), "matches")


@register("season_codes", with_ctes(CONTESTS, body="""
SELECT code, CAST(2000 + first AS VARCHAR) || '/' || CAST(2001 + first AS VARCHAR) AS name, code AS back, count(*) AS matches
FROM (SELECT CAST(season AS INT) % 100 AS first, lpad(CAST(CAST(season AS INT) % 100 AS VARCHAR), 2, '0') || lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0') AS code
      FROM contests) GROUP BY ALL"""))
def q_season_codes(spark, sf_dir):
    """H8 + H9: each season as a two-year code, its name, and the code again."""
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    y = F.col("season").cast("int")
    x = contests(spark, sf_dir).select(F.concat(two(y), two(y + 1)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("matches"))
    return x.select("code", season_name("code").alias("name"), season_code(season_name("code")).alias("back"), "matches")


@register("fixture_gates_early", with_ctes(CONTESTS, FIXTURES_CTE, f"""
past AS (SELECT * FROM contests WHERE match_datetime < TIMESTAMP '{EARLY}'),
played AS (SELECT league, team, count(*) AS n, sum(h) AS nh FROM (
  SELECT league, home_team AS team, 1 AS h FROM past UNION ALL SELECT league, away_team, 0 FROM past) GROUP BY ALL),
counted AS (SELECT f.league, f.fixture_id, f.home_team, f.away_team, coalesce(h.n, 0) AS n_home, coalesce(a.n, 0) AS n_away,
    coalesce(h.n, 0) + coalesce(a.n, 0) - coalesce(p.n, 0) AS n_either, h.nh AS at_home, a.n - a.nh AS at_away
  FROM fixtures f LEFT JOIN played h ON h.league = f.league AND h.team = f.home_team LEFT JOIN played a ON a.league = f.league AND a.team = f.away_team
  LEFT JOIN (SELECT league, least(home_team, away_team) AS x, greatest(home_team, away_team) AS y, count(*) AS n FROM past GROUP BY ALL) p
    ON p.league = f.league AND p.x = least(f.home_team, f.away_team) AND p.y = greatest(f.home_team, f.away_team))""", body="""
SELECT league, fixture_id, CAST(n_home AS BIGINT) AS n_home, CAST(n_away AS BIGINT) AS n_away, CAST(n_either AS BIGINT) AS n_either,
  CASE WHEN n_home < 5 AND n_away < 5 THEN 'both_new' WHEN n_home < 5 THEN 'home_new' WHEN n_away < 5 THEN 'away_new'
       WHEN n_either < 10 THEN 'thin' WHEN at_home = 0 OR at_away = 0 THEN 'no_side' ELSE 'model' END AS gate
FROM counted"""))
def q_fixture_gates_early(spark, sf_dir):
    """M7: the gates of every fixture when the history is only some weeks old."""
    c = contests(spark, sf_dir)
    past = c.where(F.col("match_datetime") < F.lit(EARLY).cast("timestamp_ntz"))
    return forest.fixture_gates(fixtures_from_contests(c), past).select("league", "fixture_id", "n_home", "n_away", "n_either", "gate")


PROMOTED_SQL = ("SELECT t.league, t.team, s.team IS NULL AS promoted, "
                + ", ".join(f"round(CASE WHEN s.team IS NULL THEN m.{c} ELSE s.{c} END, 6) AS {c}" for c in AVG_COLS)
                + f" FROM (SELECT DISTINCT league, team FROM (SELECT league, home_team AS team FROM contests WHERE season = '{TEST_SEASON}' "
                  f"UNION ALL SELECT league, away_team FROM contests WHERE season = '{TEST_SEASON}')) t "
                  "LEFT JOIN states s USING (league, team) LEFT JOIN (SELECT league, "
                + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in AVG_COLS) + " FROM states GROUP BY league) m USING (league)")


@register("promoted_form", with_ctes(CONTESTS, SIDES, ROLLED, f"""
states AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY match_datetime DESC, match_id DESC) AS rn
  FROM rolled WHERE season < '{TEST_SEASON}' AND team NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 3)) WHERE rn = 1)""", body=PROMOTED_SQL))
def q_promoted_form(spark, sf_dir):
    """The form of every team of the test season; the nations of one region count as promoted (their earlier
    states are held out) and get their league's median form."""
    from ..sources.tables import read_table

    c = contests(spark, sf_dir)
    new = read_table(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.col("n_name").alias("team"))
    rolled = form.rolling_form(team_perspective(c)).where(F.col("season") < TEST_SEASON).join(new, "team", "left_anti")
    latest = form.latest_per_team(rolled, AVG_COLS)
    return forest.promoted_form(c.where(F.col("season") == TEST_SEASON), latest, AVG_COLS)
