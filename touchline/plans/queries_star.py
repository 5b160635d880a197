"""Registered queries: star schema load, keys, joins and checks
(S4–S7, S12, J1–J7, J14, D20, V1–V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elo, star, tables
from ..operators.form import dedupe_keep_first
from ..sources.tables import contests
from .catalog import register
from .oracle_sql import CONTESTS, ODDS, with_ctes
from .queries_core import odds_decimal
from .queries_features import ELO_CTE

EXISTING_BEFORE = "1998"   # the target table already holds seasons before this one (S5, S6)
KNOWN_BEFORE = "2001"      # season dimension known to the loader (V6)

STAR = """
loaded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY league, season, match_datetime, trim(home_team), trim(away_team) ORDER BY match_id) AS rn FROM contests) WHERE rn = 1),
leagues AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT league AS name FROM loaded)),
seasons_k AS (SELECT league, season, row_number() OVER (ORDER BY league, season) AS id
              FROM (SELECT DISTINCT league, season FROM loaded)),
seasons AS (SELECT s.id, l.id AS league_id, s.season AS name, s.league, s.season
            FROM seasons_k s JOIN leagues l ON l.name = s.league),
teams AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (
  SELECT DISTINCT team AS name FROM (SELECT trim(home_team) AS team FROM loaded UNION ALL SELECT trim(away_team) FROM loaded)
  WHERE team IS NOT NULL AND team <> '')),
matches AS (
  SELECT c.match_id AS id, s.id AS season_id, c.match_datetime AS date, h.id AS home_team_id, a.id AS away_team_id,
    home_goals AS home_team_goals, away_goals AS away_team_goals, result
  FROM loaded c JOIN seasons s ON s.league = c.league AND s.season = c.season
  JOIN teams h ON h.name = c.home_team JOIN teams a ON a.name = c.away_team),
match_stats AS (SELECT match_id, home_shots, away_shots, home_shots_on_target, away_shots_on_target, home_corners, away_corners FROM loaded),
results AS (
  SELECT m.id AS match_id, s.name AS season_name, m.date, h.name AS home_team, a.name AS away_team,
    home_team_goals, away_team_goals, result
  FROM matches m JOIN seasons s ON s.id = m.season_id JOIN teams h ON h.id = m.home_team_id
  JOIN teams a ON a.id = m.away_team_id)"""


_LOADED: dict[tuple, dict] = {}


def _star(spark, sf_dir, with_odds=True, with_ratings=True):
    """The star loaded (persisted) once per application from the contest table."""
    from ..session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir, with_odds, with_ratings)
    if key not in _LOADED:
        c = contests(spark, sf_dir)
        odds = odds_decimal(spark, sf_dir) if with_odds else None
        ratings = elo.elo_ratings(c) if with_ratings else None
        _LOADED[key] = star.load_star(c, odds, ratings, path=scratch_path(spark, "star"))
    return dict(_LOADED[key])


@register("match_results", with_ctes(CONTESTS, STAR, body="SELECT * FROM results"))
def q_match_results(spark, sf_dir):
    """Matches ⋈ seasons ⋈ teams (home) ⋈ teams (away)."""
    return star.match_results(_star(spark, sf_dir))


@register("match_analytics", with_ctes(CONTESTS, STAR, body="SELECT * FROM results JOIN match_stats USING (match_id)"))
def q_match_analytics(spark, sf_dir):
    """Match results with their statistics (inner, 1:1)."""
    return star.match_analytics(_star(spark, sf_dir))


CLEAN_FROM_STAR_SQL = """
SELECT r.match_id, r.date AS match_datetime, r.home_team, r.away_team, r.result, r.home_team_goals AS home_goals,
  r.away_team_goals AS away_goals, ms.home_shots, ms.away_shots, ms.home_shots_on_target, ms.away_shots_on_target, ms.home_corners, ms.away_corners,
  r.season_name AS season
FROM results r LEFT JOIN match_stats ms USING (match_id)"""


@register("clean_from_star", with_ctes(CONTESTS, STAR, body=CLEAN_FROM_STAR_SQL))
def q_clean_from_star(spark, sf_dir):
    """The clean-frame shape rebuilt from the star (LEFT JOIN match_stats)."""
    return star.clean_from_star(_star(spark, sf_dir))


@register("scan_normalised", with_ctes(CONTESTS, STAR, body=CLEAN_FROM_STAR_SQL + " ORDER BY match_datetime, match_id"))
def q_scan_normalised(spark, sf_dir):
    """Read the star back as a clean frame ordered by date."""
    return star.clean_from_star(_star(spark, sf_dir)).orderBy("match_datetime", "match_id")


@register("lookup_join", with_ctes(CONTESTS, STAR, body="SELECT * FROM matches"))
def q_lookup_join(spark, sf_dir):
    """Names → surrogate ids for the match fact."""
    return _star(spark, sf_dir)["matches"]


@register("team_or_join", with_ctes(CONTESTS, STAR, body="""
SELECT m.id AS match_id, m.season_id, t.id AS team_id, t.id = m.home_team_id AS is_home, t.name AS team_name
FROM matches m JOIN teams t ON m.home_team_id = t.id OR m.away_team_id = t.id"""))
def q_team_or_join(spark, sf_dir):
    """The disjunctive team join, rewritten as an equi join on the exploded sides."""
    st = _star(spark, sf_dir)
    return tables.team_or_join(st["matches"], st["teams"]).select("match_id", "season_id", "team_id", "is_home", "team_name")


@register("assign_surrogate_keys", with_ctes(CONTESTS, body=f"""
SELECT league, season, id FROM (
  SELECT league, season, row_number() OVER (ORDER BY league, season) AS id
  FROM (SELECT DISTINCT league, season FROM contests WHERE season < '{EXISTING_BEFORE}'))
UNION ALL
SELECT league, season, (SELECT count(*) FROM (SELECT DISTINCT league, season FROM contests WHERE season < '{EXISTING_BEFORE}'))
  + row_number() OVER (ORDER BY league, season) AS id
FROM (SELECT DISTINCT league, season FROM contests WHERE season >= '{EXISTING_BEFORE}')"""))
def q_assign_surrogate_keys(spark, sf_dir):
    """Incremental ids for the season dimension — existing ids kept, new keys numbered after max(id)."""
    c = contests(spark, sf_dir).select("league", "season")
    existing = star.assign_surrogate_keys(c.where(F.col("season") < EXISTING_BEFORE), ["league", "season"])
    return star.assign_surrogate_keys(c, ["league", "season"], existing)


NATURAL = "league, season, match_datetime, home_team, away_team"
INSERT_SQL = f"""
target AS (SELECT match_id, {NATURAL} FROM contests WHERE season < '{EXISTING_BEFORE}'),
batch AS (SELECT match_id, {NATURAL} FROM (
  SELECT *, row_number() OVER (PARTITION BY {NATURAL} ORDER BY match_id) AS rn FROM contests) WHERE rn = 1),
fresh AS (SELECT b.* FROM batch b ANTI JOIN target t USING ({NATURAL}))"""


@register("insert_if_absent", with_ctes(CONTESTS, INSERT_SQL, body="SELECT * FROM target UNION ALL SELECT * FROM fresh"))
def q_insert_if_absent(spark, sf_dir):
    """INSERT IGNORE of the full batch into a table holding the earlier seasons."""
    c = contests(spark, sf_dir).select("match_id", *star.NATURAL_MATCH_KEY)
    target = c.where(F.col("season") < EXISTING_BEFORE)
    return star.insert_if_absent(target, c, list(star.NATURAL_MATCH_KEY), ["match_id"])


@register("anti_new_rows", with_ctes(CONTESTS, INSERT_SQL, body="SELECT * FROM fresh"))
def q_anti_new_rows(spark, sf_dir):
    """Batch rows not yet stored."""
    c = contests(spark, sf_dir).select("match_id", *star.NATURAL_MATCH_KEY)
    batch = dedupe_keep_first(c, list(star.NATURAL_MATCH_KEY), ["match_id"])
    return star.anti_new_rows(c.where(F.col("season") < EXISTING_BEFORE), batch, list(star.NATURAL_MATCH_KEY))


@register("odds_by_key", with_ctes(CONTESTS, ODDS, body=f"""
SELECT c.match_id, o.home_odds_c / 100.0 AS home_odds, o.draw_odds_c / 100.0 AS draw_odds, o.away_odds_c / 100.0 AS away_odds
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {NATURAL} ORDER BY match_id) AS rn FROM contests) WHERE rn = 1) c
JOIN (SELECT * EXCLUDE (rn) FROM (
        SELECT k.{NATURAL.replace(', ', ', k.')}, o.*, row_number() OVER (PARTITION BY k.{NATURAL.replace(', ', ', k.')} ORDER BY o.match_id) AS rn
        FROM contest_odds o JOIN contests k USING (match_id)) WHERE rn = 1) o
  USING ({NATURAL})"""))
def q_odds_by_key(spark, sf_dir):
    """Raw odds rows matched to clean matches by (league, season, datetime, home, away)."""
    c = contests(spark, sf_dir)
    key = list(star.NATURAL_MATCH_KEY)
    clean = dedupe_keep_first(c, key, ["match_id"]).select("match_id", *key)
    raw = odds_decimal(spark, sf_dir).join(c.select("match_id", *key), "match_id")
    raw = dedupe_keep_first(raw, key, ["match_id"]).drop("match_id")
    j = clean.join(raw, key)
    return j.select("match_id", *[F.col(f"{s}_odds").cast("double").alias(f"{s}_odds") for s in ("home", "draw", "away")])


@register("ratings_by_match", with_ctes(CONTESTS, STAR, ELO_CTE, body="""
SELECT e.match_id, t.team_id, m.season_id, m.date, round(t.rating, 2) AS rating, t.is_home
FROM (SELECT * FROM elo WHERE rn > 0) e JOIN matches m ON m.id = e.match_id,
LATERAL (SELECT m.home_team_id AS team_id, round(e.eh, 6) AS rating, TRUE AS is_home
         UNION ALL SELECT m.away_team_id, round(e.ea, 6), FALSE) t"""))
def q_ratings_by_match(spark, sf_dir):
    """Two pre-match rating rows per match (home and away team)."""
    st = _star(spark, sf_dir, with_ratings=True)
    return st["team_ratings"].withColumn("rating", F.col("rating").cast("double"))


@register("load_counts", with_ctes(CONTESTS, ODDS, STAR, body="""
SELECT 'leagues' AS "table", count(*) AS rows FROM leagues UNION ALL
SELECT 'seasons', count(*) FROM seasons UNION ALL SELECT 'teams', count(*) FROM teams UNION ALL
SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'match_stats', count(*) FROM match_stats UNION ALL
SELECT 'match_market_odds', count(*) FROM contest_odds o JOIN matches m ON m.id = o.match_id UNION ALL
SELECT 'team_ratings', 2 * count(*) FROM matches"""))
def q_load_counts(spark, sf_dir):
    """S7 + D20: the whole star load and its per-table row counts."""
    return star.load_counts(_star(spark, sf_dir, with_odds=True, with_ratings=True))


@register("check_required", with_ctes(CONTESTS, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", TRUE AS present, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM contests"
    for c in ("match_datetime", "home_team", "away_team", "result", "home_goals", "away_goals"))))
def q_check_required(spark, sf_dir):
    """V1: required columns present and NULL-free."""
    return star.check_required(contests(spark, sf_dir),
                               ["match_datetime", "home_team", "away_team", "result", "home_goals", "away_goals"])


@register("check_duplicates", with_ctes(CONTESTS, body=f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicated_keys
FROM (SELECT count(*) AS n FROM contests GROUP BY {NATURAL}) WHERE n > 1"""))
def q_check_duplicates(spark, sf_dir):
    """V2: duplicate matches on the natural key (league, season, datetime, home, away)."""
    return star.check_duplicates(contests(spark, sf_dir), list(star.NATURAL_MATCH_KEY))


UNIQUE_KEYS = {"leagues": ["name"], "seasons": ["league_id", "name"], "teams": ["name"], "matches": ["id"],
               "matches#2": ["season_id", "date", "home_team_id", "away_team_id"], "match_stats": ["match_id"],
               "team_ratings": ["team_id", "season_id", "date"], "contests": list(star.NATURAL_MATCH_KEY),
               "predictions_summary": ["match_id", "model_name"]}
_RATED = ("(SELECT season_id, date, home_team_id AS team_id FROM matches UNION ALL SELECT season_id, date, away_team_id FROM matches)")


@register("check_unique", with_ctes(CONTESTS, STAR, body="\nUNION ALL\n".join(
    f"SELECT '{t.split('#')[0]}' AS \"table\", '{','.join(k)}' AS key, "
    + ("CAST(NULL AS BIGINT) AS duplicate_rows" if t == "predictions_summary" else
       f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {_RATED if t == 'team_ratings' else t.split('#')[0]} "
       f"GROUP BY {', '.join(k)}) WHERE n > 1) AS duplicate_rows")
    for t, k in UNIQUE_KEYS.items())))
def q_check_unique(spark, sf_dir):
    """V3: every declared UNIQUE / PRIMARY KEY of the star; the raw contests beside them show what
    the load left out, and the table that is not loaded here has no count."""
    return star.check_unique(_star(spark, sf_dir) | {"contests": contests(spark, sf_dir)}, UNIQUE_KEYS)


@register("check_domain", with_ctes(CONTESTS, STAR, body="""
SELECT rule, violations FROM (
  SELECT
    CAST(sum(CASE WHEN home_team_id IS NULL OR away_team_id IS NULL OR date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_null_keys,
    CAST(sum(CASE WHEN home_team_goals < 0 OR away_team_goals < 0 THEN 1 ELSE 0 END) AS BIGINT) AS goals_non_negative,
    CAST(sum(CASE WHEN coalesce(result IN ('H', 'D', 'A'), FALSE) THEN 0 ELSE 1 END) AS BIGINT) AS result_domain,
    CAST(sum(CASE WHEN home_team_id = away_team_id THEN 1 ELSE 0 END) AS BIGINT) AS distinct_sides,
    CAST(sum(CASE WHEN result <> CASE WHEN home_team_goals > away_team_goals THEN 'H'
        WHEN home_team_goals = away_team_goals THEN 'D' ELSE 'A' END THEN 1 ELSE 0 END) AS BIGINT) AS result_matches_score
  FROM matches) UNPIVOT (violations FOR rule IN (not_null_keys, goals_non_negative, result_domain, distinct_sides, result_matches_score))"""))
def q_check_domain(spark, sf_dir):
    """V4: domain rules on the match fact, violations per rule."""
    return star.check_domain(_star(spark, sf_dir)["matches"])


@register("check_foreign_key", with_ctes(CONTESTS, ODDS, STAR, body="""
SELECT 'seasons' AS child, 'league_id' AS "column", 'leagues' AS parent, count(*) AS orphans
  FROM seasons c ANTI JOIN leagues p ON p.id = c.league_id
UNION ALL SELECT 'matches', 'season_id', 'seasons', count(*) FROM matches c ANTI JOIN seasons p ON p.id = c.season_id
UNION ALL SELECT 'matches', 'home_team_id', 'teams', count(*) FROM matches c ANTI JOIN teams p ON p.id = c.home_team_id
UNION ALL SELECT 'matches', 'away_team_id', 'teams', count(*) FROM matches c ANTI JOIN teams p ON p.id = c.away_team_id
UNION ALL SELECT 'match_stats', 'match_id', 'matches', count(*) FROM match_stats c ANTI JOIN matches p ON p.id = c.match_id
UNION ALL SELECT 'match_market_odds', 'match_id', 'matches', count(*)
  FROM (SELECT o.match_id FROM contest_odds o JOIN matches m ON m.id = o.match_id) c ANTI JOIN matches p ON p.id = c.match_id
UNION ALL SELECT 'team_ratings', 'match_id', 'matches', CAST(0 AS BIGINT)
UNION ALL SELECT 'team_ratings', 'team_id', 'teams', count(*)
  FROM (SELECT home_team_id AS team_id FROM matches UNION ALL SELECT away_team_id FROM matches) c ANTI JOIN teams p ON p.id = c.team_id
UNION ALL SELECT 'team_ratings', 'season_id', 'seasons', count(*)
  FROM (SELECT season_id FROM matches UNION ALL SELECT season_id FROM matches) c ANTI JOIN seasons p ON p.id = c.season_id
UNION ALL SELECT 'predictions_summary', 'match_id', 'matches', 2 * count(*)
  FROM (SELECT match_id FROM contests WHERE season = '2001') c ANTI JOIN matches p ON p.id = c.match_id
UNION ALL SELECT 'predicted_top_scores', 'match_id', 'matches', 3 * count(*)
  FROM (SELECT match_id FROM contests WHERE season = '2001') c ANTI JOIN matches p ON p.id = c.match_id"""))
def q_check_foreign_key(spark, sf_dir):
    """V5: orphan counts for every declared foreign key. The predictions cover all contests of the test
    season, so those of matches that the load left out as duplicates are orphans."""
    from .queries_models import predictions, top_scores

    st = _star(spark, sf_dir, with_odds=True)
    return star.foreign_key_report(st | {"predictions_summary": predictions(spark, sf_dir), "predicted_top_scores": top_scores(spark, sf_dir, 3)})


@register("reject_rows", with_ctes(CONTESTS, body=f"""
SELECT coalesce(reason, 'accepted') AS outcome, league, count(*) AS n FROM (
  SELECT c.league, CASE WHEN s.season IS NULL THEN 'unknown_season' END AS reason
  FROM contests c LEFT JOIN (SELECT DISTINCT league, season FROM contests WHERE season < '{KNOWN_BEFORE}') s
    ON s.league = c.league AND s.season = c.season)
GROUP BY ALL"""))
def q_reject_rows(spark, sf_dir):
    """V6: rows whose season the loader does not know are quarantined, the rest accepted."""
    c = contests(spark, sf_dir)
    known = c.where(F.col("season") < KNOWN_BEFORE)
    seasons = known.select("league", "season").distinct()
    teams = known.select(F.explode(F.array("home_team", "away_team")).alias("name")).distinct()
    accepted, rejected = star.reject_rows(c, seasons, teams)
    a = accepted.select(F.lit("accepted").alias("outcome"), "league")
    r = rejected.select(F.col("reason").alias("outcome"), "league")
    return a.unionByName(r).groupBy("outcome", "league").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("dataset_health", with_ctes(CONTESTS, ODDS, body="""
SELECT 'contests' AS dataset, count(*) AS rows, strftime(max(match_datetime), '%Y-%m-%d') AS max_date,
  round(avg(CASE WHEN home_goals IS NULL OR away_goals IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate
FROM contests
UNION ALL
SELECT 'contest_odds', count(*), NULL, round(avg(CASE WHEN home_odds_c IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM contest_odds"""))
def q_dataset_health(spark, sf_dir):
    """Are the datasets present and non-empty — rows, latest date and NULL rate, one aggregate each."""
    c = contests(spark, sf_dir).agg(
        F.lit("contests").alias("dataset"), F.count(F.lit(1)).cast("long").alias("rows"),
        F.date_format(F.max("match_datetime"), "yyyy-MM-dd").alias("max_date"),
        F.round(F.avg(F.when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), 1.0).otherwise(0.0)), 6).alias("null_rate"))
    from ..sources.tables import contest_odds

    o = contest_odds(spark, sf_dir).agg(
        F.lit("contest_odds").alias("dataset"), F.count(F.lit(1)).cast("long").alias("rows"),
        F.lit(None).cast("string").alias("max_date"),
        F.round(F.avg(F.when(F.col("home_odds_c").isNull(), 1.0).otherwise(0.0)), 6).alias("null_rate"))
    return c.unionByName(o)


@register("load_star", with_ctes(CONTESTS, ODDS, STAR, body="""
SELECT 'leagues' AS "table", count(*) AS rows FROM leagues UNION ALL
SELECT 'seasons', count(*) FROM seasons UNION ALL SELECT 'teams', count(*) FROM teams UNION ALL
SELECT 'matches', count(*) FROM (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY league, season, match_datetime, home_team, away_team ORDER BY match_id) AS rn FROM contests) WHERE rn = 1)"""))
def q_load_star(spark, sf_dir):
    """The star loaded twice with INSERT IGNORE semantics (a second load of the
    same batch adds nothing); per-table row counts of the loaded dimensions and facts."""
    c = contests(spark, sf_dir)
    key = list(star.NATURAL_MATCH_KEY)
    empty = c.select("match_id", *key).limit(0)  # the table before its first load
    first = star.insert_if_absent(empty, c.select("match_id", *key), key, ["match_id"])
    second = star.insert_if_absent(first, c.select("match_id", *key), key, ["match_id"])
    st = _star(spark, sf_dir)
    dims = star.load_counts({k: st[k] for k in ("leagues", "seasons", "teams")})
    facts = second.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(F.lit("matches").alias("table"), "rows")
    return dims.unionByName(facts)
