"""Registered queries: file sources/sinks and cleaning.

Inputs are derived from the driver tables by Spark and written to the shared
checkpoint folder, then read back through the operators under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, evaluate, forest, form
from ..session import scratch_path, written
from ..sources import files
from ..sources.raw import DRIFT_SEASON, raw_from_contests
from ..sources.tables import contests
from .catalog import register
from .oracle_sql import CONTESTS, ODDS, with_ctes
from .queries_features import ELO_CTE, ROLLED, SIDED
from .queries_models import BASE, TEST_SEASON, predictions, split
from .oracle_sql import SIDES

EARLY_COLS = ["Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "source_line"]
LATE_COLS = EARLY_COLS[:-1] + ["HC", "AC", "source_line"]

RAW_SQL = f"""
raw AS (
  SELECT league AS Div,
    CASE WHEN season < '{DRIFT_SEASON}' THEN strftime(match_datetime, '%d/%m/%y') ELSE strftime(match_datetime, '%d/%m/%Y') END AS Date,
    home_team AS HomeTeam, away_team AS AwayTeam, CAST(home_goals AS VARCHAR) AS FTHG, CAST(away_goals AS VARCHAR) AS FTAG,
    result AS FTR, CAST(home_shots AS VARCHAR) AS HS, CAST(away_shots AS VARCHAR) AS "AS",
    CASE WHEN season >= '{DRIFT_SEASON}' THEN CAST(home_corners AS VARCHAR) END AS HC,
    CASE WHEN season >= '{DRIFT_SEASON}' THEN CAST(away_corners AS VARCHAR) END AS AC,
    league, season, match_id AS source_line
  FROM contests)"""

CLEAN_SQL = """
cleaned AS (
  SELECT match_datetime, home_team, away_team, result, home_goals, away_goals, home_shots, away_shots,
    CASE WHEN season >= '{drift}' THEN home_corners END AS home_corners,
    CASE WHEN season >= '{drift}' THEN away_corners END AS away_corners,
    league, season, match_id AS source_line
  FROM (SELECT *, row_number() OVER (PARTITION BY league, season, match_datetime, home_team, away_team ORDER BY match_id) AS rn
        FROM contests) WHERE rn = 1)""".format(drift=DRIFT_SEASON)


def _raw(spark, sf_dir, wide=False):
    return raw_from_contests(contests(spark, sf_dir), wide=wide)


def _clean(spark, sf_dir):
    raw = _raw(spark, sf_dir).drop("header_group")
    return clean.clean_matches(raw)


@register("scan_season_files", with_ctes(CONTESTS, RAW_SQL, body="""
SELECT Div, Date, HomeTeam, AwayTeam, FTHG, FTAG, FTR, HS, "AS", HC, AC, season, CAST(source_line AS VARCHAR) AS source_line
FROM raw"""))
def q_scan_season_files(spark, sf_dir):
    """S1 + S2 + U2: season CSV files with drifting headers (corners only from 1998),
    written from the contests and read back, season taken from the file path."""
    raw = _raw(spark, sf_dir)
    base = scratch_path(spark, "season-files")
    globs = files.write_raw_seasons(raw, base, {"early": EARLY_COLS, "late": LATE_COLS})
    paths = [p for g in globs for p in files.list_files(spark, g)]
    df = files.read_seasons(spark, paths)
    return df.select("Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HS", "AS", "HC", "AC", "season",
                     "source_line")


@register("map_columns", with_ctes(CONTESTS, RAW_SQL, body="""
SELECT Date AS date, HomeTeam AS home_team, AwayTeam AS away_team, FTR AS result, FTHG AS home_goals, FTAG AS away_goals,
  HS AS home_shots, "AS" AS away_shots, HC AS home_corners, AC AS away_corners, season, league, source_line
FROM raw"""))
def q_map_columns(spark, sf_dir):
    """Case-insensitive select + rename of the raw columns."""
    return clean.map_columns(_raw(spark, sf_dir).drop("header_group"))


@register("map_columns_wide", with_ctes(CONTESTS, RAW_SQL, body="""
SELECT Div AS league_division, Date AS date, lpad(CAST(12 + home_corners % 9 AS VARCHAR), 2, '0') || ':00' AS kickoff_time,
  HomeTeam AS home_team, AwayTeam AS away_team, FTR AS result, FTHG AS home_goals, FTAG AS away_goals,
  HS AS home_shots, "AS" AS away_shots, HC AS home_corners, AC AS away_corners, raw.season, raw.league, raw.source_line
FROM raw JOIN contests c ON c.match_id = raw.source_line"""))
def q_map_columns_wide(spark, sf_dir):
    """The wide map (division, kickoff time, …) over the raw frame."""
    return clean.map_columns(_raw(spark, sf_dir, wide=True).drop("header_group"), clean.WIDE_COLUMN_MAP)


@register("clean_matches", with_ctes(CONTESTS, CLEAN_SQL, body="SELECT * FROM cleaned"))
def q_clean_matches(spark, sf_dir):
    """Parse, trim, coerce, drop keyless rows, keep-first de-duplication."""
    return _clean(spark, sf_dir)


@register("prematch_projection", with_ctes(CONTESTS, body="""
SELECT league AS league_division, CAST(match_datetime + (lpad(CAST(12 + home_corners % 9 AS VARCHAR), 2, '0') || ':00:00')::INTERVAL AS TIMESTAMP) AS match_datetime,
  home_team, away_team
FROM (SELECT *, row_number() OVER (PARTITION BY league, season, match_datetime, home_team, away_team ORDER BY match_id) AS rn
      FROM contests) WHERE rn = 1"""))
def q_prematch_projection(spark, sf_dir):
    """The model-safe pre-match projection of the wide clean frame (date + kickoff time)."""
    from ..functions.scalars import parse_date_time, parse_day_first

    mapped = clean.map_columns(_raw(spark, sf_dir, wide=True).drop("header_group"), clean.WIDE_COLUMN_MAP)
    x = mapped.withColumn("_day", parse_day_first("date")).withColumn(
        "match_datetime", parse_date_time("date", "kickoff_time"))
    x = form.dedupe_keep_first(x, ["league", "season", "_day", "home_team", "away_team"], ["source_line"])
    return clean.prematch_projection(x)


@register("write_read_clean", with_ctes(CONTESTS, CLEAN_SQL, body="SELECT * FROM cleaned"))
def q_write_read_clean(spark, sf_dir):
    """S3: the clean frame written by season and read back."""
    cleaned = _clean(spark, sf_dir)
    path = files.write_clean(cleaned, scratch_path(spark, "clean"))
    back = files.read_clean(spark, path, schema=cleaned.schema)
    return back.select(*cleaned.columns)


@register("scan_fixtures", with_ctes(CONTESTS, body=f"""
SELECT season_position AS match_number, (season_position - 1) // 10 + 1 AS round_number, match_datetime,
  league AS location, home_team, away_team, NULL::VARCHAR AS result
FROM (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY match_datetime, match_id) AS season_position
      FROM contests) WHERE season = '{TEST_SEASON}'"""))
def q_scan_fixtures(spark, sf_dir):
    """Fixture CSV (``dd/MM/yyyy HH:mm``) for the test season, written and parsed back."""
    _, _, test = split(spark, sf_dir)
    weeks = form.matchweek_index(test)
    path = scratch_path(spark, "fixtures")
    files.fixture_rows(test, weeks).write.mode("overwrite").option("header", True).csv(path)
    return files.read_fixtures(spark, path)


def metrics_frame(spark, sf_dir):
    """Nested metrics per model and league of the test season (the documents of the evaluation run)."""
    _, _, test = split(spark, sf_dir)
    p = predictions(spark, sf_dir)
    s = evaluate.scored(p, test, "strict")
    weeks = form.matchweek_index(test).select("match_id", F.col("matchweek").cast("string").alias("week"))
    hit = F.when(F.col("predicted") == F.col("result"), 1).otherwise(0)
    per_week = s.join(weeks, "match_id").groupBy("model_name", "league", "week").agg(
        F.struct(F.sum(hit).cast("long").alias("correct"), F.count(F.lit(1)).cast("long").alias("total")).alias("wk"))
    weeks_map = per_week.groupBy("model_name", "league").agg(F.map_from_entries(F.collect_list(F.struct("week", "wk"))).alias("matchweek_stats"))
    dist = lambda col: F.struct(*[F.sum(F.when(F.col(col) == o, 1).otherwise(0)).cast("long").alias(o) for o in "HDA"])
    by_type = F.struct(*[F.coalesce(F.round(F.try_divide(
        F.sum(F.when((F.col("result") == o) & (F.col("predicted") == o), 1).otherwise(0)) * 100.0,
        F.sum(F.when(F.col("result") == o, 1).otherwise(0))), 2), F.lit(0.0)).alias(o) for o in "HDA"])
    base = s.groupBy("model_name", "league").agg(
        F.round(100.0 * F.avg(hit), 2).alias("accuracy"), F.count(F.lit(1)).cast("long").alias("predictions"),
        F.sum(hit).cast("long").alias("correct_predictions"), F.count(F.lit(1)).cast("long").alias("total_predictions"),
        dist("predicted").alias("prediction_distribution"), dist("result").alias("actual_distribution"),
        by_type.alias("accuracy_by_type"))
    return base.join(weeks_map, ["model_name", "league"]).select(
        F.col("model_name").alias("model"), "league", "accuracy", "predictions",
        F.when(F.col("model_name") == "poisson", "Poisson Distribution").otherwise("Constant prior").alias("model_type"),
        "correct_predictions", "total_predictions", "prediction_distribution", "actual_distribution",
        "accuracy_by_type", "matchweek_stats", F.lit(TEST_SEASON).alias("test_season"),
        F.col("predictions").alias("test_matches"))


@register("write_read_metrics", with_ctes(*BASE, body="""
SELECT model_name AS model, league, round(100.0 * avg(CASE WHEN pred_strict = result THEN 1 ELSE 0 END), 2) AS accuracy,
  count(*) AS predictions, CAST(sum(CASE WHEN pred_strict = result THEN 1 ELSE 0 END) AS BIGINT) AS correct_predictions,
  CAST(sum(CASE WHEN pred_strict = 'H' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_H,
  count(DISTINCT wk) AS matchweeks
FROM (SELECT *, (row_number() OVER (PARTITION BY model_name, league, season ORDER BY match_datetime, match_id) - 1) // 10 + 1 AS wk
      FROM scored)
GROUP BY model_name, league"""))
def q_write_read_metrics(spark, sf_dir):
    """One nested metrics document a model and league, written as JSON and read back with an explicit schema."""
    path = files.write_metrics(metrics_frame(spark, sf_dir), scratch_path(spark, "metrics"))
    m = files.read_metrics(spark, path)
    return m.select("model", "league", "accuracy", "predictions", "correct_predictions",
                    F.col("prediction_distribution.H").alias("predicted_H"),
                    F.size("matchweek_stats").cast("long").alias("matchweeks"))


FEATURE_COLS = form.feature_columns()


@register("features_targets", with_ctes(CONTESTS, SIDES, ROLLED, SIDED, ELO_CTE, body=f"""
SELECT c.match_id, {", ".join(f"coalesce(CAST({x} AS DOUBLE), 0.0) AS {x}" for x in FEATURE_COLS)}, c.result AS label_str
FROM (SELECT c.*, sided.* EXCLUDE (match_id), round(e.eh, 6) AS elo_home_pre, round(e.ea, 6) AS elo_away_pre,
        round(e.eh - e.ea, 6) AS elo_diff
      FROM contests c LEFT JOIN sided USING (match_id) LEFT JOIN (SELECT * FROM elo WHERE rn > 0) e USING (match_id)) c"""))
def q_features_targets(spark, sf_dir):
    """Allow-listed pre-match features (NULL → 0) and the label."""
    return forest.features_targets(form.build_features(contests(spark, sf_dir)), FEATURE_COLS)


PADDED = {"Div": " Div", "Date": "Date ", "HomeTeam": "  HomeTeam ", "AwayTeam": "AwayTeam", "FTHG": "FTHG",
          "FTAG": " FTAG", "FTR": "FTR"}


@register("normalise_header", with_ctes(CONTESTS, RAW_SQL, body="""
SELECT Div, Date, HomeTeam, AwayTeam, FTHG, FTAG, FTR, season FROM raw"""))
def q_normalise_header(spark, sf_dir):
    """Season files whose header names carry stray blanks are read back with
    clean names (and latin-1 decoding)."""
    raw = _raw(spark, sf_dir)
    padded = raw.select(*[F.col(k).alias(v) for k, v in PADDED.items()], "season", "header_group")
    base = scratch_path(spark, "padded-files")
    globs = files.write_raw_seasons(padded, base, {"early": list(PADDED.values()), "late": list(PADDED.values())})
    paths = [p for g in globs for p in files.list_files(spark, g)]
    return files.read_seasons(spark, paths).select(*PADDED.keys(), "season")


@register("odds_projection", with_ctes(CONTESTS, ODDS, body="""
SELECT c.match_datetime, c.home_team, c.away_team, o.home_odds_c / 100.0 AS b365_home_win_odds,
  o.draw_odds_c / 100.0 AS b365_draw_odds, o.away_odds_c / 100.0 AS b365_away_win_odds
FROM contests c JOIN contest_odds o USING (match_id)"""))
def q_odds_projection(spark, sf_dir):
    """The separate odds table of the wide clean frame (raw B365 columns mapped by the wide map)."""
    from ..sources.tables import contest_odds

    c = contests(spark, sf_dir)
    o = contest_odds(spark, sf_dir)
    raw = raw_from_contests(c, wide=True).join(
        o.select(F.col("match_id").alias("source_line"),
                 *[(F.col(f"{s}_odds_c") / 100).cast("string").alias(f"B365{s[0].upper()}") for s in ("home", "draw", "away")]),
        "source_line")
    mapped = clean.map_columns(raw.drop("header_group"), clean.WIDE_COLUMN_MAP)
    from ..functions.scalars import parse_day_first

    x = mapped.withColumn("match_datetime", parse_day_first("date"))
    x = x.select("*", *[F.col(c).try_cast("double").alias(c + "_d") for c in ("b365_home_win_odds", "b365_draw_odds", "b365_away_win_odds")])
    x = x.drop("b365_home_win_odds", "b365_draw_odds", "b365_away_win_odds")
    for c in ("b365_home_win_odds", "b365_draw_odds", "b365_away_win_odds"):
        x = x.withColumnRenamed(c + "_d", c)
    return clean.odds_projection(x)


FIX_FEATURE_SQL = ", ".join(
    (f"coalesce(CAST(h.{x} AS DOUBLE), 0.0) AS {x}" if x.endswith("_home") else
     f"coalesce(CAST(a.{x} AS DOUBLE), 0.0) AS {x}" if x.endswith("_away") else
     f"coalesce(CAST((h.{x} + a.{x}) / 2 AS DOUBLE), 0.0) AS {x}") for x in FEATURE_COLS)


@register("fixture_feature_rows", with_ctes(CONTESTS, SIDES, ROLLED, SIDED, ELO_CTE, body=f"""
SELECT f.league, f.fixture_id, f.home_team, f.away_team, {FIX_FEATURE_SQL}
FROM (SELECT league, home_team, away_team, row_number() OVER (PARTITION BY league ORDER BY home_team, away_team) AS fixture_id
      FROM (SELECT DISTINCT league, home_team, away_team FROM contests)) f
LEFT JOIN (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY league, home_team ORDER BY match_datetime DESC, match_id DESC) AS rn
           FROM (SELECT c.*, sided.* EXCLUDE (match_id), round(e.eh, 6) AS elo_home_pre, round(e.ea, 6) AS elo_away_pre,
                   round(e.eh - e.ea, 6) AS elo_diff
                 FROM contests c LEFT JOIN sided USING (match_id) LEFT JOIN (SELECT * FROM elo WHERE rn > 0) e USING (match_id)) w)
           WHERE rn = 1) h ON h.league = f.league AND h.home_team = f.home_team
LEFT JOIN (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY league, away_team ORDER BY match_datetime DESC, match_id DESC) AS rn
           FROM (SELECT c.*, sided.* EXCLUDE (match_id), round(e.eh, 6) AS elo_home_pre, round(e.ea, 6) AS elo_away_pre,
                   round(e.eh - e.ea, 6) AS elo_diff
                 FROM contests c LEFT JOIN sided USING (match_id) LEFT JOIN (SELECT * FROM elo WHERE rn > 0) e USING (match_id)) w)
           WHERE rn = 1) a ON a.league = f.league AND a.away_team = f.away_team"""))
def q_fixture_feature_rows(spark, sf_dir):
    """M7 (model path): each fixture's feature row from the latest home-side and away-side rows."""
    from ..sources.tables import fixtures_from_contests

    c = contests(spark, sf_dir)
    return forest.fixture_feature_rows(fixtures_from_contests(c), form.build_features(c), FEATURE_COLS)


# Faults put into the raw files by a rule that both engines state: what k = match_id % 50 does to a row.
FAULTY_SQL = """
faulty AS (SELECT *, match_id % 50 AS k FROM contests),
kept AS (SELECT DISTINCT league, season, match_datetime, home_team, away_team FROM faulty WHERE k NOT IN (1, 4)),
kept_sides AS (SELECT league, season, home_team AS team FROM kept UNION ALL SELECT league, season, away_team FROM kept)"""


@register("load_from_files", with_ctes(CONTESTS, FAULTY_SQL, body="""
SELECT (SELECT count(*) FROM faulty) + (SELECT count(*) FROM faulty WHERE k = 5) AS rows_read,
  (SELECT count(*) FROM faulty WHERE k = 1) AS bad_dates, (SELECT count(*) FROM faulty WHERE k = 4) AS blank_teams,
  (SELECT count(*) FROM faulty WHERE k = 2) AS bad_numbers, (SELECT count(*) FROM kept) AS matches,
  (SELECT count(*) FROM kept) AS loaded, 2 * (SELECT count(*) FROM kept) AS rated_sides,
  (SELECT count(DISTINCT league) FROM kept) AS leagues,
  (SELECT count(DISTINCT t) FROM (SELECT home_team AS t FROM kept UNION ALL SELECT away_team FROM kept)) AS teams,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM kept_sides GROUP BY league, team)) AS formed_sides,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM kept_sides WHERE season >= '"""
          + DRIFT_SEASON + """' GROUP BY league, team)) AS corner_formed_sides"""))
def q_load_from_files(spark, sf_dir):
    """S1 → P3 → E9 → S7 end to end: season files with bad dates, bad numbers, padded and blank names and
    repeated rows, read, cleaned, given features and loaded; the rejects are counted by reason.

    All features are written, the load takes its ratings from them, and the sides that have a form are counted:
    all but a team's first, and by corners all but its first of the seasons that record them."""
    from ..functions.scalars import clean_text, parse_day_first, to_number
    from ..operators import star

    k = F.col("source_line") % 50
    raw = _raw(spark, sf_dir).withColumns({
        "Date": F.when(k == 1, "32/13/1999").otherwise(F.col("Date")),
        "FTHG": F.when(k == 2, "n/a").otherwise(F.col("FTHG")),
        "HomeTeam": F.when(k == 3, F.concat(F.lit("  "), "HomeTeam", F.lit(" "))).when(k == 4, " ").otherwise(F.col("HomeTeam"))})
    raw = raw.unionByName(raw.where(k == 5))
    base = scratch_path(spark, "faulty-seasons")
    globs = files.write_raw_seasons(raw, base, {"early": EARLY_COLS, "late": LATE_COLS})
    read = files.read_seasons(spark, [p for g in globs for p in files.list_files(spark, g)], encoding="UTF-8")
    faults = read.agg(F.count(F.lit(1)).alias("rows_read"),
                      F.sum(parse_day_first("Date").isNull().cast("long")).alias("bad_dates"),
                      F.sum(clean_text("HomeTeam").isNull().cast("long")).alias("blank_teams"),
                      F.sum(to_number("FTHG").isNull().cast("long")).alias("bad_numbers"))
    path = scratch_path(spark, "matches-from-files")
    clean.matches_from_files(read).write.parquet(path)
    matches = spark.read.parquet(path)
    wide = written(form.build_features(matches), "features-from-files")
    loaded = star.load_star(matches, ratings=wide, path=scratch_path(spark, "star-from-files"))
    one = F.lit(1)

    def formed(feature: str):
        form_of = form.form_column(feature, form.DEFAULT_WINDOWS[0])
        return F.count(f"{form_of}_home") + F.count(f"{form_of}_away")

    featured = wide.agg(F.count(one).alias("matches"), formed("points").alias("formed_sides"), formed("corners").alias("corner_formed_sides"))
    parts = [faults.withColumn("_j", one), featured.withColumn("_j", one),
             loaded["matches"].agg(F.count(one).alias("loaded")).withColumn("_j", one),
             loaded["team_ratings"].agg(F.count(one).alias("rated_sides")).withColumn("_j", one),
             loaded["leagues"].agg(F.count(one).alias("leagues")).withColumn("_j", one),
             loaded["teams"].agg(F.count(one).alias("teams")).withColumn("_j", one)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_j")
    return out.select("rows_read", "bad_dates", "blank_teams", "bad_numbers", "matches", "loaded", "rated_sides", "leagues", "teams",
                      "formed_sides", "corner_formed_sides")
