"""Normalised star schema: load, keys, joins and constraint checks
(S4–S7, J1–J3, J5–J7, J14, D20, V1–V6).

Tables: ``leagues(id, name)``, ``seasons(id, league_id, name)``,
``teams(id, name)``, ``matches(id, season_id, date, home_team_id,
away_team_id, home_team_goals, away_team_goals, result)``,
``match_stats(match_id, home_*, away_*)``, ``match_market_odds(match_id,
b365_{home_win,draw,away_win}_odds)``, ``team_ratings(match_id, team_id,
season_id, date, rating)``.

Dimensions (leagues, seasons, teams) grow with the data and are numbered per
range slice of their distinct names; the match fact keeps its natural id (or a
stable ``xxhash64`` of its natural key) — never a global window.
Joins to dimensions are equi joins AQE turns into broadcasts at runtime when
the dimension is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, season_name
from .chunked import global_row_number
from .form import dedupe_keep_first
from .perspective import distinct_teams

NATURAL_MATCH_KEY = ("league", "season", "match_datetime", "home_team", "away_team")


def assign_surrogate_keys(names: DataFrame, key: Sequence[str], existing: DataFrame | None = None,
                          id_col: str = "id") -> DataFrame:
    """Ids for a dimension. Existing rows keep their ids; new natural keys get
    ``max(existing id)`` + their number in key order, counted per range slice, so a
    dimension that grows with the data is never numbered in one task."""
    key = list(key)
    new = names.select(*key).distinct()
    if existing is None:
        return global_row_number(new, key, id_col)
    kept = existing.select(*key, F.col(id_col).cast("long").alias(id_col))
    highest = kept.agg(F.max(id_col)).first()[0] or 0
    return kept.unionByName(global_row_number(new.join(existing.select(*key), key, "left_anti"), key, id_col, highest))


def stable_match_id(df: DataFrame, key: Sequence[str] = NATURAL_MATCH_KEY) -> DataFrame:
    """S6 (facts): a stable id from the natural key — no global numbering."""
    return df.withColumn("match_id", F.xxhash64(*[F.col(c).cast("string") for c in key]))


def insert_if_absent(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """S5 + J14: ``INSERT IGNORE`` — new rows whose key is not yet in ``target``
    (first by ``order`` within the batch) appended to ``target``. Idempotent."""
    key = list(key)
    batch = dedupe_keep_first(new.select(*target.columns), key, order)
    fresh = batch.join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh)


def anti_new_rows(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``."""
    return new.join(target.select(*key).distinct(), list(key), "left_anti")


def load_star(clean: DataFrame, odds: DataFrame | None = None, ratings: DataFrame | None = None,
              path: str | None = None) -> dict[str, DataFrame]:
    """Derive every star table from the clean frame (plus odds and Elo if given).

    With ``path`` the load is persisted: dimensions are written first, the facts
    are built against the written dimensions and written too, and the returned
    frames read the stored tables — later queries never re-derive a dimension
    from a scan of all matches. Without ``path`` every table stays lazy."""
    spark = clean.sparkSession

    def persist(name: str, df: DataFrame) -> DataFrame:
        if path is None:
            return df
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    for c in ("home_team", "away_team"):
        clean = clean.withColumn(c, clean_text(c))
    # The names of a dimension are part of the declared key, so its repeats bring no others: dimensions
    # are read from the rows as they come, without the shuffle that drops the repeats.
    leagues = persist("leagues", assign_surrogate_keys(clean.select(F.col("league").alias("name")), ["name"]))
    seasons_raw = clean.select("league", "season").distinct()
    seasons = persist("seasons", assign_surrogate_keys(seasons_raw, ["league", "season"])
                      .join(leagues.select(F.col("id").alias("league_id"), F.col("name").alias("league")), "league")
                      .select("id", "league_id", season_name("season").alias("name"), "league", "season"))
    teams = persist("teams", assign_surrogate_keys(
        distinct_teams(clean, by_league=False).select(F.col("team").alias("name")), ["name"]))
    stat_cols = [c for c in clean.columns if c.startswith(("home_", "away_"))
                 and c not in ("home_team", "away_team", "home_goals", "away_goals")]
    # INSERT IGNORE by the declared key: the first row of each match stays.
    clean = dedupe_keep_first(clean, NATURAL_MATCH_KEY, ["match_id"])
    # The ids are resolved once; both fact tables are projections of that frame.
    facts = persist("facts", lookup_ids(clean, seasons, teams, stat_cols))
    matches = facts.drop(*stat_cols)
    match_stats = facts.select(F.col("id").alias("match_id"), *stat_cols)
    tables = {"leagues": leagues, "seasons": seasons.drop("league", "season"), "teams": teams,
              "matches": matches, "match_stats": match_stats}
    if odds is not None:
        tables["match_market_odds"] = persist("match_market_odds", odds.join(
            matches.select(F.col("id").alias("match_id")), "match_id").select(
            "match_id", F.col("home_odds").cast("decimal(8,3)").alias("b365_home_win_odds"),
            F.col("draw_odds").cast("decimal(8,3)").alias("b365_draw_odds"),
            F.col("away_odds").cast("decimal(8,3)").alias("b365_away_win_odds")))
    if ratings is not None:
        tables["team_ratings"] = persist("team_ratings", ratings_by_match(ratings, matches))
    return tables


def lookup_ids(clean: DataFrame, seasons: DataFrame, teams: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Natural names → ids (season by (league, code), teams by trimmed name), with
    the ``carry`` columns. Rows that miss a dimension have no ids; ``reject_rows``,
    which trims alike, returns them with the reason."""
    s = seasons.select(F.col("id").alias("season_id"), "league", "season")
    h = teams.select(F.col("id").alias("home_team_id"), F.col("name").alias("home_team"))
    a = teams.select(F.col("id").alias("away_team_id"), F.col("name").alias("away_team"))
    clean = clean.withColumns({c: clean_text(c) for c in ("home_team", "away_team")})
    j = clean.join(s, ["league", "season"]).join(h, "home_team").join(a, "away_team")
    return j.select(F.col("match_id").alias("id"), "season_id", F.col("match_datetime").alias("date"),
                    "home_team_id", "away_team_id", F.col("home_goals").cast("int").alias("home_team_goals"),
                    F.col("away_goals").cast("int").alias("away_team_goals"), "result", *carry)


def ratings_by_match(elo: DataFrame, matches: DataFrame) -> DataFrame:
    """One equi join on match_id, then two rating rows per match (home, away)."""
    j = elo.select("match_id", "elo_home_pre", "elo_away_pre").join(
        matches.select(F.col("id").alias("match_id"), "season_id", "date", "home_team_id", "away_team_id"), "match_id")
    return j.select("match_id", "season_id", "date", F.explode(F.array(
        F.struct(F.col("home_team_id").alias("team_id"), F.col("elo_home_pre").alias("rating"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team_id").alias("team_id"), F.col("elo_away_pre").alias("rating"), F.lit(False).alias("is_home")),
    )).alias("r")).select("match_id", "r.team_id", "season_id", "date",
                          F.round("r.rating", 2).cast("decimal(7,2)").alias("rating"), "r.is_home")


def match_results(star: dict[str, DataFrame]) -> DataFrame:
    """Matches ⋈ seasons ⋈ teams (home) ⋈ teams (away)."""
    m, s, t = star["matches"], star["seasons"], star["teams"]
    return (m.join(s.select(F.col("id").alias("season_id"), F.col("name").alias("season_name")), "season_id")
            .join(t.select(F.col("id").alias("home_team_id"), F.col("name").alias("home_team")), "home_team_id")
            .join(t.select(F.col("id").alias("away_team_id"), F.col("name").alias("away_team")), "away_team_id")
            .select(F.col("id").alias("match_id"), "season_name", "date", "home_team", "away_team",
                    "home_team_goals", "away_team_goals", "result"))


def match_analytics(star: dict[str, DataFrame]) -> DataFrame:
    """J1 ⋈ match_stats (inner, 1:1)."""
    return match_results(star).join(star["match_stats"], "match_id")


def clean_from_star(star: dict[str, DataFrame]) -> DataFrame:
    """The clean-frame shape back from the star (LEFT JOIN match_stats)."""
    from ..functions.scalars import season_code

    r = match_results(star).join(star["match_stats"], "match_id", "left")
    return r.select("match_id", F.col("date").alias("match_datetime"), "home_team", "away_team", "result",
                    F.col("home_team_goals").alias("home_goals"), F.col("away_team_goals").alias("away_goals"),
                    *[c for c in star["match_stats"].columns if c != "match_id"],
                    season_code("season_name").alias("season"))


def load_counts(star: dict[str, DataFrame]) -> DataFrame:
    """Rows per target table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in star.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------- checks (V)


def check_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """V1: one aggregate pass; per required column, whether it exists and its NULL count."""
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in required]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(c).alias("nulls")) for c in required])
    return counted.select(F.explode(each).alias("v")).select("v.*")


def check_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """V2: number of rows beyond the first per key (sum(count − 1)) and number of duplicated keys."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                      F.count(F.lit(1)).cast("long").alias("duplicated_keys"))


def check_unique(star: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """V3: V2 for every declared UNIQUE / PRIMARY KEY, given as table or ``table#n`` → columns;
    a table that is absent has NULL duplicate rows."""
    spark = next(iter(star.values())).sparkSession
    parts = []
    for name, k in keys.items():
        t = name.split("#")[0]
        label = [F.lit(t).alias("table"), F.lit(",".join(k)).alias("key")]
        parts.append(check_duplicates(star[t], k).select(*label, "duplicate_rows") if t in star
                     else spark.range(1).select(*label, F.lit(None).cast("long").alias("duplicate_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_domain(matches: DataFrame) -> DataFrame:
    """V4: violations per rule for the match fact (NOT NULL, goals ≥ 0, result ∈ {H,D,A}, home ≠ away)."""
    rules = {
        "not_null_keys": F.col("home_team_id").isNull() | F.col("away_team_id").isNull() | F.col("date").isNull(),
        "goals_non_negative": (F.col("home_team_goals") < 0) | (F.col("away_team_goals") < 0),
        "result_domain": ~F.coalesce(F.col("result").isin("H", "D", "A"), F.lit(False)),
        "distinct_sides": F.col("home_team_id") == F.col("away_team_id"),
        "result_matches_score": F.col("result") != F.when(F.col("home_team_goals") > F.col("away_team_goals"), "H")
        .when(F.col("home_team_goals") == F.col("away_team_goals"), "D").otherwise("A"),
    }
    agg = matches.agg(*[F.sum(F.when(p, 1).otherwise(0)).cast("long").alias(r) for r, p in rules.items()])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations"))
                                          for r in rules])).alias("v")).select("v.*")


def check_probability_domain(predictions: DataFrame, cols: Sequence[str] = ("p_home", "p_draw", "p_away")) -> DataFrame:
    """V4: probabilities outside [0, 1]."""
    bad = None
    for c in cols:
        e = (F.col(c) < 0) | (F.col(c) > 1)
        bad = e if bad is None else bad | e
    return predictions.agg(F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("violations"))


def check_foreign_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """V5: child rows whose key is not in the parent (``left_anti``)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def foreign_key_report(star: dict[str, DataFrame]) -> DataFrame:
    """V5 for every declared foreign key: (child, column, parent, orphans). The ids of a parent and the
    references to it are counted together by key, which needs no join: repeats are combined before
    the shuffle, so a team of very many matches is one row a task. A null reference is no orphan. Where a
    table is absent the orphans are NULL."""
    fks = {"seasons": [("league_id", "leagues")],
           "matches": [("season_id", "seasons"), ("home_team_id", "teams"), ("away_team_id", "teams")],
           "match_stats": [("match_id", "matches")], "match_market_odds": [("match_id", "matches")],
           "team_ratings": [("match_id", "matches"), ("team_id", "teams"), ("season_id", "seasons")],
           "predictions_summary": [("match_id", "matches")], "predicted_top_scores": [("match_id", "matches")]}
    refs = [(child, c, p) for child, of in fks.items() for c, p in of]
    spark = next(iter(star.values())).sparkSession

    def rows(counted: DataFrame, orphans: dict) -> DataFrame:
        each = [F.struct(*[F.lit(v).alias(n) for v, n in zip(ref, ("child", "column", "parent"), strict=True)], o.cast("long").alias("orphans"))
                for ref, o in orphans.items()]
        return counted.select(F.explode(F.array(*each)).alias("v")).select("v.*")

    absent = {ref: F.lit(None) for ref in refs if ref[0] not in star or ref[2] not in star}
    parts = [rows(spark.range(1), absent)] if absent else []
    for parent in dict.fromkeys(p for _, _, p in refs):
        mine = [(i, ref) for i, ref in enumerate(refs) if ref[2] == parent and ref not in absent]
        if not mine:
            continue
        keys = star[parent].select(F.col("id").alias("_key"), F.lit(-1).alias("_ref"))
        for i, (child, c, _) in mine:
            keys = keys.unionByName(star[child].where(F.col(c).isNotNull()).select(F.col(c).alias("_key"), F.lit(i).alias("_ref")))
        by_key = keys.groupBy("_key").agg(F.min("_ref").alias("_least"), *[F.sum((F.col("_ref") == i).cast("long")).alias(f"_n{i}") for i, _ in mine])
        counted = by_key.where("_least >= 0").agg(*[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_o{i}") for i, _ in mine])
        parts.append(rows(counted, {ref: F.col(f"_o{i}") for i, ref in mine}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reject_rows(clean: DataFrame, seasons: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V6: split into accepted rows and quarantined rows with a reason (unknown
    season, unknown team, missing date or goals)."""
    s = seasons.select("league", "season", F.lit(True).alias("_s"))
    t_h = teams.select(F.col("name").alias("home_team"), F.lit(True).alias("_h"))
    t_a = teams.select(F.col("name").alias("away_team"), F.lit(True).alias("_a"))
    clean = clean.withColumns({c: clean_text(c) for c in ("home_team", "away_team")})
    x = (clean.join(s, ["league", "season"], "left").join(t_h, "home_team", "left").join(t_a, "away_team", "left"))
    reason = (F.when(F.col("_s").isNull(), "unknown_season")
              .when(F.col("_h").isNull() | F.col("_a").isNull(), "unknown_team")
              .when(F.col("match_datetime").isNull(), "bad_date")
              .when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), "missing_goals"))
    x = x.withColumn("reason", reason).drop("_s", "_h", "_a")
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull())
