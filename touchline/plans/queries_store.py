"""Registered queries: batches into the stored star, stored predictions, as-of states, aliases and market averages
(S5, S7, M12, J11, H10, T2, H13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases, asof, elo, odds, prediction_store, star_store
from ..session import scratch_path, written
from ..sources.tables import contests, read_table
from .catalog import register
from .oracle_sql import CONTESTS, SIDES, with_ctes
from .queries_features import AVG_COLS, ROLLED, UPCOMING_FROM
from .queries_models import BASE, TEST_SEASON, TOPS, predictions, split, top_scores
from .queries_star import EXISTING_BEFORE

# ---------------------------------------------------------------- odds of several bookmakers

#: Line numbers stand for bookmakers, the first one for the reference's own.
BOOKS = ("B365", "BW", "IW", "LB", "PS", "VC", "WH")


def raw_odds(spark, sf_dir):
    """One raw row a match with a column a bookmaker and side, as season files have them; besides, columns whose
    names end alike and are no odds."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    price = {"H": 150 + F.round(F.col("l_discount") * 100).cast("int") * 20, "D": 220 + F.col("l_linenumber") * 20, "A": 150 + F.round(F.col("l_tax") * 100).cast("int") * 25}
    cols = [F.max(F.when(F.col("l_linenumber") == i + 1, (v / 100).cast("decimal(8,2)"))).alias(f"{b}{s}") for i, b in enumerate(BOOKS) for s, v in price.items()]
    return li.groupBy(F.col("l_orderkey").alias("match_id")).agg(*cols, F.sum("l_quantity").alias("YH"), F.max("l_linenumber").alias("HTHA"))


MARKET = """
market AS (
  SELECT l_orderkey AS match_id,
    {books},
    {means}
  FROM (SELECT l_orderkey, l_linenumber, CAST(max(150 + CAST(round(l_discount * 100) AS INT) * 20) AS BIGINT) AS h,
          CAST(max(220 + l_linenumber * 20) AS BIGINT) AS d, CAST(max(150 + CAST(round(l_tax * 100) AS INT) * 25) AS BIGINT) AS a
        FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey)""".format(
    books=", ".join(f"max(CASE WHEN l_linenumber = 1 THEN {s} END) / 100.0 AS b365_{n}_odds" for s, n in (("h", "home_win"), ("d", "draw"), ("a", "away_win"))),
    # Half up in thousandths, in whole numbers.
    means=", ".join(f"((20 * CAST(sum({s}) AS BIGINT) + count(*)) // (2 * count(*))) / 1000.0 AS market_avg_{n}_odds"
                    for s, n in (("h", "home_win"), ("d", "draw"), ("a", "away_win"))))


@register("market_averages", "WITH " + MARKET.strip() + "\nSELECT * FROM market")
def q_market_averages(spark, sf_dir):
    """One bookmaker's odds and the market's average, from the odds columns found in the header."""
    x = odds.market_odds(raw_odds(spark, sf_dir))
    return x.select("match_id", *[F.col(c).cast("double").alias(c) for c in x.columns if c != "match_id"])


# ---------------------------------------------------------------- batches into the stored star

LOADS = ("early", "all", "again")
_STORES: dict[tuple[str, str], star_store.StarStore] = {}


def loaded_store(spark, sf_dir):
    """The store after three loads, once per application: the early seasons, all seasons, all seasons again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = star_store.StarStore(spark, scratch_path(spark, "star-store"))
        c = contests(spark, sf_dir)
        # Each load reads them twice (what it stores, what it rejects), so they are written once for all loads.
        quotes, rated = written(odds.market_odds(raw_odds(spark, sf_dir)), "market-odds"), written(elo.elo_ratings(c), "elo")
        for name, batch in zip(LOADS, (c.where(F.col("season") < EXISTING_BEFORE), c, c), strict=True):
            store.load(name, batch, quotes, rated.join(batch.select("match_id"), "match_id", "left_semi"))
        _STORES[key] = store
    return _STORES[key]


def _load_sql(name: str, cond: str) -> str:
    first = f"(SELECT DISTINCT league, season, match_datetime, trim(home_team) AS h, trim(away_team) AS a FROM contests WHERE {cond})"
    counts = {
        "leagues": f"SELECT count(DISTINCT league) FROM contests WHERE {cond}",
        "seasons": f"SELECT count(*) FROM (SELECT DISTINCT league, season FROM contests WHERE {cond})",
        "teams": f"SELECT count(*) FROM (SELECT trim(home_team) FROM contests WHERE {cond} UNION SELECT trim(away_team) FROM contests WHERE {cond})",
        "matches": f"SELECT count(*) FROM {first}", "match_stats": f"SELECT count(*) FROM {first}", "match_market_odds": f"SELECT count(*) FROM {first}",
        "team_ratings": f"SELECT count(*) FROM (SELECT league, season, match_datetime, h FROM {first} UNION SELECT league, season, match_datetime, a FROM {first})"}
    rows = [f"SELECT '{name}' AS load, '{t}' AS \"table\", ({q}) AS rows, CAST(0 AS BIGINT) AS rejected" for t, q in counts.items() if t != "match_market_odds"]
    rows.append(f"SELECT '{name}', 'match_market_odds', ({counts['match_market_odds']}), "
                f"(SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) l ANTI JOIN (SELECT * FROM contests WHERE {cond}) c ON c.match_id = l_orderkey)")
    return "\nUNION ALL ".join(rows)


@register("load_batches", with_ctes(CONTESTS, body="\nUNION ALL ".join(
    _load_sql(n, f"season < '{EXISTING_BEFORE}'" if n == "early" else "TRUE") for n in LOADS)))
def q_load_batches(spark, sf_dir):
    """S5 + S7: rows of all seven stored tables after each of three loads, and what each load rejected (odds
    without a match); a second load of the same rows leaves every count."""
    store = loaded_store(spark, sf_dir)
    out = None
    for load in LOADS:
        bad = store.spark.read.schema(store.schemas["quarantine"]).parquet(f"{store.root}/data/quarantine/{load}")
        for name, table in store.tables(load).items():
            n = table.agg(F.count(F.lit(1)).alias("rows")).join(bad.where(F.col("table") == name).agg(F.count(F.lit(1)).alias("rejected")))
            row = n.select(F.lit(load).alias("load"), F.lit(name).alias("table"), "rows", "rejected")
            out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- stored predictions

SECOND_RUN = (0.5, 0.25, 0.25)


@register("upsert_predictions", with_ctes(*BASE, body=f"""
SELECT p.match_id, p.model_name, CASE WHEN late AND p.model_name = 'home_bias' THEN 'v2' ELSE 'v1' END AS model_version,
  CASE WHEN late AND p.model_name = 'home_bias' THEN {SECOND_RUN[0]} ELSE round(p_home, 4) END AS prob_home_win,
  CASE WHEN late AND p.model_name = 'home_bias' THEN {SECOND_RUN[1]} ELSE round(p_draw, 4) END AS prob_draw,
  CASE WHEN late AND p.model_name = 'home_bias' THEN {SECOND_RUN[2]} ELSE round(p_away, 4) END AS prob_away_win
FROM preds p JOIN (SELECT match_id, match_datetime >= TIMESTAMP '{UPCOMING_FROM}' AS late FROM test) t USING (match_id)"""))
def q_upsert_predictions(spark, sf_dir):
    """Both models' first run stored, then a second version of one model for the later matches: it replaces
    its own rows of those matches and nothing else."""
    store = prediction_store.PredictionStore(spark, scratch_path(spark, "predictions"))
    store.upsert_summary(predictions(spark, sf_dir), "v1")
    _, _, test = split(spark, sf_dir)
    late = test.where(F.col("match_datetime") >= F.lit(UPCOMING_FROM).cast("timestamp_ntz"))
    store.upsert_summary(late.select("match_id", F.lit("home_bias").alias("model_name"), *[F.lit(p).alias(c) for c, p in zip(("p_home", "p_draw", "p_away"), SECOND_RUN, strict=True)]), "v2")
    return store.summary().select("match_id", "model_name", "model_version", *[F.col(c).cast("double").alias(c) for c in ("prob_home_win", "prob_draw", "prob_away_win")])


@register("upsert_top_scores", with_ctes(*BASE, TOPS, body="""
SELECT match_id, model_name, rank_order, home_goals, away_goals, round(probability, 4) AS probability FROM tops"""))
def q_upsert_top_scores(spark, sf_dir):
    """The top-score table stored twice; the second run of the same model replaces the first."""
    store = prediction_store.PredictionStore(spark, scratch_path(spark, "predictions"))
    tops = top_scores(spark, sf_dir, 3)
    store.upsert_top_scores(tops.where("rank_order = 1").withColumn("probability", F.lit(0.0)))
    store.upsert_top_scores(tops)
    return store.top_scores().select("match_id", "model_name", *[F.col(c).cast("long").alias(c) for c in ("rank_order", "home_goals", "away_goals")],
                                     F.col("probability").cast("double").alias("probability"))


# ---------------------------------------------------------------- states before dated fixtures


def _previous(side: str, cond: str) -> str:
    cols = ", ".join(f"lag({c}) OVER w AS {c}_{side}" for c in AVG_COLS)
    return (f"{side}_before AS (SELECT match_id, {cols} FROM rolled WHERE {cond} "
            "WINDOW w AS (PARTITION BY league, team ORDER BY match_datetime, match_id))")


@register("dated_state_join", with_ctes(CONTESTS, SIDES, ROLLED, _previous("home", "is_home"), _previous("away", "NOT is_home"), body="""
SELECT c.match_id, c.league, c.match_datetime, c.home_team, c.away_team, h.* EXCLUDE (match_id), a.* EXCLUDE (match_id)
FROM contests c JOIN home_before h USING (match_id) JOIN away_before a USING (match_id)"""))
def q_dated_state_join(spark, sf_dir):
    """Every past match as a dated fixture, with the state of the home side's last home row and the away
    side's last away row before it."""
    c = contests(spark, sf_dir)
    return asof.dated_state_join(c.select("match_id", "league", "match_datetime", "home_team", "away_team"), c)


# ---------------------------------------------------------------- team names

ALIASES_SQL = """
known AS (SELECT n_name AS team, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbr, 'land ' || n_nationkey AS other FROM nation WHERE n_regionkey <> 4),
names AS (SELECT team, abbr, lower(unnest([team, abbr, other])) AS alias FROM known),
numbered AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY match_datetime, match_id) AS pos FROM contests),
upcoming AS (SELECT *, (pos - 1) // 10 + 1 AS matchday, row_number() OVER (PARTITION BY league ORDER BY match_datetime, match_id) AS rank
             FROM numbered WHERE match_datetime >= TIMESTAMP '{day}'),
written AS (SELECT u.*, CASE WHEN u.match_id % 2 = 0 THEN 'N' || lpad(substr(home_team, 8), 2, '0') ELSE home_team END AS hw,
              '  Land   ' || substr(away_team, 8) || ' ' AS aw FROM upcoming u WHERE rank <= 4)"""


def nation_aliases(spark, sf_dir):
    """The alias dimension of the nations; those of one region are left unknown."""
    n = read_table(spark, sf_dir, "nation").where("n_regionkey <> 4")
    return aliases.alias_dimension(n.select(F.col("n_name").alias("team"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("abbreviation"),
                                            F.array(F.concat(F.lit("land "), "n_nationkey")).alias("spellings")))


@register("next_rounds", with_ctes(CONTESTS, ALIASES_SQL.format(day=UPCOMING_FROM), body="""
SELECT w.league, w.rank, w.match_id, strftime(w.match_datetime, '%Y-%m-%d') AS match_date, w.matchday,
  coalesce(h.team, trim(hw)) AS home_team, coalesce(a.team, trim(aw)) AS away_team,
  coalesce(h.abbr, upper(substr(trim(hw), 1, 3))) AS home_abbr, coalesce(a.abbr, upper(substr(trim(aw), 1, 3))) AS away_abbr,
  h.team IS NOT NULL AS home_team_known, a.team IS NOT NULL AS away_team_known
FROM written w LEFT JOIN names h ON h.alias = lower(trim(hw)) LEFT JOIN names a ON a.alias = lower(regexp_replace(trim(aw), '\\s+', ' ', 'g'))"""))
def q_next_rounds(spark, sf_dir):
    """H10 + T2: the next matches of each league with round numbers; home sides written as abbreviation or name,
    away sides as another spelling, resolved to canonical teams where the dimension knows them."""
    c = contests(spark, sf_dir)
    number = lambda t: F.substring(t, 8, 10)
    said = c.withColumn("home_team", F.when(F.col("match_id") % 2 == 0, F.concat(F.lit("N"), F.lpad(number("home_team"), 2, "0"))).otherwise(F.col("home_team"))).withColumn(
        "away_team", F.concat(F.lit("  Land   "), number("away_team"), F.lit(" ")))
    return aliases.next_rounds(said, nation_aliases(spark, sf_dir), UPCOMING_FROM, 4)
