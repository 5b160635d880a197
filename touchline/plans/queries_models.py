"""Registered queries: Poisson model and evaluation
(D5, D7–D18, M2–M4, M7, M11, M12, W8, T3, T6, J9, J13, P6, P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import importance_score
from ..operators import elo, evaluate, form, poisson, tables
from ..sources.tables import contests, fixtures_from_contests
from .catalog import register
from .oracle_sql import CONTESTS, SIDES, with_ctes
from .queries_features import ELO_CTE, FIXTURES_CTE

TEST_SEASON = "2001"
MODELS = ("poisson", "home_bias")

# ---------------------------------------------------------------- Spark side


def split(spark, sf_dir):
    c = contests(spark, sf_dir)
    train, test = evaluate.season_split(c, TEST_SEASON)
    return c, train, test


_FITTED: dict[tuple[str, str], DataFrame] = {}


def strengths(spark, sf_dir):
    """The fitted strength table for the training seasons, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _, train, _ = split(spark, sf_dir)
        _FITTED[key] = poisson.fit_poisson_moments(train)
    return _FITTED[key]


def poisson_lambdas(spark, sf_dir) -> DataFrame:
    _, _, test = split(spark, sf_dir)
    return poisson.expected_goals(test, strengths(spark, sf_dir))


def predictions(spark, sf_dir) -> DataFrame:
    """The predictions table — (match_id, model_name, p_home, p_draw, p_away); scored unrounded."""
    probs = poisson.outcome_probabilities(poisson_lambdas(spark, sf_dir))
    pois = probs.select("match_id", F.lit("poisson").alias("model_name"), "p_home", "p_draw", "p_away")
    _, _, test = split(spark, sf_dir)
    return pois.unionByName(evaluate.constant_predictions(test))


def top_scores(spark, sf_dir, k: int = 3) -> DataFrame:
    top = poisson.top_scorelines(poisson_lambdas(spark, sf_dir), k)
    return top.select("match_id", F.lit("poisson").alias("model_name"), "rank_order",
                      F.col("home_goals_pred").alias("home_goals"), F.col("away_goals_pred").alias("away_goals"),
                      F.round("probability", 6).alias("probability"))


# ---------------------------------------------------------------- oracle CTEs

SPLIT = f"""
train AS (SELECT * FROM contests WHERE season < '{TEST_SEASON}'),
test AS (SELECT * FROM contests WHERE season = '{TEST_SEASON}')"""

STRENGTHS = """
home_means AS (SELECT league, home_team AS team, avg(home_goals) AS home_mean FROM train GROUP BY ALL),
away_means AS (SELECT league, away_team AS team, avg(away_goals) AS away_mean FROM train GROUP BY ALL),
overall AS (SELECT league, avg(home_goals) AS overall_home, avg(away_goals) AS overall_away FROM train GROUP BY ALL),
train_teams AS (SELECT DISTINCT league, team FROM (
  SELECT league, trim(home_team) AS team FROM train UNION ALL SELECT league, trim(away_team) FROM train)
  WHERE team IS NOT NULL AND team <> ''),
strengths AS (
  SELECT t.league, t.team,
    (coalesce(home_mean, overall_home) + coalesce(away_mean, overall_away)) / 2 AS attack,
    1.0 / ((coalesce(home_mean, overall_home) + coalesce(away_mean, overall_away)) / 2 + 0.1) AS defence,
    overall_home / overall_away AS home_advantage
  FROM train_teams t LEFT JOIN home_means h USING (league, team) LEFT JOIN away_means a USING (league, team)
  JOIN overall o USING (league)),
league_adv AS (SELECT league, max(home_advantage) AS home_advantage FROM strengths GROUP BY league)"""


def _expected(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT m.*,
    coalesce(h.attack, 1.0) * coalesce(a.defence, 1.0) * coalesce(la.home_advantage, 1.0) AS lambda_home,
    coalesce(a.attack, 1.0) * coalesce(h.defence, 1.0) AS lambda_away
  FROM {source} m
  LEFT JOIN strengths h ON h.league = m.league AND h.team = m.home_team
  LEFT JOIN strengths a ON a.league = m.league AND a.team = m.away_team
  LEFT JOIN league_adv la ON la.league = m.league)"""


EXPECTED = _expected("expected", "test")

PMF = """
pmfs AS (
  SELECT *,
    list_transform(range(11), lambda k: exp(k * ln(greatest(lambda_home, 1e-12)) - greatest(lambda_home, 1e-12) - lgamma(k + 1))) AS hp,
    list_transform(range(11), lambda k: exp(k * ln(greatest(lambda_away, 1e-12)) - greatest(lambda_away, 1e-12) - lgamma(k + 1))) AS ap
  FROM expected),
grid AS (
  SELECT match_id, i, j, hp[i + 1] * ap[j + 1] AS p FROM pmfs, range(11) gi(i), range(11) gj(j)),
probs AS (
  SELECT match_id, sum(CASE WHEN i > j THEN p ELSE 0 END) / sum(p) AS p_home,
    sum(CASE WHEN i = j THEN p ELSE 0 END) / sum(p) AS p_draw,
    sum(CASE WHEN i < j THEN p ELSE 0 END) / sum(p) AS p_away
  FROM grid GROUP BY match_id),
preds AS (
  SELECT match_id, 'poisson' AS model_name, p_home, p_draw, p_away FROM probs
  UNION ALL
  SELECT match_id, 'home_bias', 0.45::DOUBLE, 0.25::DOUBLE, 0.30::DOUBLE FROM test),
scored AS (
  SELECT p.*, c.league, c.season, c.match_datetime, c.result,
    CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS pred_first,
    CASE WHEN p_home > p_draw AND p_home > p_away THEN 'H' WHEN p_draw > p_home AND p_draw > p_away THEN 'D' ELSE 'A' END AS pred_strict
  FROM preds p JOIN contests c USING (match_id))"""

TOPS = """
tops AS (
  SELECT match_id, 'poisson' AS model_name, rank_order, i AS home_goals, j AS away_goals, round(p, 6) AS probability
  FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, i, j) AS rank_order FROM grid)
  WHERE rank_order <= 3)"""

BASE = (CONTESTS, SPLIT, STRENGTHS, EXPECTED, PMF)


def sql(*extra: str, body: str) -> str:
    return with_ctes(*BASE, *extra, body=body)


# ---------------------------------------------------------------- registrations


@register("season_split", with_ctes(CONTESTS, body=f"""
SELECT CASE WHEN season < '{TEST_SEASON}' THEN 'train' WHEN season = '{TEST_SEASON}' THEN 'test' END AS part,
  league, count(*) AS matches FROM contests GROUP BY ALL"""))
def q_season_split(spark, sf_dir):
    """train = seasons before the test season, test = the test season."""
    _, train, test = split(spark, sf_dir)
    parts = train.select(F.lit("train").alias("part"), "league").unionByName(test.select(F.lit("test").alias("part"), "league"))
    c = contests(spark, sf_dir)
    rest = c.where(F.col("season") > TEST_SEASON).select(F.lit(None).cast("string").alias("part"), "league")
    return parts.unionByName(rest).groupBy("part", "league").agg(F.count(F.lit(1)).cast("long").alias("matches"))


@register("fraction_split", with_ctes(CONTESTS, body="""
SELECT match_id, league, CASE WHEN pr < 0.8 THEN 'train' ELSE 'test' END AS part FROM (
  SELECT match_id, league, percent_rank() OVER (PARTITION BY league ORDER BY match_datetime, match_id) AS pr FROM contests)"""))
def q_fraction_split(spark, sf_dir):
    """Chronological 80/20 split per league."""
    train, test = evaluate.fraction_split(contests(spark, sf_dir), 0.8)
    return (train.select("match_id", "league", F.lit("train").alias("part"))
            .unionByName(test.select("match_id", "league", F.lit("test").alias("part"))))


@register("goal_means", with_ctes(CONTESTS, SPLIT, STRENGTHS, body="""
SELECT t.league, t.team, round(home_mean, 6) AS home_mean, round(away_mean, 6) AS away_mean,
  round(overall_home, 6) AS overall_home, round(overall_away, 6) AS overall_away
FROM train_teams t LEFT JOIN home_means USING (league, team) LEFT JOIN away_means USING (league, team)
JOIN overall USING (league)"""))
def q_goal_means(spark, sf_dir):
    """Home scoring mean per home team, away per away team, and league means (train seasons)."""
    _, train, _ = split(spark, sf_dir)
    home, away, overall = poisson.goal_means(train)
    from ..operators.perspective import distinct_teams

    j = distinct_teams(train).join(home, ["league", "team"], "left").join(away, ["league", "team"], "left").join(overall, "league")
    return j.select("league", "team", *[F.round(c, 6).alias(c) for c in ("home_mean", "away_mean", "overall_home", "overall_away")])


@register("team_strengths", with_ctes(CONTESTS, SPLIT, STRENGTHS, body="""
SELECT league, team, round(attack, 6) AS attack, round(defence, 6) AS defence,
  round(home_advantage, 6) AS home_advantage FROM strengths"""))
def q_team_strengths(spark, sf_dir):
    """Attack, defence and home advantage per (league, team)."""
    s = strengths(spark, sf_dir)
    return s.select("league", "team", *[F.round(c, 6).alias(c) for c in ("attack", "defence", "home_advantage")])


@register("fit_poisson_moments", with_ctes(CONTESTS, SPLIT, STRENGTHS, body="""
SELECT league, count(*) AS teams, round(avg(attack), 6) AS mean_attack, round(avg(defence), 6) AS mean_defence,
  round(max(home_advantage), 6) AS home_advantage FROM strengths GROUP BY league"""))
def q_fit_poisson_moments(spark, sf_dir):
    """M2: the fitted closed-form model state per league (team count, mean strengths, home advantage)."""
    s = strengths(spark, sf_dir)
    return s.groupBy("league").agg(F.count(F.lit(1)).cast("long").alias("teams"),
                                   F.round(F.avg("attack"), 6).alias("mean_attack"),
                                   F.round(F.avg("defence"), 6).alias("mean_defence"),
                                   F.round(F.max("home_advantage"), 6).alias("home_advantage"))


@register("log_likelihood", with_ctes(CONTESTS, SPLIT, STRENGTHS, body="""
SELECT league, count(*) AS matches, round(sum(
    home_goals * ln(lh) - lh - lgamma(home_goals + 1) + away_goals * ln(la) - la - lgamma(away_goals + 1)), 6) AS log_likelihood
FROM (
  SELECT m.league, m.home_goals, m.away_goals,
    greatest(0.01, least(10.0, exp(la_.home_advantage + h.attack - a.defence))) AS lh,
    greatest(0.01, least(10.0, exp(a.attack - h.defence))) AS la
  FROM train m JOIN strengths h ON h.league = m.league AND h.team = m.home_team
  JOIN strengths a ON a.league = m.league AND a.team = m.away_team
  JOIN league_adv la_ ON la_.league = m.league)
GROUP BY league"""))
def q_log_likelihood(spark, sf_dir):
    """Poisson log-likelihood of the training matches per league."""
    _, train, _ = split(spark, sf_dir)
    ll = poisson.log_likelihood(train, poisson.team_strengths(train))
    return ll.select("league", "matches", F.round("log_likelihood", 6).alias("log_likelihood"))


@register("expected_goals", sql(body="""
SELECT match_id, league, home_team, away_team, round(lambda_home, 6) AS lambda_home, round(lambda_away, 6) AS lambda_away
FROM expected"""))
def q_expected_goals(spark, sf_dir):
    """M3: expected goals for every test-season match."""
    x = poisson_lambdas(spark, sf_dir)
    return x.select("match_id", "league", "home_team", "away_team",
                    F.round("lambda_home", 6).alias("lambda_home"), F.round("lambda_away", 6).alias("lambda_away"))


@register("outcome_probabilities", sql(body="""
SELECT match_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away FROM probs"""))
def q_outcome_probabilities(spark, sf_dir):
    """M4: home / draw / away probabilities from the 11×11 score grid."""
    p = poisson.outcome_probabilities(poisson_lambdas(spark, sf_dir))
    return p.select("match_id", *[F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")])


@register("fixture_expand", sql(body="SELECT match_id, i AS home_goals, j AS away_goals, round(p, 6) AS probability FROM grid"))
def q_fixture_expand(spark, sf_dir):
    """Every test match expanded to its 11×11 score grid (in-row, then exploded)."""
    x = poisson_lambdas(spark, sf_dir)
    hp = poisson.poisson_pmf_array(F.col("lambda_home"))
    ap = poisson.poisson_pmf_array(F.col("lambda_away"))
    g = x.select("match_id", hp.alias("hp"), ap.alias("ap"))
    g = g.select("match_id", "hp", "ap", F.posexplode("hp").alias("i", "ph"))
    g = g.select("match_id", "i", "ph", F.posexplode("ap").alias("j", "pa"))
    return g.select("match_id", F.col("i").cast("long").alias("home_goals"), F.col("j").cast("long").alias("away_goals"),
                    F.round(F.col("ph") * F.col("pa"), 6).alias("probability"))


@register("top_scorelines", sql(TOPS, body="SELECT * FROM tops"))
def q_top_scorelines(spark, sf_dir):
    """T6 + W8: the three most likely scorelines per test match."""
    return top_scores(spark, sf_dir, 3)


@register("score_rank", sql(TOPS, body="SELECT match_id, model_name, rank_order FROM tops WHERE rank_order = 1"))
def q_score_rank(spark, sf_dir):
    """The rank-1 scoreline key per (match, model)."""
    return top_scores(spark, sf_dir, 1).select("match_id", "model_name", "rank_order")


@register("store_predictions", sql(body="""
SELECT match_id, 'poisson' AS model_name, round(p_home, 4) AS prob_home_win, round(p_draw, 4) AS prob_draw,
  round(p_away, 4) AS prob_away_win FROM probs
UNION ALL SELECT match_id, 'home_bias', 0.45, 0.25, 0.30 FROM test"""))
def q_store_predictions(spark, sf_dir):
    """The predictions table at the sink's precision (4 decimals, from the unrounded model output)."""
    probs = poisson.outcome_probabilities(poisson_lambdas(spark, sf_dir))
    pois = probs.select("match_id", F.lit("poisson").alias("model_name"), F.col("p_home"), F.col("p_draw"), F.col("p_away"))
    _, _, test = split(spark, sf_dir)
    p = pois.unionByName(evaluate.constant_predictions(test))
    return p.select("match_id", "model_name", F.round("p_home", 4).alias("prob_home_win"),
                    F.round("p_draw", 4).alias("prob_draw"), F.round("p_away", 4).alias("prob_away_win"))


def _stored(spark, sf_dir):
    p = predictions(spark, sf_dir).select("match_id", "model_name", F.col("p_home").alias("prob_home_win"),
                                          F.col("p_draw").alias("prob_draw"), F.col("p_away").alias("prob_away_win"))
    return p, top_scores(spark, sf_dir, 3)


@register("predictions_vs_actual", sql(TOPS, body="""
SELECT p.match_id, p.model_name, c.result AS actual_result, c.home_goals AS actual_home_goals,
  c.away_goals AS actual_away_goals, t.home_goals AS top_home, t.away_goals AS top_away
FROM preds p JOIN contests c USING (match_id)
LEFT JOIN tops t ON t.match_id = p.match_id AND t.model_name = p.model_name AND t.rank_order = 1"""))
def q_predictions_vs_actual(spark, sf_dir):
    """Stored predictions ⋈ matches LEFT JOIN the rank-1 scoreline."""
    p, tops = _stored(spark, sf_dir)
    j = tables.predictions_vs_actual(p, contests(spark, sf_dir), tops)
    return j.select("match_id", "model_name", "actual_result", F.col("actual_home_goals").cast("int"),
                    F.col("actual_away_goals").cast("int"), "top_home", "top_away")


@register("model_accuracy", sql(TOPS, body="""
SELECT model_name, count(*) AS total_matches, round(100 * avg(correct_result), 2) AS result_accuracy_pct,
  round(100 * avg(correct_top), 2) AS top_score_accuracy_pct
FROM (
  SELECT p.model_name,
    CASE WHEN p_home >= p_draw AND p_home >= p_away AND c.result = 'H' THEN 1
         WHEN p_draw >= p_home AND p_draw >= p_away AND c.result = 'D' THEN 1
         WHEN p_away >= p_home AND p_away >= p_draw AND c.result = 'A' THEN 1 ELSE 0 END AS correct_result,
    CASE WHEN t.home_goals = c.home_goals AND t.away_goals = c.away_goals THEN 1 ELSE 0 END AS correct_top
  FROM preds p JOIN contests c USING (match_id)
  LEFT JOIN tops t ON t.match_id = p.match_id AND t.model_name = p.model_name AND t.rank_order = 1)
GROUP BY model_name"""))
def q_model_accuracy(spark, sf_dir):
    """Result and exact-score accuracy per model over stored predictions."""
    p, tops = _stored(spark, sf_dir)
    return tables.model_accuracy(p, contests(spark, sf_dir), tops)


@register("accuracy_brier", sql(body="""
SELECT model_name, count(*) AS matches,
  round(avg(CASE WHEN pred_first = result THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(power((CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END) - p_home, 2)
          + power((CASE WHEN result = 'D' THEN 1.0 ELSE 0.0 END) - p_draw, 2)
          + power((CASE WHEN result = 'A' THEN 1.0 ELSE 0.0 END) - p_away, 2)), 6) AS brier
FROM scored GROUP BY model_name"""))
def q_accuracy_brier(spark, sf_dir):
    """Accuracy and Brier score per model on the test season."""
    _, _, test = split(spark, sf_dir)
    return evaluate.accuracy_brier(predictions(spark, sf_dir), test)


@register("outcome_distribution", sql(body="""
SELECT model_name,
  CAST(sum(CASE WHEN pred_strict = 'H' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_H,
  CAST(sum(CASE WHEN pred_strict = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_D,
  CAST(sum(CASE WHEN pred_strict = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_A,
  CAST(sum(CASE WHEN result = 'H' THEN 1 ELSE 0 END) AS BIGINT) AS actual_H,
  CAST(sum(CASE WHEN result = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS actual_D,
  CAST(sum(CASE WHEN result = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS actual_A
FROM scored GROUP BY model_name"""))
def q_outcome_distribution(spark, sf_dir):
    """Predicted and actual H/D/A counts per model (strict tie rule)."""
    _, _, test = split(spark, sf_dir)
    return evaluate.outcome_distribution(predictions(spark, sf_dir), test)


@register("accuracy_by_type", sql(body="""
SELECT model_name,
  coalesce(round(100.0 * sum(CASE WHEN result = 'H' AND pred_strict = 'H' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'H' THEN 1 ELSE 0 END), 0), 2), 0.0) AS accuracy_H,
  coalesce(round(100.0 * sum(CASE WHEN result = 'D' AND pred_strict = 'D' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'D' THEN 1 ELSE 0 END), 0), 2), 0.0) AS accuracy_D,
  coalesce(round(100.0 * sum(CASE WHEN result = 'A' AND pred_strict = 'A' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN result = 'A' THEN 1 ELSE 0 END), 0), 2), 0.0) AS accuracy_A
FROM scored GROUP BY model_name"""))
def q_accuracy_by_type(spark, sf_dir):
    """Accuracy per actual class."""
    _, _, test = split(spark, sf_dir)
    return evaluate.accuracy_by_type(predictions(spark, sf_dir), test)


@register("matchweek_accuracy", sql(body="""
SELECT model_name, league, matchweek, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total,
  round(100.0 * avg(hit), 1) AS accuracy_pct, any_value(baseline_pct) AS baseline_pct
FROM (
  SELECT s.model_name, s.league, CASE WHEN pred_strict = result THEN 1 ELSE 0 END AS hit,
    (row_number() OVER (PARTITION BY s.model_name, s.league, s.season ORDER BY s.match_datetime, s.match_id) - 1) // 10 + 1 AS matchweek,
    round(100.0 * avg(CASE WHEN pred_strict = result THEN 1 ELSE 0 END) OVER (PARTITION BY s.model_name), 1) AS baseline_pct
  FROM scored s)
GROUP BY model_name, league, matchweek"""))
def q_matchweek_accuracy(spark, sf_dir):
    """D13 + W5: accuracy per matchweek (10 matches a week in season order)."""
    _, _, test = split(spark, sf_dir)
    weeks = form.matchweek_index(test)
    return evaluate.matchweek_accuracy(predictions(spark, sf_dir), weeks)


@register("model_showdown", sql(body="""
SELECT pa AS poisson_accuracy, pb AS poisson_brier, ha AS home_bias_accuracy, hb AS home_bias_brier,
  round(100.0 * (pa - ha), 1) AS accuracy_diff_pct,
  CASE WHEN pa > ha THEN 'poisson' WHEN pa < ha THEN 'home_bias' ELSE 'tie' END AS winner,
  CASE WHEN pa > ha THEN 'poisson' ELSE 'home_bias' END AS best_model
FROM (
  SELECT max(CASE WHEN model_name = 'poisson' THEN acc END) AS pa, max(CASE WHEN model_name = 'poisson' THEN br END) AS pb,
    max(CASE WHEN model_name = 'home_bias' THEN acc END) AS ha, max(CASE WHEN model_name = 'home_bias' THEN br END) AS hb
  FROM (SELECT model_name, round(avg(CASE WHEN pred_first = result THEN 1.0 ELSE 0.0 END), 6) AS acc,
          round(avg(power((CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END) - p_home, 2)
                  + power((CASE WHEN result = 'D' THEN 1.0 ELSE 0.0 END) - p_draw, 2)
                  + power((CASE WHEN result = 'A' THEN 1.0 ELSE 0.0 END) - p_away, 2)), 6) AS br
        FROM scored GROUP BY model_name))"""))
def q_model_showdown(spark, sf_dir):
    """The two models side by side with the winner."""
    _, _, test = split(spark, sf_dir)
    metrics = evaluate.accuracy_brier(predictions(spark, sf_dir), test)
    return evaluate.model_showdown(metrics, MODELS)


@register("home_baseline", with_ctes(CONTESTS, SPLIT, body="""
SELECT league, count(*) AS matches, round(100.0 * avg(CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END), 2) AS home_win_pct
FROM test GROUP BY league"""))
def q_home_baseline(spark, sf_dir):
    """Accuracy of always predicting a home win on the test season."""
    _, _, test = split(spark, sf_dir)
    return evaluate.home_baseline(test)


@register("confusion_matrix", sql(body="""
SELECT model_name, result AS actual, pred_strict AS predicted, count(*) AS n FROM scored GROUP BY ALL"""))
def q_confusion_matrix(spark, sf_dir):
    """Confusion matrix per model."""
    _, _, test = split(spark, sf_dir)
    return evaluate.confusion_matrix(predictions(spark, sf_dir), test)


@register("class_report", sql(body="""
SELECT model_name, class, round(coalesce(tp / nullif(pred_n, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall,
  round(coalesce(2 * coalesce(tp / nullif(pred_n, 0), 0.0) * coalesce(tp / nullif(support, 0), 0.0)
    / nullif(coalesce(tp / nullif(pred_n, 0), 0.0) + coalesce(tp / nullif(support, 0), 0.0), 0), 0.0), 6) AS f1,
  CAST(support AS BIGINT) AS support
FROM (
  SELECT model_name, cls AS class,
    sum(CASE WHEN pred_strict = cls AND result = cls THEN 1 ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN pred_strict = cls THEN 1 ELSE 0 END) AS pred_n,
    sum(CASE WHEN result = cls THEN 1 ELSE 0 END) AS support
  FROM scored, (VALUES ('H'), ('D'), ('A')) v(cls) GROUP BY ALL)"""))
def q_class_report(spark, sf_dir):
    """Precision, recall, F1 and support per class."""
    _, _, test = split(spark, sf_dir)
    return evaluate.class_report(predictions(spark, sf_dir), test)


PROFILE_COLS = ("home_goals", "away_goals", "home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "home_corners", "away_corners")


@register("profile", with_ctes(CONTESTS, body="\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
  max({c})::DOUBLE AS max FROM contests""" for c in PROFILE_COLS)))
def q_profile(spark, sf_dir):
    """NULL counts and describe() statistics (exact quartiles) per numeric column."""
    return evaluate.profile(contests(spark, sf_dir), list(PROFILE_COLS))


@register("result_counts", with_ctes(CONTESTS, body="SELECT league, result, count(*) AS n FROM contests GROUP BY ALL"))
def q_result_counts(spark, sf_dir):
    """Value counts of the result per league."""
    return contests(spark, sf_dir).groupBy("league", "result").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("simple_team_means", with_ctes(CONTESTS, SPLIT, body="""
SELECT t.*,
  round(coalesce((coalesce(h1.hs, 1.0) + coalesce(a1.as_, 1.0)) / 2, 1.0), 6) AS home_avg_goals_scored,
  round(coalesce((coalesce(h1.hc, 1.0) + coalesce(a1.ac, 1.0)) / 2, 1.0), 6) AS home_avg_goals_conceded,
  round(coalesce((coalesce(h2.hs, 1.0) + coalesce(a2.as_, 1.0)) / 2, 1.0), 6) AS away_avg_goals_scored,
  round(coalesce((coalesce(h2.hc, 1.0) + coalesce(a2.ac, 1.0)) / 2, 1.0), 6) AS away_avg_goals_conceded
FROM test t
LEFT JOIN (SELECT league, home_team AS team, avg(home_goals) AS hs, avg(away_goals) AS hc FROM train GROUP BY ALL) h1
  ON h1.league = t.league AND h1.team = t.home_team
LEFT JOIN (SELECT league, away_team AS team, avg(away_goals) AS as_, avg(home_goals) AS ac FROM train GROUP BY ALL) a1
  ON a1.league = t.league AND a1.team = t.home_team
LEFT JOIN (SELECT league, home_team AS team, avg(home_goals) AS hs, avg(away_goals) AS hc FROM train GROUP BY ALL) h2
  ON h2.league = t.league AND h2.team = t.away_team
LEFT JOIN (SELECT league, away_team AS team, avg(away_goals) AS as_, avg(home_goals) AS ac FROM train GROUP BY ALL) a2
  ON a2.league = t.league AND a2.team = t.away_team"""))
def q_simple_team_means(spark, sf_dir):
    """Fallback team means fitted on the training seasons, applied to the test season."""
    _, train, test = split(spark, sf_dir)
    return evaluate.simple_team_means(train, test)


# ---------------------------------------------------- fixtures, priors, featured


@register("fixture_features", with_ctes(CONTESTS, SIDES, FIXTURES_CTE, body="""
SELECT league, fixture_id, home_team, away_team, n_home, n_away, n_either,
  CASE WHEN n_home < 5 AND n_away < 5 THEN 'both_new' WHEN n_home < 5 THEN 'home_new'
       WHEN n_away < 5 THEN 'away_new' WHEN n_either < 10 THEN 'thin' ELSE 'model' END AS gate,
  CASE WHEN n_home < 5 AND n_away < 5 THEN 0.45 WHEN n_home < 5 THEN 0.20 WHEN n_away < 5 THEN 0.65
       WHEN n_either < 10 THEN 0.45 END::DOUBLE AS prior_home,
  CASE WHEN n_home < 5 OR n_away < 5 OR n_either < 10 THEN 0.25 END::DOUBLE AS prior_draw,
  CASE WHEN n_home < 5 AND n_away < 5 THEN 0.30 WHEN n_home < 5 THEN 0.55 WHEN n_away < 5 THEN 0.10
       WHEN n_either < 10 THEN 0.30 END::DOUBLE AS prior_away
FROM (
  SELECT f.*, coalesce(h.n, 0) AS n_home, coalesce(a.n, 0) AS n_away,
    coalesce(h.n, 0) + coalesce(a.n, 0) - coalesce(b.n, 0) AS n_either
  FROM fixtures f
  LEFT JOIN (SELECT league, team, count(*) AS n FROM sides GROUP BY ALL) h ON h.league = f.league AND h.team = f.home_team
  LEFT JOIN (SELECT league, team, count(*) AS n FROM sides GROUP BY ALL) a ON a.league = f.league AND a.team = f.away_team
  LEFT JOIN (SELECT league, least(home_team, away_team) AS ta, greatest(home_team, away_team) AS tb, count(*) AS n
             FROM contests GROUP BY ALL) b
    ON b.league = f.league AND b.ta = least(f.home_team, f.away_team) AND b.tb = greatest(f.home_team, f.away_team))"""))
def q_fixture_features(spark, sf_dir):
    """M7: history gates and constant priors per fixture (the model path is scored by M6)."""
    from ..operators import forest

    c = contests(spark, sf_dir)
    return forest.fixture_gates(fixtures_from_contests(c), c)


@register("promoted_prior", with_ctes(CONTESTS, SPLIT, STRENGTHS, body="""
SELECT t.league, t.team, s.team IS NULL AS promoted,
  round(coalesce(s.attack, q.p25_attack), 6) AS attack, round(coalesce(s.defence, q.p25_defence), 6) AS defence
FROM (SELECT DISTINCT league, team FROM (SELECT league, home_team AS team FROM test UNION ALL SELECT league, away_team FROM test)) t
LEFT JOIN strengths s USING (league, team)
JOIN (SELECT league, quantile_cont(attack, 0.25) AS p25_attack, quantile_cont(defence, 0.75) AS p25_defence
      FROM strengths GROUP BY league) q USING (league)"""))
def q_promoted_prior(spark, sf_dir):
    """Teams of the test season without training history get a bottom-quartile strength."""
    from ..operators import forest

    _, train, test = split(spark, sf_dir)
    return forest.promoted_prior(test, poisson.team_strengths(train))


FINAL_RATINGS = """
finals AS (
  SELECT e.league, 'NATION_' || CAST(i - 1 AS VARCHAR) AS team, round(st[i], 6) AS rating
  FROM elo e JOIN (SELECT league, max(rn) AS rn FROM elo GROUP BY league) m USING (league, rn), range(1, 26) t(i))"""


@register("featured_match", sql(ELO_CTE, FINAL_RATINGS, body="""
SELECT league, match_id, round(score, 6) AS importance FROM (
  SELECT *, row_number() OVER (PARTITION BY league ORDER BY score DESC, match_id) AS rn FROM (
    SELECT c.league, c.match_id,
      round(CASE WHEN p.p_home IS NULL OR p.p_away IS NULL THEN 0.0 ELSE
        0.6 * (((h.rating - 1200.0) / 600.0 + (a.rating - 1200.0) / 600.0) / 2)
        + 0.4 * (1 - abs(p.p_home - p.p_away)) END, 9) AS score
    FROM test c JOIN finals h ON h.league = c.league AND h.team = c.home_team
    JOIN finals a ON a.league = c.league AND a.team = c.away_team
    LEFT JOIN (SELECT * FROM preds WHERE model_name = 'poisson') p USING (match_id)))
WHERE rn = 1"""))
def q_featured_match(spark, sf_dir):
    """T3 + H16: per league the test-season match with the highest importance score, by each team's latest rating."""
    c, _, test = split(spark, sf_dir)
    latest = elo.final_ratings(c).select("league", "team", F.round("rating", 6).alias("rating"))
    home = latest.select("league", F.col("team").alias("home_team"), F.col("rating").alias("home_rating"))
    away = latest.select("league", F.col("team").alias("away_team"), F.col("rating").alias("away_rating"))
    pois = predictions(spark, sf_dir).where(F.col("model_name") == "poisson")
    x = (test.select("league", "match_id", "home_team", "away_team").join(home, ["league", "home_team"])
         .join(away, ["league", "away_team"]).join(pois, "match_id", "left"))
    # Rounded before ranking, so that equal scores tie in any engine.
    scored = x.select("league", "match_id", F.round(importance_score("home_rating", "away_rating", "p_home", "p_away"), 9).alias("score"))
    best = scored.groupBy("league").agg(F.max_by(F.struct("match_id", "score"),
                                                 F.struct("score", -F.col("match_id"))).alias("b"))
    return best.select("league", "b.match_id", F.round("b.score", 6).alias("importance"))


@register("check_probability_domain", sql(body="""
SELECT CAST(coalesce(sum(CASE WHEN p_home < 0 OR p_home > 1 OR p_draw < 0 OR p_draw > 1 OR p_away < 0 OR p_away > 1
  THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM preds"""))
def q_check_probability_domain(spark, sf_dir):
    """V4: stored probabilities outside [0, 1] (predictions table, both models)."""
    from ..operators.star import check_probability_domain

    v = check_probability_domain(predictions(spark, sf_dir))
    return v.select(F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
