"""Poisson goal models.

``fit_poisson_moments`` is the closed-form model the reference actually uses:
per-team attack from home and away scoring means, defence = 1/(attack+0.1),
home advantage = overall home/away scoring ratio — all grouped aggregates per
league. ``fit_poisson_mle`` is the documented maximum-likelihood model, fitted
by proportional scaling over DataFrames. Prediction is in-row array arithmetic over the
0..10 goal grid: map-only, no shuffle.

Strength tables have one row per (league, team) — a dimension — and are
joined by key; AQE broadcasts them when they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, poisson_log_pmf, poisson_pmf_array
from ..session import written
from .perspective import distinct_teams, team_perspective

# Grid size, λ clip range, defence offset and the unknown-team default.
MAX_GOALS = 10
LAMBDA_MIN, LAMBDA_MAX = 0.01, 10.0
DEFENCE_OFFSET = 0.1
UNKNOWN_STRENGTH = 1.0


def goal_means(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(home means per home team, away means per away team, league-wide means)."""
    home = train.groupBy("league", F.col("home_team").alias("team")).agg(F.avg("home_goals").alias("home_mean"))
    away = train.groupBy("league", F.col("away_team").alias("team")).agg(F.avg("away_goals").alias("away_mean"))
    overall = train.groupBy("league").agg(F.avg("home_goals").alias("overall_home"),
                                          F.avg("away_goals").alias("overall_away"))
    return home, away, overall


def team_strengths(train: DataFrame) -> DataFrame:
    """``(league, team, attack, defence, home_advantage)``.

    attack = mean(home scoring mean or league home mean, away scoring mean or
    league away mean); defence = 1/(attack + 0.1); home_advantage is per league.
    """
    home, away, overall = goal_means(train)
    teams = distinct_teams(train)
    joined = (teams.join(home, ["league", "team"], "left").join(away, ["league", "team"], "left")
              .join(overall, "league"))
    attack = (F.coalesce("home_mean", "overall_home") + F.coalesce("away_mean", "overall_away")) / 2
    return joined.select(
        "league", "team", attack.alias("attack"),
        (1.0 / (attack + DEFENCE_OFFSET)).alias("defence"),
        F.try_divide(F.col("overall_home"), F.col("overall_away")).alias("home_advantage"),
    )


def fit_poisson_moments(train: DataFrame) -> DataFrame:
    """M2 (fit): the strength table, materialised like a fitted model. It has one
    row per (league, team) and is reused by every prediction, so it is
    checkpointed to the shared checkpoint folder (eager) instead of being
    re-derived from the matches at each use."""
    return team_strengths(train).checkpoint(eager=True)


def league_home_advantage(strengths: DataFrame) -> DataFrame:
    return strengths.groupBy("league").agg(F.max("home_advantage").alias("home_advantage"))


def _attach(matches: DataFrame, strengths: DataFrame) -> DataFrame:
    s = strengths.select("league", "team", "attack", "defence")
    h = s.select("league", F.col("team").alias("home_team"), F.col("attack").alias("attack_h"), F.col("defence").alias("defence_h"))
    a = s.select("league", F.col("team").alias("away_team"), F.col("attack").alias("attack_a"), F.col("defence").alias("defence_a"))
    return (matches.join(h, ["league", "home_team"], "left").join(a, ["league", "away_team"], "left")
            .join(league_home_advantage(strengths), "league", "left"))


def log_likelihood(train: DataFrame, strengths: DataFrame) -> DataFrame:
    """Per league Σ logpmf(home, λh) + logpmf(away, λa) with
    λh = exp(home_adv + attack_h − defence_a), λa = exp(attack_a − defence_h), both clipped to [0.01, 10]."""
    x = _attach(train, strengths)
    lh = clip(F.exp(F.col("home_advantage") + F.col("attack_h") - F.col("defence_a")), LAMBDA_MIN, LAMBDA_MAX)
    la = clip(F.exp(F.col("attack_a") - F.col("defence_h")), LAMBDA_MIN, LAMBDA_MAX)
    ll = poisson_log_pmf("home_goals", lh) + poisson_log_pmf("away_goals", la)
    return x.groupBy("league").agg(F.count(F.lit(1)).cast("long").alias("matches"), F.sum(ll).alias("log_likelihood"))


def expected_goals(matches: DataFrame, strengths: DataFrame) -> DataFrame:
    """M3: λ_home = attack_h·defence_a·home_adv, λ_away = attack_a·defence_h; unknown team → 1.0."""
    x = _attach(matches, strengths)
    d = F.lit(UNKNOWN_STRENGTH)
    lam_h = F.coalesce("attack_h", d) * F.coalesce("defence_a", d) * F.coalesce("home_advantage", d)
    lam_a = F.coalesce("attack_a", d) * F.coalesce("defence_h", d)
    return x.select("*", lam_h.alias("lambda_home"), lam_a.alias("lambda_away")).drop(
        "attack_h", "defence_h", "attack_a", "defence_a", "home_advantage")


def _running(terms: list[Column]) -> list[Column]:
    """Left-to-right running sums as plain expressions."""
    out, acc = [], None
    for t in terms:
        acc = t if acc is None else acc + t
        out.append(acc)
    return out


def _sum(terms: list[Column]) -> Column:
    return _running(terms)[-1]


def outcome_probabilities(with_lambdas: DataFrame, max_goals: int = MAX_GOALS) -> DataFrame:
    """M4: home/draw/away probabilities from the (max_goals+1)² score grid, renormalised.
    Adds ``p_home, p_draw, p_away``. Map-only and lambda-free: the pmf arrays are
    built once per row and every sum is a plain (codegen'd) expression."""
    x = with_lambdas.withColumn("_hp", poisson_pmf_array(F.col("lambda_home"), max_goals)) \
                    .withColumn("_ap", poisson_pmf_array(F.col("lambda_away"), max_goals))
    n = max_goals + 1
    hp = [F.element_at("_hp", k + 1) for k in range(n)]
    ap = [F.element_at("_ap", k + 1) for k in range(n)]
    hc, ac = _running(hp), _running(ap)
    # home wins: Σ_i≥1 hp[i] · Σ_{j<i} ap[j];  away wins: Σ_j≥1 ap[j] · Σ_{i<j} hp[i]
    home = _sum([hp[i] * ac[i - 1] for i in range(1, n)])
    away = _sum([ap[j] * hc[j - 1] for j in range(1, n)])
    draw = _sum([hp[k] * ap[k] for k in range(n)])
    x = x.withColumn("_h", home).withColumn("_d", draw).withColumn("_a", away)
    total = F.col("_h") + F.col("_d") + F.col("_a")
    return x.select(*with_lambdas.columns, (F.col("_h") / total).alias("p_home"),
                    (F.col("_d") / total).alias("p_draw"), (F.col("_a") / total).alias("p_away"))


def top_scorelines(with_lambdas: DataFrame, k: int = 3, max_goals: int = MAX_GOALS) -> DataFrame:
    """W8 + T6: the k most likely scorelines per row, ranked by probability ↓,
    then home goals ↑, away goals ↑. In-row ``array_sort`` + ``slice`` over the
    grid's cells (plain struct expressions, no lambda): no shuffle.
    Output adds ``rank_order, home_goals_pred, away_goals_pred, probability``."""
    x = with_lambdas.withColumn("_hp", poisson_pmf_array(F.col("lambda_home"), max_goals)) \
                    .withColumn("_ap", poisson_pmf_array(F.col("lambda_away"), max_goals))
    n = max_goals + 1
    cells = F.array(*[F.struct((-(F.element_at("_hp", i + 1) * F.element_at("_ap", j + 1))).alias("neg_p"),
                               F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in range(n) for j in range(n)])
    top = F.slice(F.array_sort(cells), 1, k)
    exploded = x.select(*with_lambdas.columns, F.posexplode(top).alias("_pos", "_cell"))
    return exploded.select(*with_lambdas.columns, (F.col("_pos") + 1).cast("long").alias("rank_order"),
                           F.col("_cell.i").cast("long").alias("home_goals_pred"),
                           F.col("_cell.j").cast("long").alias("away_goals_pred"),
                           (-F.col("_cell.neg_p")).alias("probability"))


@dataclass
class PoissonFit:
    """``teams``: (league, team, attack, defence); ``leagues``: (league, home). All are factors of the expected
    goals; ``rounds`` and ``change`` tell how many rounds it took and the last one's largest relative change."""

    teams: DataFrame
    leagues: DataFrame
    rounds: int
    change: float


def fit_poisson_mle(train: DataFrame, max_rounds: int = 100, tolerance: float = 1e-4) -> PoissonFit:
    """M1: the maximum-likelihood model log λ = μ + home·is_home + attack[team] − defence[opponent]
    of every league at once, by iterative proportional fitting.

    Each equation of the likelihood says that a team's (or a league's home) observed and
    expected goals agree, so scaling one factor by observed / expected solves its equation:
    attack, home, defence and home terms are updated in turn, as grouped sums over the
    pairings (matches are counted per pairing first), until no factor changes by more than
    ``tolerance``. The likelihood rises with each update. The state is one written row a
    team; nothing is collected but each round's largest change.

    A team that never scored has attack 0, one that never conceded defence factor 0, a
    league without home goals home factor 0 (their maxima lie at infinity); an empty
    table gives empty tables."""
    long = team_perspective(train, stats=[]).select("league", "team", "opponent", "is_home", "goals_scored")
    n = F.count(F.lit(1)).cast("double")
    pairs = written(long.groupBy("league", "team", "opponent").agg(
        F.sum(F.col("is_home").cast("double")).alias("n_home"), n.alias("n"), F.sum("goals_scored").cast("double").alias("goals"),
        F.sum(F.when(F.col("is_home"), F.col("goals_scored")).otherwise(0)).cast("double").alias("home_goals")), "poisson-pairs")
    each = pairs.select("league", "goals", F.explode(F.array(F.struct(F.col("team"), F.lit(1.0).alias("s")), F.struct(F.col("opponent").alias("team"), F.lit(0.0).alias("s")))).alias("v"))
    goals = each.groupBy("league", "v.team").agg(F.sum(F.col("goals") * F.col("v.s")).alias("scored"), F.sum(F.col("goals") * (1 - F.col("v.s"))).alias("conceded"))
    home_goals = pairs.groupBy("league").agg(F.sum("home_goals").alias("home_goals"))
    kept = ["scored", "conceded", "home_goals", "attack", "defence", "home"]
    one = F.lit(1.0)
    # A left join keeps teams without a league, whose goals meet no equation.
    state = written(goals.join(home_goals.hint("merge"), "league", "left").select("*", one.alias("attack"), one.alias("defence"), one.alias("home")), "poisson-state")
    league = Window.partitionBy("league")  # over the state: one row a team

    def scaled(state: DataFrame, key: str, other_key: str, term: str, other: str, observed: str) -> DataFrame:
        """One factor of every team to its own equation, then the home factors to theirs."""
        faced = state.select("league", F.col("team").alias(other_key), F.col(other).alias("_other"), "home")
        none = F.lit(None).cast("double")
        # What a team faces and what it holds meet in one grouping, without a join. A merge join: every round's
        # state would else go through the driver as a broadcast.
        facing = pairs.join(faced.hint("merge"), ["league", other_key]).select(
            "league", F.col(key).alias("team"), *[none.alias(c) for c in kept], (F.col("n_home") * F.col("_other")).alias("_at_home"),
            ((F.col("home") * F.col("n_home") + F.col("n") - F.col("n_home")) * F.col("_other")).alias("_all"))
        held = state.select("league", "team", *kept, none.alias("_at_home"), none.alias("_all"))
        x = facing.unionByName(held).groupBy("league", "team").agg(*[F.max(c).alias(c) for c in kept], F.sum("_at_home").alias("_at_home"), F.sum("_all").alias("_all"))
        new = F.coalesce(F.try_divide(F.col(observed), F.col("_all")), F.lit(0.0))
        y = x.select("league", "team", *[new.alias(c) if c == term else F.col(c) for c in kept if c != "home"], F.col(term).alias("_before"), (new * F.col("_at_home")).alias("_expected"))
        home = F.coalesce(F.try_divide(F.col("home_goals"), F.sum("_expected").over(league)), F.lit(0.0))
        return written(y.withColumn("home", home).drop("_expected"), "poisson-state")

    rounds, change = 0, 0.0
    while rounds < max_rounds:
        state = scaled(state, "team", "opponent", "attack", "defence", "scored")
        moved = state.agg(F.max(F.when(F.col("_before") > 0, F.abs(F.try_divide("attack", "_before") - 1)))).first()[0]
        rounds, change = rounds + 1, moved or 0.0
        state = scaled(state, "opponent", "team", "defence", "attack", "conceded")
        if change <= tolerance:
            break
    homes = state.where(F.col("league").isNotNull()).groupBy("league").agg(F.max("home").alias("home"))
    return PoissonFit(state.select("league", "team", "attack", "defence"), written(homes, "poisson-homes"), rounds, change)


def mle_terms(fit: PoissonFit) -> DataFrame:
    """(league, term, team, estimate) on the log scale: each league's first team is its reference level for
    attack and defence (estimate 0), the intercept μ is its attack times its defence factor; null where a maximum lies at infinity."""
    first = fit.teams.groupBy("league").agg(F.min_by(F.struct("attack", "defence"), "team").alias("r"))
    t = fit.teams.join(first.hint("merge"), "league")
    # The defence factor multiplies goals, the term is subtracted.
    attack, defence = F.ln(F.try_divide("attack", "r.attack")), F.ln(F.try_divide("r.defence", "defence"))
    finite = lambda e: F.when(F.abs(e) < float("inf"), e)
    each = F.explode(F.array(F.struct(F.lit("attack").alias("term"), finite(attack).alias("estimate")),
                             F.struct(F.lit("defence").alias("term"), finite(defence).alias("estimate")))).alias("v")
    none = F.lit(None).cast("string").alias("team")
    return (t.select("league", "team", each).select("league", "v.term", "team", "v.estimate")
            .unionByName(first.select("league", F.lit("intercept").alias("term"), none, finite(F.ln(F.col("r.attack") * F.col("r.defence"))).alias("estimate")))
            .unionByName(fit.leagues.select("league", F.lit("home").alias("term"), none, finite(F.ln("home")).alias("estimate"))))


def mle_expected(matches: DataFrame, fit: PoissonFit) -> DataFrame:
    """M3 with the fitted model: ``lambda_home`` and ``lambda_away`` beside the matches; null for unknown teams."""
    t = fit.teams
    h = t.select("league", F.col("team").alias("home_team"), F.col("attack").alias("_ah"), F.col("defence").alias("_dh"))
    a = t.select("league", F.col("team").alias("away_team"), F.col("attack").alias("_aa"), F.col("defence").alias("_da"))
    # Merge joins: teams and leagues grow with the data, and broadcasts of them go through the driver.
    x = (matches.join(h.hint("merge"), ["league", "home_team"], "left").join(a.hint("merge"), ["league", "away_team"], "left")
         .join(fit.leagues.select("league", F.col("home").alias("_home")).hint("merge"), "league", "left"))
    return x.select(*matches.columns, (F.col("_home") * F.col("_ah") * F.col("_da")).alias("lambda_home"),
                    (F.col("_aa") * F.col("_dh")).alias("lambda_away"))


def score_equations(matches: DataFrame, fit: PoissonFit, tolerance: float = 1e-3) -> DataFrame:
    """At the maximum, observed and expected goals agree for every term: per (league, side, team) the
    observed goals and whether the expected ones are within ``tolerance`` (relative) of them; side ``home``
    has a league's home goals and no team."""
    x = mle_expected(matches, fit)
    sides = x.select("league", F.explode(F.array(
        F.struct(F.lit("attack").alias("side"), F.col("home_team").alias("team"), F.col("home_goals").alias("goals"), F.col("lambda_home").alias("e")),
        F.struct(F.lit("attack").alias("side"), F.col("away_team").alias("team"), F.col("away_goals").alias("goals"), F.col("lambda_away").alias("e")),
        F.struct(F.lit("defence").alias("side"), F.col("away_team").alias("team"), F.col("home_goals").alias("goals"), F.col("lambda_home").alias("e")),
        F.struct(F.lit("defence").alias("side"), F.col("home_team").alias("team"), F.col("away_goals").alias("goals"), F.col("lambda_away").alias("e")),
        F.struct(F.lit("home").alias("side"), F.lit(None).cast("string").alias("team"), F.col("home_goals").alias("goals"), F.col("lambda_home").alias("e")))).alias("v"))
    sums = sides.groupBy("league", "v.side", "v.team").agg(F.sum("v.goals").cast("long").alias("goals"), F.sum("v.e").alias("_e"))
    return sums.select("league", "side", "team", "goals", (F.abs(F.col("_e") - F.col("goals")) <= tolerance * F.greatest(F.col("goals"), F.lit(1))).alias("balanced"))
