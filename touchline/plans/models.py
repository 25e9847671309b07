"""Queries on ratings, the goals model, learned classifiers, calibration and walk-forward scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import boosting as bo
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import goals_model as gm
from ..operators import metrics as me
from ..operators import ratings as rt
from ..operators import relational as rel
from ..sources.tables import TEAMS, matches, sides, table
from .form import _V, _VECTOR_TIER, VENUE
from .metrics import forecasts
from .registry import SQL, query

K = F.col


def _r(digits: int, *names: str):
    return [F.round(n, digits).alias(n) for n in names]


# ------------------------------------------------------------------- ratings
RATED = f""", o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY kickoff, match_id) AS i FROM m),
z AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS BIGINT) AS home, CAST(NULL AS BIGINT) AS away, list_transform(range({TEAMS}), lambda v: CAST(1500 AS DOUBLE)) AS r, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS ch
  UNION ALL SELECT i, match_id, home, away, list_transform(r, lambda v, k: CASE WHEN k = home + 1 THEN x + ch WHEN k = away + 1 THEN y - ch ELSE v END), x, y, ch FROM (
    SELECT o.i, o.match_id, CAST(home_team AS BIGINT) AS home, CAST(away_team AS BIGINT) AS away, r, r[home_team + 1] AS x, r[away_team + 1] AS y,
      CASE WHEN home_goals IS NULL THEN CAST(0 AS DOUBLE) ELSE 20 * CASE WHEN abs(home_goals - away_goals) <= 1 THEN CAST(1 AS DOUBLE) WHEN abs(home_goals - away_goals) = 2 THEN 1.5 ELSE (11 + abs(home_goals - away_goals)) / CAST(8 AS DOUBLE) END
        * (CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END - 1 / (1 + pow(CAST(10 AS DOUBLE), (r[home_team + 1] + 60 - r[away_team + 1]) / CAST(-400 AS DOUBLE)))) END AS ch
    FROM z JOIN o ON o.i = z.i + 1)),
rated AS (SELECT match_id, home, away, x AS home_before, y AS away_before, x + ch AS home_after, y - ch AS away_after, i FROM z WHERE i > 0)"""


@query(f"{RATED} SELECT match_id, round(home_before, 6) AS home_before, round(away_before, 6) AS away_before, round(home_after, 6) AS home_after, round(away_after, 6) AS away_after FROM rated", corpus=True, recursive=True)
def rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rate(matches(spark, sf_dir)).select("match_id", *_r(6, "home_before", "away_before", "home_after", "away_after"))


@query(f"{RATED} SELECT team, round(arg_max(rating, i), 6) AS rating FROM (SELECT home AS team, home_after AS rating, i FROM rated UNION ALL SELECT away, away_after, i FROM rated) GROUP BY team", corpus=True, recursive=True)
def rating_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.final_ratings(rt.rate(matches(spark, sf_dir))).select(K("team").cast("long").alias("team"), *_r(6, "rating"))


@query(f"{RATED}, ex AS (SELECT match_id, 1 / (1 + pow(CAST(10 AS DOUBLE), (home_before + 60 - away_before) / CAST(-400 AS DOUBLE))) AS e FROM rated) SELECT match_id, round(0.75 * e, 8) AS p_home, 0.25 AS p_draw, round(0.75 * (1 - e), 8) AS p_away FROM ex", corpus=True, recursive=True)
def rating_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.forecasts(rt.rate(matches(spark, sf_dir)), F.lit(0.25)).select("match_id", *_r(8, "p_home"), "p_draw", *_r(8, "p_away"))


@query(f"{RATED} SELECT match_id, round(home_before - away_before, 6) AS elo_diff FROM rated", corpus=True, recursive=True)
def rating_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.difference(rt.rate(matches(spark, sf_dir))).select("match_id", *_r(6, "elo_diff"))


@query(
    """, st AS (SELECT season AS fold, min(kickoff) AS start FROM m WHERE season >= 1998 GROUP BY season)
SELECT fold, round(avg(CASE WHEN home_goals > away_goals THEN 1.0 ELSE 0.0 END), 8) AS p_home, round(avg(CASE WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END), 8) AS p_draw, round(avg(CASE WHEN home_goals < away_goals THEN 1.0 ELSE 0.0 END), 8) AS p_away
FROM st JOIN m ON kickoff < start WHERE home_goals IS NOT NULL GROUP BY fold""",
    corpus=True,
)
def base_rates_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return rt.base_rates(rt.expanding(m, ev.season_folds(m, 1998)), ["fold"]).select("fold", *_r(8, *me.P))


@query(", p AS (SELECT event_id AS id, user_id % 9 AS name, event_id % 3 = 0 AS production, ts FROM events) SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY production DESC, ts DESC, id DESC) AS rn FROM p) WHERE rn = 1".replace(", p AS", "WITH p AS", 1))
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production version of each model, or else its newest one."""
    v = table(spark, sf_dir, "events").select(K("event_id").alias("id"), (K("user_id") % 9).alias("name"), (K("event_id") % 3 == 0).alias("production"), "ts")
    return rel.latest(v, ["name"], K("production").desc(), K("ts").desc(), K("id").desc()).select("name", "id")


# --------------------------------------------------------------- goals model
_W = "exp(-ln(CAST(2 AS DOUBLE)) / 540 * (epoch_us(last) - epoch_us(kickoff)) / CAST(86400000000 AS DOUBLE))"
_SUMS = ", ".join(
    ["round(sum(w), 6) AS w", "round(sum(w * home_goals), 6) AS wx", "round(sum(w * away_goals), 6) AS wy"]
    + [f"round(sum(CASE WHEN home_goals = {i} AND away_goals = {j} THEN w ELSE 0 END), 6) AS w{i}{j}" for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
)


@query(f", x AS (SELECT *, max(kickoff) OVER () AS last FROM m WHERE home_goals IS NOT NULL), y AS (SELECT *, {_W} AS w FROM x) SELECT home_team, away_team, {_SUMS} FROM y GROUP BY ALL", corpus=True)
def goals_pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.pair_sums(matches(spark, sf_dir)).select("home_team", "away_team", *_r(6, *gm.STATS))


def rule_params(spark: SparkSession) -> DataFrame:
    """Parameters by rule, one club short, so that forecasts can be held against SQL."""
    t = K("id")
    return spark.range(TEAMS - 1).select(t.cast("int").alias("team"), (((t * 7) % 20 - 9.5) / 30).alias("attack"), (((t * 3) % 20 - 9.5) / 40).alias("defence"), F.lit(0.25).alias("home_adv"), F.lit(-0.05).alias("rho"))


PARAMS = f""", pr AS (SELECT t AS team, CAST((t * 7) % 20 - 9.5 AS DOUBLE) / 30 AS attack, CAST((t * 3) % 20 - 9.5 AS DOUBLE) / 40 AS defence FROM range({TEAMS - 1}) x(t)),
lm AS (SELECT m.*, exp(coalesce(h.attack, 0) - coalesce(a.defence, 0) + 0.25) AS lam, exp(coalesce(a.attack, 0) - coalesce(h.defence, 0)) AS mu, CAST(-0.05 AS DOUBLE) AS rho FROM m LEFT JOIN pr h ON h.team = home_team LEFT JOIN pr a ON a.team = away_team)"""
_TAU = "CASE WHEN x = 0 AND y = 0 THEN 1 - lam * mu * rho WHEN x = 0 AND y = 1 THEN 1 + lam * rho WHEN x = 1 AND y = 0 THEN 1 + mu * rho WHEN x = 1 AND y = 1 THEN 1 - rho ELSE 1 END"
GRID = f"""{PARAMS}, gr AS (SELECT match_id, x, y, exp(x * ln(lam) - lam - ln(factorial(CAST(x AS INT)))) * exp(y * ln(mu) - mu - ln(factorial(CAST(y AS INT)))) * greatest({_TAU}, 0) AS p FROM lm, range(11) a(x), range(11) b(y) WHERE {{where}}),
nm AS (SELECT match_id, x, y, p / sum(p) OVER (PARTITION BY match_id) AS p FROM gr)"""


@query(f"{PARAMS} SELECT match_id, round(lam, 9) AS lam, round(mu, 9) AS mu FROM lm", corpus=True)
def goals_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.expected_goals(matches(spark, sf_dir), rule_params(spark)).select("match_id", *_r(9, "lam", "mu"))


@query(GRID.format(where="true") + " SELECT match_id, round(sum(CASE WHEN x > y THEN p ELSE 0 END), 8) AS p_home, round(sum(CASE WHEN x = y THEN p ELSE 0 END), 8) AS p_draw, round(sum(CASE WHEN x < y THEN p ELSE 0 END), 8) AS p_away, round(sum(x * p), 7) AS goals_home, round(sum(y * p), 7) AS goals_away FROM nm GROUP BY match_id", corpus=True)
def goals_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = gm.forecasts(matches(spark, sf_dir), rule_params(spark))
    return f.select("match_id", *_r(8, *me.P), *_r(7, "goals_home", "goals_away"))


_CELLS = " SELECT match_id, CAST(x AS INT) AS home, CAST(y AS INT) AS away, round_even(p, 6) AS p FROM nm"


def score_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = gm.forecasts(matches(spark, sf_dir), rule_params(spark)).select("match_id", "grid")
    return f.select("match_id", F.posexplode("grid").alias("home", "row")).select("match_id", "home", F.posexplode("row").alias("away", "p"))


@query(GRID.format(where="true") + _CELLS, corpus=True)
def goals_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_grids(spark, sf_dir)


@query(GRID.format(where="true") + _CELLS, corpus=True)
def goals_score_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grids, by the name that they had when the other query read four clubs only."""
    return score_grids(spark, sf_dir)


@query(
    f"""{PARAMS}, s AS (SELECT *, home_goals AS x, away_goals AS y, max(kickoff) OVER () AS last FROM lm WHERE home_goals IS NOT NULL)
SELECT round(sum({_W} * (ln(greatest({_TAU}, 1e-10)) + x * ln(lam) - lam - ln(factorial(x)) + y * ln(mu) - mu - ln(factorial(y)))), 5) AS log_likelihood FROM s""",
    corpus=True,
)
def goals_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.log_likelihood(matches(spark, sf_dir), rule_params(spark), numbers.half_life_to_rate(540.0)).select(*_r(5, "log_likelihood"))


@query()
def goals_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.fit(matches(spark, sf_dir))


@query()
def goals_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.bootstrap(matches(spark, sf_dir), 100)


@query()
def goals_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit written as plain values and read back."""
    return gm.from_artifact(spark, gm.to_artifact(gm.fit(matches(spark, sf_dir)), version="1"))


# ------------------------------------------------- classifiers, walk-forward
FORM = [f"{s}_{c}" for s in ("home", "away") for c in ft.FORM]


def form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.form_dataset(sides(matches(spark, sf_dir).where("home_goals is not null"))).withColumn("outcome", K("outcome").cast("double"))


@query()
def classifier_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import classifiers as cl

    rows = form_rows(spark, sf_dir)
    model = cl.fit_logistic(rows.where("season < 2000"), FORM)
    return cl.predict_logistic(model, rows.where("season >= 2000"), FORM).select("match_id", "season", "outcome", *me.P)


@query()
def classifier_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import classifiers as cl

    model = cl.fit_logistic(form_rows(spark, sf_dir), FORM)
    return spark.createDataFrame(cl.importance(model, FORM), "feature string, importance double")


@query()
def classifier_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of two seasons by boosted trees, grown from the earlier ones with early stopping."""
    rows = form_rows(spark, sf_dir)
    forest = bo.fit(rows.where("season < 2000"), FORM)
    return bo.predict(forest, rows.where("season >= 2000")).select("match_id", "season", "outcome", *me.P)


@query()
def trees_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature's splits gain in trees grown from all seasons."""
    forest = bo.fit(form_rows(spark, sf_dir), FORM)
    return spark.createDataFrame(forest.importance(), "feature string, importance double")


def rule_forest() -> bo.Forest:
    """Six trees of two levels by rule, so that walking them can be held against SQL."""
    nodes = []
    for t in range(6):
        for i in range(3):
            nodes.append((t // 3, t % 3, i, FORM[(3 * t + 5 * i) % len(FORM)], 0.9137 + 0.2 * ((t + i) % 5), 0.0))
        nodes += [(t // 3, t % 3, 3 + j, None, None, ((7 * t + 3 * j) % 9 - 4) / 10) for j in range(4)]
    return bo.Forest.of_nodes(FORM, nodes)


_CELLS = ", ".join(FORM)
_CUT = "(0.9137 + 0.2 * ((t + {i}) % 5))"


@query(
    f"""WITH d AS ({{form}}), x AS (SELECT match_id, t, t % 3 AS k, [{_CELLS}] AS v FROM d, range(6) r(t)),
one AS (SELECT *, CAST(v[1 + (3 * t) % 14] >= {_CUT.format(i=0)} AS INT) AS a FROM x),
two AS (SELECT *, CAST(CASE WHEN a = 0 THEN v[1 + (3 * t + 5) % 14] >= {_CUT.format(i=1)} ELSE v[1 + (3 * t + 10) % 14] >= {_CUT.format(i=2)} END AS INT) AS b FROM one),
m AS (SELECT match_id, k, exp(sum(((7 * t + 3 * (2 * a + b)) % 9 - 4) / CAST(10 AS DOUBLE))) AS e FROM two GROUP BY match_id, k)
SELECT match_id, round(sum(CASE WHEN k = 0 THEN e END) / sum(e), 9) AS p_home, round(sum(CASE WHEN k = 1 THEN e END) / sum(e), 9) AS p_draw, round(sum(CASE WHEN k = 2 THEN e END) / sum(e), 9) AS p_away FROM m GROUP BY match_id""".format(form=SQL["form_dataset"]),
)
def trees_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of every match by a given table of trees."""
    return bo.predict(rule_forest(), form_rows(spark, sf_dir)).select("match_id", *_r(9, *me.P))


@query()
def calibration_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one model's later seasons before and after calibration on its earlier ones, and for two mixtures."""
    from ..operators import classifiers as cl

    f = forecasts(spark, sf_dir).where("model = 'goals'")
    curves = cl.fit_isotonic(f.where("season < 2000"))
    test, out = f.where("season >= 2000"), None
    for shrink in (0.0, 0.3, 1.0):
        one = cl.calibrated(test, curves, shrink).withColumn("shrink", F.lit(shrink))
        out = one if out is None else out.unionByName(one)
    return me.evaluate(out, ["shrink"])


@query()
def calibration_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model's seasons before and after isotonic calibration on its earlier ones, and pooled, for each share of it."""
    return ev.calibration_report(ev.walk_forward(matches(spark, sf_dir), 1998))


@query()
def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.evaluate(ev.walk_forward(matches(spark, sf_dir), 1999), ["model", "season"])


@query()
def walk_forward_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.acceptance(me.evaluate(ev.walk_forward(matches(spark, sf_dir), 1999), ["model", "season"]), "goals")


@query()
def half_life_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ev.sweep(matches(spark, sf_dir), 2000, [270.0, 540.0, 1095.0])
    return me.best_setting(me.evaluate(f, ["setting", "fold"]).select("setting", "fold", "log_loss"))


_FORM = ", ".join(f"round({p}.{c}, 9) AS {n}_{c}" for p, n in (("h", "home"), ("a", "away")) for c in _V)


@query(
    f"{VENUE}{_VECTOR_TIER}{RATED.replace('FROM m)', 'FROM m WHERE home_goals IS NOT NULL)')} SELECT h.match_id, {_FORM}, rest_days_diff, matchday, promotion_flag, tier AS division_tier, round(home_before - away_before, 6) AS elo_diff FROM v h JOIN v a ON h.match_id = a.match_id AND h.venue = 'H' AND a.venue = 'A' JOIN rest ON rest.match_id = h.match_id JOIN day ON day.match_id = h.match_id JOIN pro ON pro.match_id = h.match_id JOIN rated ON rated.match_id = h.match_id",
    sides=True,
    recursive=True,
)
def feature_vector_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole point-in-time vector, rating difference included."""
    from .form import tiers

    games = matches(spark, sf_dir).where("home_goals is not null")
    x = tiers(matches(spark, sf_dir))
    promotions = ft.promotion_flag(x, x).join(x.select("match_id", K("tier").alias("division_tier")), "match_id")
    d = ft.feature_vector(sides(games), rt.difference(rt.rate(games)), promotions)
    plain = ("match_id", "matchday", "promotion_flag", "division_tier", "elo_diff")
    return d.select(*plain[:-1], *_r(6, "elo_diff"), *_r(9, *[c for c in d.columns if c not in plain]))


@query(" SELECT team, round(attack - avg(attack) OVER (), 9) AS attack, round(defence - avg(attack) OVER (), 9) AS defence FROM pr".join(["WITH " + PARAMS[2:].split("),\nlm AS")[0] + ")", ""]))
def goals_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths shifted so that attacks sum to zero; goals do not change."""
    p, w = rule_params(spark), Window.partitionBy("rho")
    mean = F.avg("attack").over(w)
    return p.select(K("team").cast("long").alias("team"), F.round(K("attack") - mean, 9).alias("attack"), F.round(K("defence") - mean, 9).alias("defence"))
