"""Queries on forecast scores; forecasts of four models are derived from the corpus by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as me
from ..sources.tables import matches
from .registry import query

K = F.col
MODELS = ("goals", "elo", "base_rate", "market")
_A = "(1 + (match_id * {0} + 7) % 31 + CASE WHEN home_goals > away_goals THEN {1} ELSE 0 END)"
_B = "(1 + (match_id * {0} + 3) % 17 + CASE WHEN home_goals = away_goals THEN {1} ELSE 0 END)"
_C = "(1 + (match_id * {0} + 5) % 23 + CASE WHEN home_goals < away_goals THEN {1} ELSE 0 END)"
_GAIN = {"goals": (3, 12), "elo": (5, 10), "base_rate": (7, 2), "market": (11, 13)}
_OUT = "CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END"


def _case(model: str) -> str:
    a, b, c = (x.format(*_GAIN[model]) for x in (_A, _B, _C))
    total = f"CAST({a} + {b} + {c} AS DOUBLE)"
    return f"SELECT match_id, season, kickoff, '{model}' AS model, {a} / {total} AS p_home, {b} / {total} AS p_draw, {c} / {total} AS p_away, {_OUT} AS outcome FROM m WHERE home_goals IS NOT NULL"


FORECASTS = ", f AS (" + " UNION ALL ".join(map(_case, MODELS)) + ")"
_PICK = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END"
_SCORED = f"""{FORECASTS}, s AS (SELECT *, CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END AS p, greatest(p_home, p_draw, p_away) AS conf, CASE WHEN {_PICK} = outcome THEN 1.0 ELSE 0.0 END AS hit,
  (pow(p_home - CASE WHEN outcome = 0 THEN 1 ELSE 0 END, 2) + pow(p_home + p_draw - CASE WHEN outcome <= 1 THEN 1 ELSE 0 END, 2)) / 2 AS rps,
  pow(p_home - CASE WHEN outcome = 0 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN outcome = 1 THEN 1 ELSE 0 END, 2) + pow(p_away - CASE WHEN outcome = 2 THEN 1 ELSE 0 END, 2) AS brier FROM f),
e AS (SELECT model, season, sum(n * gap) / sum(n) AS ece FROM (SELECT model, season, least(floor(conf * 10), 9) AS b, count(*) AS n, abs(avg(hit) - avg(conf)) AS gap FROM s GROUP BY ALL) GROUP BY ALL)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, match_id, season, kickoff, probabilities and outcome: one scan, one explode."""
    m = matches(spark, sf_dir).where("home_goals is not null")
    h, a, k = K("home_goals"), K("away_goals"), K("match_id")

    def one(model: str):
        step, gain = _GAIN[model]
        parts = [F.lit(1) + (k * step + add) % mod + F.when(won, gain).otherwise(0) for add, mod, won in ((7, 31, h > a), (3, 17, h == a), (5, 23, h < a))]
        total = (parts[0] + parts[1] + parts[2]).cast("double")
        return F.struct(F.lit(model).alias("model"), *[(p / total).alias(n) for p, n in zip(parts, me.P, strict=True)])

    outcome = F.when(h > a, 0).when(h == a, 1).otherwise(2)
    return m.select("match_id", "season", "kickoff", outcome.alias("outcome"), F.explode(F.array(*map(one, MODELS))).alias("x")).select("match_id", "season", "kickoff", "outcome", "x.*")


def _r(*names: str):
    return [F.round(n, 8).alias(n) for n in names]


@query(
    f"""{_SCORED} SELECT model, s.season, count(*) AS n, round(avg(-ln(greatest(p, 1e-15))), 8) AS log_loss, round(avg(rps), 8) AS rps, round(avg(brier), 8) AS brier, round(avg(hit), 8) AS accuracy, round(any_value(ece), 8) AS ece
FROM s JOIN e USING (model, season) GROUP BY model, s.season""",
    corpus=True,
)
def score_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.evaluate(forecasts(spark, sf_dir), ["model", "season"]).select("model", "season", "n", *_r("log_loss", "rps", "brier", "accuracy", "ece"))


@query(
    f"""{_SCORED}, q AS (SELECT sum(n * gap) / sum(n) AS ece FROM (SELECT least(floor(conf * 10), 9) AS b, count(*) AS n, abs(avg(hit) - avg(conf)) AS gap FROM s GROUP BY ALL))
SELECT count(*) AS n, round(avg(-ln(greatest(p, 1e-15))), 8) AS log_loss, round(avg(rps), 8) AS rps, round(avg(brier), 8) AS brier, round(avg(hit), 8) AS accuracy, round(any_value(ece), 8) AS ece FROM s, q""",
    corpus=True,
)
def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.evaluate(forecasts(spark, sf_dir)).select("n", *_r("log_loss", "rps", "brier", "accuracy", "ece"))


@query(
    f"{_SCORED} SELECT model, season, count(*) AS n, round(avg(-ln(greatest(p, 1e-15))), 8) AS log_loss, round(avg(rps), 8) AS rps, round(avg(hit), 8) AS accuracy FROM s GROUP BY GROUPING SETS ((model), (model, season))",
    corpus=True,
)
def score_pooled_and_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.pooled_and_by_season(forecasts(spark, sf_dir)).select("model", "season", "n", *_r("log_loss", "rps", "accuracy"))


@query(f"{_SCORED} SELECT model, CAST(greatest(ceil(conf * 5), 1) AS INT) AS bin, count(*) AS n, round(avg(conf), 8) AS predicted, round(avg(hit), 8) AS observed FROM s GROUP BY ALL", corpus=True)
def score_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.reliability(forecasts(spark, sf_dir), ["model"]).select("model", "bin", "n", *_r("predicted", "observed"))


_POINTS = """, pt AS (SELECT model, p_home AS q, CASE WHEN outcome = 0 THEN 1.0 ELSE 0.0 END AS o FROM f UNION ALL SELECT model, p_draw, CASE WHEN outcome = 1 THEN 1.0 ELSE 0.0 END FROM f UNION ALL SELECT model, p_away, CASE WHEN outcome = 2 THEN 1.0 ELSE 0.0 END FROM f),
cb AS (SELECT model, CAST(least(floor(q / CAST(0.2 AS DOUBLE)), 4) AS INT) AS bin, count(*) AS n, avg(q) * 100 AS predicted, avg(o) * 100 AS observed FROM pt GROUP BY ALL)"""


@query(f"{FORECASTS}{_POINTS} SELECT model, bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM cb", corpus=True)
def score_classwise_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.classwise_bins(forecasts(spark, sf_dir), ["model"]).select("model", "bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


@query(f"{FORECASTS}{_POINTS} SELECT model, round(sum(n * abs(predicted - observed)) / sum(n) / 100, 8) AS ece FROM cb GROUP BY model", corpus=True)
def score_classwise_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.classwise_error(forecasts(spark, sf_dir), ["model"]).select("model", *_r("ece"))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of one model beside the market's, which some fixtures lack."""
    f = forecasts(spark, sf_dir)
    market = f.where("model = 'market' and match_id % 5 <> 0").select("match_id", *[K(p).alias(f"m_{p[2:]}") for p in me.P])
    return f.where("model = 'goals'").join(market, "match_id", "left")


_LOG = f"""{FORECASTS}, lg AS (SELECT g.*, mk.p_home AS m_home, mk.p_draw AS m_draw, mk.p_away AS m_away FROM f g LEFT JOIN f mk ON mk.match_id = g.match_id AND mk.model = 'market' AND mk.match_id % 5 <> 0 WHERE g.model = 'goals'),
ls AS (SELECT match_id, season, kickoff, outcome, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_away >= p_draw AND p_away >= p_home THEN 2 ELSE 1 END AS pick, -ln(greatest(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1e-9)) AS log_loss,
  (pow(p_home - CASE WHEN outcome = 0 THEN 1 ELSE 0 END, 2) + pow(p_home + p_draw - CASE WHEN outcome <= 1 THEN 1 ELSE 0 END, 2)) / 2 AS rps,
  CASE WHEN m_home IS NOT NULL THEN -ln(greatest(CASE outcome WHEN 0 THEN m_home WHEN 1 THEN m_draw ELSE m_away END, 1e-9)) END AS market_log_loss,
  (pow(m_home - CASE WHEN outcome = 0 THEN 1 ELSE 0 END, 2) + pow(m_home + m_draw - CASE WHEN outcome <= 1 THEN 1 ELSE 0 END, 2)) / 2 AS market_rps FROM lg)"""


@query(f"{_LOG} SELECT match_id, pick, pick = outcome AS correct, round(log_loss, 8) AS log_loss, round(rps, 8) AS rps, round(market_log_loss, 8) AS market_log_loss, round(market_rps, 8) AS market_rps FROM ls", corpus=True)
def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.scored_log(log_rows(spark, sf_dir)).select("match_id", "pick", "correct", *_r("log_loss", "rps", "market_log_loss", "market_rps"))


@query(f"{_LOG} SELECT season, count(*) AS n, round(avg(log_loss), 8) AS log_loss, round(avg(market_log_loss), 8) AS market_log_loss, round(avg(rps), 8) AS rps, round(avg(market_rps), 8) AS market_rps FROM ls WHERE market_log_loss IS NOT NULL GROUP BY season", corpus=True)
def score_against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.against_market(me.scored_log(log_rows(spark, sf_dir)), ["season"]).select("season", "n", *_r("log_loss", "market_log_loss", "rps", "market_rps"))


@query(f" SELECT season, round(avg((pow(1 / CAST(3 AS DOUBLE) - CASE WHEN {_OUT} = 0 THEN 1 ELSE 0 END, 2) + pow(2 / CAST(3 AS DOUBLE) - CASE WHEN {_OUT} <= 1 THEN 1 ELSE 0 END, 2)) / 2), 8) AS rps FROM m WHERE home_goals IS NOT NULL GROUP BY season", corpus=True)
def score_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What equal thirds would have scored on the realised outcomes."""
    rows = forecasts(spark, sf_dir).where("model = 'goals'").withColumns({p: F.lit(1 / 3) for p in me.P})
    return rows.groupBy("season").agg(F.round(F.avg(me.rps()), 8).alias("rps"))


@query(
    f"""{_SCORED}, ps AS (SELECT model, season, count(*) AS n, avg(-ln(greatest(p, 1e-15))) AS loss, avg(hit) AS acc FROM s GROUP BY ALL),
w AS (SELECT season, max(loss) FILTER (model = 'goals') AS g, max(loss) FILTER (model = 'base_rate') AS b, max(loss) FILTER (model = 'elo') AS e, max(loss) FILTER (model = 'market') AS k FROM ps GROUP BY season),
a AS (SELECT count(*) AS seasons, count(*) FILTER (g < b) AS base_wins, count(*) FILTER (g < e) AS elo_wins, max(g - k) AS worst_gap, arg_max(season, g - k) AS worst_season FROM w), ac AS (SELECT sum(acc * n) / sum(n) AS accuracy FROM ps WHERE model = 'goals')
SELECT seasons, base_wins, elo_wins, round(worst_gap, 8) AS worst_gap, worst_season, round(accuracy, 8) AS accuracy, base_wins = seasons AS beats_base_rate, elo_wins >= least(4, seasons) AS beats_elo, worst_gap <= 0.03 AS near_market, accuracy BETWEEN 0.51 AND 0.55 AS in_band FROM a, ac""",
    corpus=True,
)
def score_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = me.acceptance(me.evaluate(forecasts(spark, sf_dir), ["model", "season"]), "goals")
    return a.select("seasons", "base_wins", "elo_wins", *_r("worst_gap"), "worst_season", *_r("accuracy"), "beats_base_rate", "beats_elo", "near_market", "in_band")


@query(f"{_SCORED} SELECT arg_min(model, (loss, model)) AS setting, round(min(loss), 8) AS log_loss FROM (SELECT model, avg(loss) AS loss FROM (SELECT model, season, avg(-ln(greatest(p, 1e-15))) AS loss FROM s GROUP BY ALL) GROUP BY model)", corpus=True)
def score_best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = me.evaluate(forecasts(spark, sf_dir), ["model", "season"]).select(K("model").alias("setting"), K("season").alias("fold"), "log_loss")
    return me.best_setting(folds).select("setting", *_r("log_loss"))


@query(f"{_SCORED}, ps AS (SELECT model, season, round(avg(rps), 6) AS rps, round(avg(hit), 6) AS accuracy FROM s GROUP BY ALL) SELECT model AS name, CAST(season AS VARCHAR) AS version, 'accuracy' AS metric, accuracy AS value FROM ps UNION ALL SELECT model, CAST(season AS VARCHAR), 'rps', rps FROM ps", corpus=True)
def score_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read back into rows."""
    e = me.evaluate(forecasts(spark, sf_dir), ["model", "season"])
    stored = e.select(K("model").alias("name"), K("season").cast("string").alias("version"), F.to_json(F.struct(F.round("rps", 6).alias("rps"), F.round("accuracy", 6).alias("accuracy"))).alias("metrics"))
    return me.stored_scoreboard(stored)
