"""Queries on simulated season completions; parameters by rule, draws from a digest, so SQL can follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import goals_model as gm
from ..operators import simulation as sim
from ..operators import standings as st
from ..sources.tables import CURRENT, matches
from .models import GRID, rule_params
from .registry import query

K = F.col
RUNS, SEED = 20, 42

_U = "CAST('0x' || substr(md5(concat_ws('|', 42, run, match_id)), {0}, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
#: 0 to 30 goals a side: beyond that is less than a draw can tell.
DRAWN = GRID.format(where=f"season = {CURRENT} AND home_goals IS NULL").replace("range(11)", "range(31)") + f""", hm AS (SELECT match_id, x, sum(sum(p)) OVER (PARTITION BY match_id ORDER BY x) AS c FROM nm GROUP BY match_id, x),
aw AS (SELECT match_id, x, y, sum(p) OVER (PARTITION BY match_id, x ORDER BY y) / sum(p) OVER (PARTITION BY match_id, x) AS c FROM nm),
u AS (SELECT match_id, run, {_U.format(1)} AS u, {_U.format(14)} AS v FROM (SELECT DISTINCT match_id FROM nm), range({RUNS}) r(run)),
dh AS (SELECT u.match_id, run, v, least(count(*) FILTER (c <= u.u), 30) AS hg FROM u JOIN hm ON hm.match_id = u.match_id GROUP BY ALL),
dr AS (SELECT dh.match_id, run, CAST(hg AS INT) AS home_goals, CAST(least(count(*) FILTER (c <= v), 30) AS INT) AS away_goals FROM dh JOIN aw ON aw.match_id = dh.match_id AND aw.x = hg GROUP BY dh.match_id, run, hg, v)"""


def ensemble(spark: SparkSession) -> DataFrame:
    return rule_params(spark).withColumn("vector", F.lit(0))


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where(K("season") == CURRENT).select("match_id", "season", "home_team", "away_team", "home_goals", "away_goals")


@query(f"{DRAWN} SELECT match_id, CAST(run AS INT) AS run, home_goals, away_goals FROM dr", corpus=True)
def simulate_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = season(spark, sf_dir).where("home_goals is null")
    return sim.draw(open_, ensemble(spark), RUNS, SEED).select("match_id", "run", "home_goals", "away_goals")


def _runs(s: str = "", forced: bool = False) -> str:
    """All fixtures of every run, as ``w``; ``s`` is put behind the names of a second set of runs."""
    goals = "CASE WHEN home_team = 3 THEN 3 ELSE dr.home_goals END AS hg, CASE WHEN home_team = 3 THEN 0 ELSE dr.away_goals END AS ag" if forced else "dr.home_goals AS hg, dr.away_goals AS ag"
    return f", w{s} AS (SELECT run, home_team, away_team, {goals} FROM dr JOIN m USING (match_id) UNION ALL SELECT run, home_team, away_team, home_goals, away_goals FROM m, range({RUNS}) r(run) WHERE season = {CURRENT} AND home_goals IS NOT NULL)"


def _tables(s: str = "", forced: bool = False) -> str:
    """The full table of every run, as ``ft``."""
    return f"""{_runs(s, forced)}, p{s} AS (SELECT run, home_team AS team, away_team AS opponent, hg AS gf, ag AS ga, CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS pts FROM w{s} UNION ALL SELECT run, away_team, home_team, ag, hg, CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END FROM w{s}),
tot{s} AS (SELECT run, team, sum(pts) AS points, sum(gf - ga) AS gd, sum(gf) AS gf FROM p{s} GROUP BY run, team), hh{s} AS (SELECT run, team, opponent, count(*) AS fixtures, sum(pts) AS hp, sum(gf - ga) AS hd FROM p{s} GROUP BY ALL),
gp{s} AS (SELECT a.run, a.team, a.points, hp, hd, min(CASE WHEN fixtures = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY a.run, a.points) AS whole FROM tot{s} a JOIN tot{s} b ON a.run = b.run AND a.points = b.points AND a.team <> b.team LEFT JOIN hh{s} hh ON hh.run = a.run AND hh.team = a.team AND hh.opponent = b.team),
mini{s} AS (SELECT run, team, sum(hp * whole) AS hp, sum(hd * whole) AS hd FROM gp{s} GROUP BY run, team),
ft{s} AS (SELECT run, team, points, row_number() OVER (PARTITION BY run ORDER BY points DESC, coalesce(hp, 0) DESC, coalesce(hd, 0) DESC, gd DESC, gf DESC, CAST(team AS VARCHAR)) AS position, count(*) OVER (PARTITION BY run) AS teams FROM tot{s} LEFT JOIN mini{s} USING (run, team))"""


ALL_RUNS, TABLES = DRAWN + _runs(), DRAWN + _tables()


def tables(spark: SparkSession, sf_dir: str, runs: int = RUNS) -> DataFrame:
    return sim.final_tables(season(spark, sf_dir), ensemble(spark), runs, SEED)


@query(f"{TABLES} SELECT CAST(run AS INT) AS run, team, CAST(position AS INT) AS position, CAST(points AS BIGINT) AS points FROM ft", corpus=True)
def simulate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("run", "team", "position", "points")


@query(
    f"""{TABLES} SELECT team, round_even(avg(CASE WHEN position = 1 THEN 1.0 ELSE 0.0 END), 6) AS p_champion, round_even(avg(CASE WHEN position <= 4 THEN 1.0 ELSE 0.0 END), 6) AS p_top4, round_even(avg(CASE WHEN position <= 6 THEN 1.0 ELSE 0.0 END), 6) AS p_top6,
  round_even(avg(CASE WHEN position > teams - 3 THEN 1.0 ELSE 0.0 END), 6) AS p_relegation, round_even(avg(CAST(points AS DOUBLE)), 3) AS expected_points, round_even(quantile_cont(CAST(points AS DOUBLE), 0.025), 3) AS points_low, round_even(quantile_cont(CAST(points AS DOUBLE), 0.975), 3) AS points_high FROM ft GROUP BY team""",
    corpus=True,
)
def simulate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.summary(tables(spark, sf_dir))


@query(f"{TABLES} SELECT team, CAST(position AS INT) AS position, count(*) / CAST({RUNS} AS DOUBLE) AS p FROM ft GROUP BY team, position", corpus=True)
def simulate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.positions(tables(spark, sf_dir), RUNS)


@query(f"{ALL_RUNS} SELECT CAST(run AS INT) AS run, count(*) AS n, count(*) FILTER (hg = ag) AS draws, CAST(sum(CASE WHEN hg = ag THEN 2 ELSE 3 END) AS BIGINT) AS points, true AS kept FROM w GROUP BY run", corpus=True)
def simulate_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = season(spark, sf_dir)
    return sim.conserved(sim.complete(s, sim.draw(s.where("home_goals is null"), ensemble(spark), RUNS, SEED), RUNS))


def forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team 3 wins what it still has to play at home."""
    return season(spark, sf_dir).where("home_goals is null and home_team = 3").select("match_id", F.lit(3).alias("home_goals"), F.lit(0).alias("away_goals"))


@query(f"{DRAWN} SELECT match_id, CAST(run AS INT) AS run, CASE WHEN home_team = 3 THEN 3 ELSE dr.home_goals END AS home_goals, CASE WHEN home_team = 3 THEN 0 ELSE dr.away_goals END AS away_goals FROM dr JOIN m USING (match_id)", corpus=True)
def simulate_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = season(spark, sf_dir).where("home_goals is null")
    return sim.draw(open_, ensemble(spark), RUNS, SEED, forced(spark, sf_dir)).select("match_id", "run", "home_goals", "away_goals")


_CHANCES = ", ".join(f"round_even(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for c, n in (("position = 1", "p_champion"), ("position <= 4", "p_top4"), ("position <= 6", "p_top6"), ("position > teams - 3", "p_relegation"))) + ", round_even(avg(CAST(points AS DOUBLE)), 3) AS expected_points"
_DELTAS = ("p_champion", "p_top4", "p_top6", "p_relegation", "expected_points")


@query(
    f"{TABLES}{_tables('_f', True)}, s0 AS (SELECT team, {_CHANCES} FROM ft GROUP BY team), s1 AS (SELECT team, {_CHANCES} FROM ft_f GROUP BY team) SELECT team, " + ", ".join(f"round(s1.{c} - s0.{c}, 6) AS {c}_delta" for c in _DELTAS) + " FROM s0 JOIN s1 USING (team)",
    corpus=True,
)
def simulate_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sim.what_if(season(spark, sf_dir), ensemble(spark), RUNS, SEED, forced(spark, sf_dir))
    return d.select("team", *[F.round(f"{c}_delta", 6).alias(f"{c}_delta") for c in _DELTAS])


@query()
def simulate_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions whose runs draw their parameters from an ensemble of resampled fits."""
    m = matches(spark, sf_dir)
    fits = gm.bootstrap(m, 100, SEED).withColumnRenamed("replicate", "vector")
    s = season(spark, sf_dir)
    teams = s.select(F.explode(F.array("home_team", "away_team")).alias("team"))
    return sim.summary(sim.final_tables(s, sim.unseen(fits, teams, SEED), 10_000, SEED))


@query(f" SELECT max(1 + (home_team + away_team) % 38) AS matchday FROM m WHERE season = {CURRENT} AND home_goals IS NOT NULL", corpus=True)
def simulate_latest_matchday(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = season(spark, sf_dir)
    calendar = s.select((F.lit(1) + (K("home_team") + K("away_team")) % 38).alias("matchday"), "home_team", "away_team")
    return sim.latest_matchday(calendar, s)


@query()
def simulate_backtest(spark: SparkSession, sf_dir: str, fits: int = 100, runs: int = 10_000) -> DataFrame:
    """Title rank of the champion of every completed season but the first, as of the latest 20th fixture of its clubs."""
    m = matches(spark, sf_dir)
    done = m.groupBy("season").agg(F.count_if(K("home_goals").isNull()).alias("open")).where("open = 0").select("season")
    sides = m.select("season", "kickoff", F.explode(F.array("home_team", "away_team")).alias("team"))
    nth = F.row_number().over(Window.partitionBy("season", "team").orderBy("kickoff"))
    cuts = sides.withColumn("n", nth).where("n = 20").groupBy("season").agg(F.max("kickoff").alias("as_of")).join(done, "season")
    first = cuts.agg(F.min("season").alias("first"))  # one row; nothing is known before it
    return sim.backtest(m, cuts.crossJoin(first).where("season > first").select("season", "as_of"), fits, runs, SEED)


@query(
    f"""{TABLES}, sh AS (SELECT team, sum(n) / CAST({RUNS} AS DOUBLE) AS p FROM (SELECT team, position, count(*) AS n FROM ft GROUP BY ALL) GROUP BY team), rp AS (SELECT run, sum(points) AS points FROM ft GROUP BY run)
SELECT (SELECT count(*) FROM sh) AS teams, (SELECT count(*) FROM sh WHERE abs(p - 1) < 1e-6) AS whole, count(*) AS runs, CAST(min(points) AS BIGINT) AS least, CAST(max(points) AS BIGINT) AS most FROM rp""",
    corpus=True,
)
def simulate_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return sim.verified(sim.positions(t, RUNS), t)
