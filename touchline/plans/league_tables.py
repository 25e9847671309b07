"""Queries on league tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import standings as st
from ..sources.tables import matches
from .registry import query

_POINTS = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
TOTALS = f""",
p AS (SELECT *, CASE WHEN gf IS NULL THEN 0 ELSE 1 END AS s, CASE WHEN gf IS NULL THEN 0 ELSE {_POINTS} END AS pts FROM t),
tot AS (SELECT season, team, CAST(sum(s) AS BIGINT) AS played, CAST(count(*) FILTER (s = 1 AND pts = 3) AS BIGINT) AS won, CAST(count(*) FILTER (s = 1 AND pts = 1) AS BIGINT) AS drawn,
  CAST(count(*) FILTER (s = 1 AND pts = 0) AS BIGINT) AS lost, CAST(coalesce(sum(gf), 0) AS BIGINT) AS gf, CAST(coalesce(sum(ga), 0) AS BIGINT) AS ga,
  CAST(coalesce(sum(gf), 0) - coalesce(sum(ga), 0) AS BIGINT) AS gd, CAST(sum(pts) AS BIGINT) AS points FROM p GROUP BY season, team)"""
PAIRS = """,
h AS (SELECT season, team, opponent, count(*) AS fixtures, CAST(sum(s) AS BIGINT) AS results, CAST(sum(pts) AS BIGINT) AS h2h_points, CAST(coalesce(sum(gf - ga), 0) AS BIGINT) AS h2h_gd FROM p GROUP BY ALL)"""
RANKED = f"""{TOTALS}{PAIRS},
tied AS (SELECT a.season, a.points, a.team, b.team AS opponent FROM tot a JOIN tot b ON a.season = b.season AND a.points = b.points AND a.team <> b.team),
g AS (SELECT tied.*, h.*, min(CASE WHEN fixtures = 2 AND results = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY tied.season, points) AS whole
  FROM tied LEFT JOIN h ON h.season = tied.season AND h.team = tied.team AND h.opponent = tied.opponent),
mini AS (SELECT season, team, CAST(sum(h2h_points * whole) AS BIGINT) AS h2h_points, CAST(sum(h2h_gd * whole) AS BIGINT) AS h2h_gd FROM g GROUP BY season, team),
ranked AS (SELECT tot.*, coalesce(mini.h2h_points, 0) AS h2h_points, coalesce(mini.h2h_gd, 0) AS h2h_gd,
  CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, coalesce(mini.h2h_points, 0) DESC, coalesce(mini.h2h_gd, 0) DESC, gd DESC, gf DESC, CAST(team AS VARCHAR)) AS INT) AS position
  FROM tot LEFT JOIN mini USING (season, team))"""


@query(f"{TOTALS} SELECT season, team, played, won, drawn, lost, gf, ga, gd, points FROM tot", sides=True)
def standings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.totals(matches(spark, sf_dir))


@query(f"{TOTALS}{PAIRS} SELECT season, team, opponent, fixtures, results, h2h_points, h2h_gd FROM h", sides=True)
def standings_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.head_to_head(matches(spark, sf_dir))


@query(f"{RANKED} SELECT season, position, team, played, won, drawn, lost, gf, ga, gd, points, h2h_points, h2h_gd FROM ranked", sides=True)
def standings_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rank(st.guarded(matches(spark, sf_dir)))


@query(f"{TOTALS} SELECT season, team, points, gd, gf, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, gd DESC, gf DESC, team) AS INT) AS position FROM tot", sides=True)
def standings_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rank_basic(matches(spark, sf_dir)).select("season", "team", "points", "gd", "gf", "position")


@query(
    """, pairs AS (SELECT season, least(home_team, away_team) AS x, greatest(home_team, away_team) AS y, count(*) AS n FROM m GROUP BY ALL),
teams AS (SELECT season, count(DISTINCT team) AS teams FROM t GROUP BY season)
SELECT season, teams, CAST(sum(n) AS BIGINT) AS fixtures, count(*) AS pairs, count(*) FILTER (n <> 2) AS odd_pairs,
  sum(n) = teams * (teams - 1) AND count(*) * 2 = teams * (teams - 1) AND count(*) FILTER (n <> 2) = 0 AS complete FROM pairs JOIN teams USING (season) GROUP BY season, teams""",
    sides=True,
)
def standings_round_robin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.schedule_faults(matches(spark, sf_dir))


@query(
    """, f AS (SELECT season, team, kickoff, match_id, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS r,
  row_number() OVER (PARTITION BY season, team ORDER BY kickoff DESC, match_id DESC) AS age FROM t WHERE gf IS NOT NULL AND ga IS NOT NULL)
SELECT season, team, string_agg(r, '' ORDER BY age DESC) AS form FROM f WHERE age <= 5 GROUP BY season, team""",
    sides=True,
)
def standings_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.form(matches(spark, sf_dir))


MATCHDAY = "1 + (home_team + away_team) % 38"


@query(f" SELECT season, max({MATCHDAY}) AS matchday FROM m WHERE home_goals IS NOT NULL GROUP BY season", corpus=True)
def standings_as_of_matchday(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(1) + (F.col("home_team") + F.col("away_team")) % 38
    return matches(spark, sf_dir).where("home_goals is not null").groupBy("season").agg(F.max(day).alias("matchday"))


@query(f"{TOTALS} SELECT team, played, points, gd, gf FROM tot WHERE season = 2001", sides=True)
def standings_current_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.totals(matches(spark, sf_dir).where("season = 2001")).select("team", "played", "points", "gd", "gf")


@query(
    f"""{RANKED}, b AS (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY points DESC, gd DESC, gf DESC, team) AS published FROM tot)
SELECT season, team, position, CAST(published AS INT) AS published FROM ranked JOIN b USING (season, team) WHERE position <> published""",
    sides=True,
)
def standings_vs_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position by position against a second, published order."""
    games = matches(spark, sf_dir)
    published = st.rank_basic(games).select("season", "team", F.col("position").alias("published"))
    return st.rank(games).select("season", "team", "position").join(published, ["season", "team"]).where("position <> published")


@query(
    """, runs AS (SELECT season, home_team, away_team, run, CAST((home_team * 31 + away_team * 17 + run * 7) % 5 AS INT) AS hg, CAST((home_team * 13 + away_team * 29 + run * 3) % 4 AS INT) AS ag
  FROM m, range(3) x(run) WHERE season = 1999),
t2 AS (SELECT run, home_team AS team, hg AS gf, ag AS ga FROM runs UNION ALL SELECT run, away_team, ag, hg FROM runs)
SELECT run, team, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(gf - ga) AS BIGINT) AS gd FROM t2 GROUP BY run, team""",
    corpus=True,
)
def standings_batch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many completed versions of one season, ranked side by side; the run is part of every key."""
    return _batch(spark, sf_dir).select("run", "team", "points", "gd")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = matches(spark, sf_dir).where("season = 1999").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    h, a, r = F.col("home_team"), F.col("away_team"), F.col("run")
    scored = runs.withColumns({"home_goals": ((h * 31 + a * 17 + r * 7) % 5).cast("int"), "away_goals": ((h * 13 + a * 29 + r * 3) % 4).cast("int")})
    return st.rank(scored, by=("run",))


_BATCH = """, runs AS (SELECT season, home_team, away_team, run, CAST((home_team * 31 + away_team * 17 + run * 7) % 5 AS INT) AS hg, CAST((home_team * 13 + away_team * 29 + run * 3) % 4 AS INT) AS ag
  FROM m, range(3) x(run) WHERE season = 1999),
p AS (SELECT run, home_team AS team, away_team AS opponent, hg AS gf, ag AS ga, 1 AS s, CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS pts FROM runs
  UNION ALL SELECT run, away_team, home_team, ag, hg, 1, CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END FROM runs),
tot AS (SELECT run, team, sum(pts) AS points, sum(gf - ga) AS gd, sum(gf) AS gf FROM p GROUP BY run, team),
h AS (SELECT run, team, opponent, count(*) AS fixtures, sum(pts) AS hp, sum(gf - ga) AS hd FROM p GROUP BY ALL),
g AS (SELECT a.run, a.team, a.points, hp, hd, min(CASE WHEN fixtures = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY a.run, a.points) AS whole
  FROM tot a JOIN tot b ON a.run = b.run AND a.points = b.points AND a.team <> b.team LEFT JOIN h ON h.run = a.run AND h.team = a.team AND h.opponent = b.team),
mini AS (SELECT run, team, sum(hp * whole) AS hp, sum(hd * whole) AS hd FROM g GROUP BY run, team)
SELECT run, team, CAST(row_number() OVER (PARTITION BY run ORDER BY points DESC, coalesce(hp, 0) DESC, coalesce(hd, 0) DESC, gd DESC, gf DESC, CAST(team AS VARCHAR)) AS INT) AS position
FROM tot LEFT JOIN mini USING (run, team)"""


@query(_BATCH, corpus=True)
def standings_batch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("run", "team", "position")


@query(f"{RANKED} SELECT season, team AS champion, points FROM ranked WHERE position = 1", sides=True)
def standings_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rank(matches(spark, sf_dir)).where("position = 1").select("season", F.col("team").alias("champion"), "points")


@query(" SELECT season, team, CAST(row_number() OVER (PARTITION BY season ORDER BY n DESC, team) AS INT) AS place FROM (SELECT season, team, count(*) AS n FROM t GROUP BY ALL)", sides=True)
def ordered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a sorted order."""
    rows = st.team_rows(matches(spark, sf_dir)).groupBy("season", "team").agg(F.count("*").alias("n"))
    return rows.select("season", "team", F.row_number().over(Window.partitionBy("season").orderBy(F.col("n").desc(), "team")).alias("place"))
