"""Scans: the star-schema tables, and the match corpus that is bound to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Clubs of the corpus; a season of n clubs has n * (n - 1) fixtures when complete.
TEAMS = 20
#: Lines of ``lineitem`` for each competition of ``league_matches``.
LEAGUE_LINES = 20_000
#: The season that is still being played, and what of it is not yet played.
CURRENT = 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str, teams: int = TEAMS) -> DataFrame:
    """Fixtures and results read out of ``lineitem``: one row a (season, home, away).

    Some fixtures of the current season have no score yet.  Kick-offs are unique.
    """
    return _matches(table(spark, sf_dir, "lineitem"), teams, 1).drop("competition")


def league_matches(spark: SparkSession, sf_dir: str, teams: int = TEAMS) -> DataFrame:
    """As ``matches``, in as many competitions as the table has ``LEAGUE_LINES`` lines, with clubs of their own.

    ``season`` tells competitions' seasons apart: it is competition * 10000 + year.
    """
    line = table(spark, sf_dir, "lineitem")
    leagues = max(1, line.count() // LEAGUE_LINES)  # a count of the files' footers
    m = _matches(line, teams, leagues)
    return m.withColumn("season", (F.col("competition") * 10_000 + F.col("season")).cast("int"))


def _matches(line: DataFrame, teams: int, leagues: int) -> DataFrame:
    league = (F.col("l_suppkey") % leagues).cast("int")
    home, away = ((league * teams + (F.col(c) % teams)).cast("int") if leagues > 1 else (F.col(c) % teams).cast("int") for c in ("l_orderkey", "l_partkey"))
    raw = line.select(
        F.year("l_shipdate").cast("int").alias("season"),
        home.alias("home"),
        away.alias("away"),
        "l_shipdate",
        (F.col("l_quantity").cast("long") % 5).cast("int").alias("hg"),
        ((F.col("l_suppkey") + F.col("l_linenumber")) % 4).cast("int").alias("ag"),
        F.when(F.col("l_linenumber") != 7, ((F.col("l_partkey") + F.col("l_linenumber")) % 9).cast("int")).alias("home_sot"),
        F.when(F.col("l_linenumber") != 7, ((F.col("l_orderkey") + F.col("l_suppkey")) % 9).cast("int")).alias("away_sot"),
        (F.lit(1.2) + (F.col("l_partkey") % 50) / 10).alias("odds_home"),
        (F.lit(2.5) + (F.col("l_suppkey") % 30) / 10).alias("odds_draw"),
        (F.lit(1.5) + (F.col("l_orderkey") % 60) / 10).alias("odds_away"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
    ).where("home <> away")
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    cells = [c for c in raw.columns if c not in ("season", "home", "away")]
    # the first line of each fixture, by a partial aggregate rather than a sort
    first = raw.groupBy("season", "home", "away").agg(F.min(F.struct(*order, *[c for c in cells if c not in order])).alias("m")).select("season", "home", "away", "m.*")
    competition, h, a = F.floor(F.col("home") / teams).cast("int"), F.col("home") % teams, F.col("away") % teams
    seconds = h * teams + a
    played = ~((F.col("season") == CURRENT) & ((h * 7 + a * 3) % 4 == 0))
    return first.select(
        competition.alias("competition"),
        (competition.cast("long") * 10_000_000_000 + F.col("season").cast("long") * 1_000_000 + h * 1000 + a).alias("match_id"),
        "season",
        F.col("home").alias("home_team"),
        F.col("away").alias("away_team"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).alias("kickoff"),
        F.when(played, F.col("hg")).alias("home_goals"),
        F.when(played, F.col("ag")).alias("away_goals"),
        "home_sot",
        "away_sot",
        "odds_home",
        "odds_draw",
        "odds_away",
        F.when(played, "FT").otherwise("NS").alias("status"),
    )


#: The same corpus in DuckDB, as the common table expression ``m``.
CORPUS = f"""
r AS (SELECT CAST(year(l_shipdate) AS INT) AS season, CAST(l_orderkey % {TEAMS} AS INT) AS home, CAST(l_partkey % {TEAMS} AS INT) AS away, l_shipdate,
  CAST(CAST(l_quantity AS BIGINT) % 5 AS INT) AS hg, CAST((l_suppkey + l_linenumber) % 4 AS INT) AS ag,
  CASE WHEN l_linenumber <> 7 THEN CAST((l_partkey + l_linenumber) % 9 AS INT) END AS home_sot,
  CASE WHEN l_linenumber <> 7 THEN CAST((l_orderkey + l_suppkey) % 9 AS INT) END AS away_sot,
  CAST(1.2 AS DOUBLE) + (l_partkey % 50) / CAST(10 AS DOUBLE) AS odds_home, CAST(2.5 AS DOUBLE) + (l_suppkey % 30) / CAST(10 AS DOUBLE) AS odds_draw,
  CAST(1.5 AS DOUBLE) + (l_orderkey % 60) / CAST(10 AS DOUBLE) AS odds_away, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY season, home, away ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rn FROM r WHERE home <> away),
m AS (SELECT CAST(season AS BIGINT) * 1000000 + home * 1000 + away AS match_id, season, home AS home_team, away AS away_team,
  l_shipdate + to_seconds(home * {TEAMS} + away) AS kickoff,
  CASE WHEN season = {CURRENT} AND (home * 7 + away * 3) % 4 = 0 THEN NULL ELSE hg END AS home_goals,
  CASE WHEN season = {CURRENT} AND (home * 7 + away * 3) % 4 = 0 THEN NULL ELSE ag END AS away_goals,
  home_sot, away_sot, odds_home, odds_draw, odds_away,
  CASE WHEN season = {CURRENT} AND (home * 7 + away * 3) % 4 = 0 THEN 'NS' ELSE 'FT' END AS status FROM d WHERE rn = 1)"""

#: The corpus of competitions, ``m`` again.
LEAGUES = f"""
n AS (SELECT greatest(1, count(*) // {LEAGUE_LINES}) AS leagues FROM lineitem),
r AS (SELECT CAST(year(l_shipdate) AS INT) AS season, CAST(l_suppkey % leagues AS INT) AS league, CAST(l_orderkey % {TEAMS} AS INT) AS home, CAST(l_partkey % {TEAMS} AS INT) AS away, lineitem.* FROM lineitem, n),
d AS (SELECT *, row_number() OVER (PARTITION BY season, league, home, away ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rn FROM r WHERE home <> away),
m AS (SELECT CAST(league AS BIGINT) * 10000000000 + CAST(season AS BIGINT) * 1000000 + home * 1000 + away AS match_id, CAST(league * 10000 + season AS INT) AS season, league AS competition,
  CAST(league * {TEAMS} + home AS INT) AS home_team, CAST(league * {TEAMS} + away AS INT) AS away_team, l_shipdate + to_seconds(home * {TEAMS} + away) AS kickoff,
  CASE WHEN season = {CURRENT} AND (home * 7 + away * 3) % 4 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) % 5 AS INT) END AS home_goals,
  CASE WHEN season = {CURRENT} AND (home * 7 + away * 3) % 4 = 0 THEN NULL ELSE CAST((l_suppkey + l_linenumber) % 4 AS INT) END AS away_goals,
  CASE WHEN l_linenumber <> 7 THEN CAST((l_partkey + l_linenumber) % 9 AS INT) END AS home_sot, CASE WHEN l_linenumber <> 7 THEN CAST((l_orderkey + l_suppkey) % 9 AS INT) END AS away_sot FROM d WHERE rn = 1)"""

#: Both sides of each match, as ``t``, on top of CORPUS.
SIDES = """
t AS (SELECT match_id, season, kickoff, home_team AS team, away_team AS opponent, 'H' AS venue, home_goals AS gf, away_goals AS ga, home_sot AS sot, away_sot AS sot_against FROM m
  UNION ALL SELECT match_id, season, kickoff, away_team, home_team, 'A', away_goals, home_goals, away_sot, home_sot FROM m)"""


def sides(games: DataFrame) -> DataFrame:
    """Each match from both teams' views: one scan and a two-element explode, not a union."""

    def side(venue: str, own: str, other: str):
        return F.struct(
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(venue).alias("venue"),
            F.col(f"{own}_goals").alias("gf"),
            F.col(f"{other}_goals").alias("ga"),
            F.col(f"{own}_sot").alias("sot"),
            F.col(f"{other}_sot").alias("sot_against"),
        )

    both = F.explode(F.array(side("H", "home", "away"), side("A", "away", "home"))).alias("x")
    return games.select("match_id", "season", "kickoff", both).select("match_id", "season", "kickoff", "x.*")


def latest_first(*columns: str):
    """Descending order of ``columns``, for latest-row windows."""
    return [F.col(c).desc() for c in columns]


def window(*partition: str) -> Window:
    return Window.partitionBy(*partition)
