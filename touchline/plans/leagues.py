"""Queries over all competitions of a corpus that grows with its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import goals_model as gm
from ..operators import ratings as rt
from ..operators import standings as st
from ..sources.tables import CORPUS, LEAGUES, TEAMS, league_matches, sides
from . import form, league_tables, models  # noqa: F401  they register the SQL that is taken over
from .registry import SQL, query


def _as(name: str) -> str:
    """The SQL of a query on one competition, over all of them."""
    return SQL[name].replace(CORPUS, LEAGUES)


@query(_as("standings_full"))
def leagues_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rank(st.guarded(league_matches(spark, sf_dir)))


@query(_as("form_dataset"))
def leagues_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.rounded_dataset(sides(league_matches(spark, sf_dir).where("home_goals is not null")))


@query(_as("goals_pair_sums").replace("max(kickoff) OVER ()", "max(kickoff) OVER (PARTITION BY competition)"))
def leagues_pair_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gm.pair_sums(league_matches(spark, sf_dir), ["competition"]).select("home_team", "away_team", *models._r(6, *gm.STATS))


RATED = (
    models.RATED.replace("row_number() OVER (ORDER BY", "row_number() OVER (PARTITION BY competition ORDER BY")
    .replace("z AS (SELECT CAST(0 AS BIGINT) AS i,", "z AS (SELECT DISTINCT competition AS c, CAST(0 AS BIGINT) AS i,")
    .replace("CAST(0 AS DOUBLE) AS ch\n  UNION ALL SELECT i,", "CAST(0 AS DOUBLE) AS ch FROM o\n  UNION ALL SELECT c, i,")
    .replace("SELECT o.i, o.match_id,", "SELECT o.competition AS c, o.i, o.match_id,")
    .replace("ON o.i = z.i + 1", "ON o.i = z.i + 1 AND o.competition = z.c")
    .replace("CAST(home_team AS BIGINT)", f"CAST(home_team % {TEAMS} AS BIGINT)")
    .replace("CAST(away_team AS BIGINT)", f"CAST(away_team % {TEAMS} AS BIGINT)")
    .replace("r[home_team + 1", f"r[home_team % {TEAMS} + 1")
    .replace("r[away_team + 1", f"r[away_team % {TEAMS} + 1")
)


@query(f"WITH RECURSIVE {LEAGUES}{RATED} SELECT match_id, round(home_before, 6) AS home_before, round(away_before, 6) AS away_before, round(home_after, 6) AS home_after, round(away_after, 6) AS away_after FROM rated")
def leagues_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions are pools, and pools are rated side by side."""
    return rt.rate(league_matches(spark, sf_dir), "competition").select("match_id", *models._r(6, "home_before", "away_before", "home_after", "away_after"))


@query()
def leagues_goals_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of each competition, side by side."""
    return gm.fit(league_matches(spark, sf_dir), ["competition"]).withColumn("competition", F.col("competition").cast("int"))
