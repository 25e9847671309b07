"""League tables: totals, head-to-head mini-tables and full ranking.

``matches`` needs season, home_team, away_team, home_goals and away_goals; extra
``by`` columns (a simulation run, say) rank independently.  Fixtures without a score
count towards completeness only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points(own: Column, other: Column) -> Column:
    return F.when(own > other, 3).when(own == other, 1).otherwise(0)


def guarded(matches: DataFrame) -> DataFrame:
    """``matches``, failing at run time on a fixture that has one goal count only."""
    half = F.col("home_goals").isNull() != F.col("away_goals").isNull()
    checked = F.when(half, F.raise_error(F.lit("a fixture has both goal counts or neither")).cast("int")).otherwise(F.col("home_goals"))
    return matches.withColumn("home_goals", checked)


def team_rows(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """One row a team and fixture: by..., team, opponent, gf, ga, scored, pts (0 without a score)."""

    def side(own: str, other: str) -> Column:
        gf, ga = F.col(f"{own}_goals"), F.col(f"{other}_goals")
        scored = (gf.isNotNull() & ga.isNotNull()).cast("int")
        return F.struct(F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), gf.alias("gf"), ga.alias("ga"), scored.alias("scored"), F.when(scored == 1, points(gf, ga)).otherwise(0).alias("pts"))

    both = F.explode(F.array(side("home", "away"), side("away", "home"))).alias("x")
    return matches.select(*by, both).select(*by, "x.*")


def pair_rows(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Sums of each ordered pair of teams: what totals and mini-tables are made of."""
    scored = F.col("scored") == 1
    return team_rows(matches, by).groupBy(*by, "team", "opponent").agg(
        F.count("*").alias("fixtures"),
        F.sum("scored").alias("results"),
        F.count_if(scored & (F.col("pts") == 3)).alias("won"),
        F.count_if(scored & (F.col("pts") == 1)).alias("drawn"),
        F.coalesce(F.sum("gf"), F.lit(0)).alias("gf"),
        F.coalesce(F.sum("ga"), F.lit(0)).alias("ga"),
    )


def totals_of(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = {"played": "results", "won": "won", "drawn": "drawn", "gf": "gf", "ga": "ga"}
    s = pairs.groupBy(*by, "team").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    made = {"lost": F.col("played") - F.col("won") - F.col("drawn"), "points": 3 * F.col("won") + F.col("drawn"), "gd": F.col("gf") - F.col("ga")}
    return s.withColumns(made).select(*by, "team", "played", "won", "drawn", "lost", "gf", "ga", "points", "gd")


def totals(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """played, won, drawn, lost, gf, ga, gd and points of every team, those yet to play included."""
    return totals_of(pair_rows(matches, by), by)


def head_to_head(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Of each ordered pair: fixtures, results, points and goal difference between them."""
    return pair_rows(matches, by).select(*by, "team", "opponent", "fixtures", "results", (3 * F.col("won") + F.col("drawn")).alias("h2h_points"), (F.col("gf") - F.col("ga")).alias("h2h_gd"))


def level_pairs(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., team, opponent, points of teams level on points; only teams that are level with another enter the self-join."""
    level = Window.partitionBy(*by, "points")
    tied = table.select(*by, "team", "points", F.count("*").over(level).alias("group_size")).where("group_size > 1").drop("group_size")
    other = tied.select(*by, F.col("team").alias("opponent"), "points")
    return tied.join(other, [*by, "points"]).where("team <> opponent")


def mini_sums(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """h2h_points and h2h_gd of level teams, zero where any pair's two legs in the group are incomplete.

    pairs: by..., team, opponent, points, fixtures, results, h2h_points, h2h_gd.
    """
    whole = ((F.col("fixtures") == 2) & (F.col("results") == 2)).cast("int")
    group = pairs.withColumn("whole", F.min(F.coalesce(whole, F.lit(0))).over(Window.partitionBy(*by, "points")))
    return group.groupBy(*by, "team").agg(F.sum(F.col("h2h_points") * F.col("whole")).alias("h2h_points"), F.sum(F.col("h2h_gd") * F.col("whole")).alias("h2h_gd"))


def positions(table: DataFrame, mini: DataFrame, by: Sequence[str]) -> DataFrame:
    full = table.join(mini, [*by, "team"], "left").na.fill(0, ["h2h_points", "h2h_gd"])
    order = [F.col(c).desc() for c in ("points", "h2h_points", "h2h_gd", "gd", "gf")]
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.col("team").cast("string")))
    return full.withColumn("position", position)


def rank(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """The full table: points, head-to-head points and goal difference, goal difference, goals, team as text."""
    table = totals(matches, by)
    pairs = level_pairs(table, by).join(head_to_head(matches, by), [*by, "team", "opponent"], "left")
    return positions(table, mini_sums(pairs, by), by)


def rank_basic(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """The plain table: points, goal difference, goals, team as a number."""
    position = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("points").desc(), F.col("gd").desc(), F.col("gf").desc(), F.col("team")))
    return totals(matches, by).withColumn("position", position)


def schedule_faults(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Of each group: teams, fixtures, pairs met, and whether it is a double round robin."""
    pair = F.array_sort(F.array("home_team", "away_team"))
    pairs = matches.select(*by, pair.alias("pair")).groupBy(*by, "pair").agg(F.count("*").alias("n"))
    teams = matches.select(*by, F.explode(F.array("home_team", "away_team")).alias("team")).groupBy(*by).agg(F.countDistinct("team").alias("teams"))
    met = pairs.groupBy(*by).agg(F.sum("n").alias("fixtures"), F.count("*").alias("pairs"), F.count_if(F.col("n") != 2).alias("odd_pairs"))
    n = F.col("teams")
    whole = (F.col("fixtures") == n * (n - 1)) & (F.col("pairs") * 2 == n * (n - 1)) & (F.col("odd_pairs") == 0)
    return met.join(teams, list(by)).select(*by, "teams", "fixtures", "pairs", "odd_pairs", whole.alias("complete"))


def form(matches: DataFrame, last: int = 5) -> DataFrame:
    """Results of each team's last matches in (kickoff, match_id) order, as W, D and L."""
    played = matches.where("home_goals is not null and away_goals is not null")

    def side(own: str, other: str) -> Column:
        result = F.when(F.col(f"{own}_goals") > F.col(f"{other}_goals"), "W").when(F.col(f"{own}_goals") == F.col(f"{other}_goals"), "D").otherwise("L")
        return F.struct(F.col(f"{own}_team").alias("team"), result.alias("result"))

    rows = played.select("season", "kickoff", "match_id", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("x")).select("season", "kickoff", "match_id", "x.*")
    recent = F.row_number().over(Window.partitionBy("season", "team").orderBy(F.col("kickoff").desc(), F.col("match_id").desc()))
    some = rows.withColumn("age", recent).where(F.col("age") <= last)
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("age"), "result")))
    return some.groupBy("season", "team").agg(F.array_join(F.transform(ordered, lambda x: x["result"]), "").alias("form"))
