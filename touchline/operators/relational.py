"""Filters, joins and latest-row operators shared by the queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ filters
def list_matches(matches: DataFrame, season: int | None = None, team: int | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """Matches that pass the given filters, the latest first; ``limit`` is 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    if season is not None:
        matches = matches.where(F.col("season") == season)
    if team is not None:
        matches = matches.where((F.col("home_team") == team) | (F.col("away_team") == team))
    if status is not None:
        matches = matches.where(F.col("status") == status)
    return matches.orderBy(F.col("kickoff").desc(), F.col("match_id").desc()).limit(limit)


def completed(matches: DataFrame, before: Column | None = None) -> DataFrame:
    found = matches.where("home_goals is not null and away_goals is not null")
    return found if before is None else found.where(F.col("kickoff") < before)


def upcoming(matches: DataFrame, horizon: Column) -> DataFrame:
    """Not yet scored up to a time; overdue fixtures are included."""
    return matches.where(F.col("home_goals").isNull() & (F.col("kickoff") <= horizon))


def between(matches: DataFrame, first: Column, last: Column, expected: int | None = None) -> DataFrame:
    """A closed date range; fails if a given number of rows is not what it holds."""
    found = matches.where(F.col("kickoff").between(first, last))
    if expected is not None and (n := found.count()) != expected:
        raise ValueError(f"expected {expected} fixtures, found {n}")
    return found


def visible(matches: DataFrame, as_of: Column) -> DataFrame:
    """What was known at ``as_of``: strictly earlier matches only."""
    return matches.where(F.col("kickoff") < as_of)


def id_list(text: str, most: int = 100) -> list[int]:
    """1 to ``most`` positive 32-bit numbers from a comma-separated list; anything else is refused."""
    parts = text.split(",")
    if not 1 <= len(parts) <= most or not all(p.strip().isascii() and p.strip().isdigit() for p in parts):
        raise ValueError("give 1 to %d positive numbers" % most)
    ids = [int(p) for p in parts]
    if any(not 0 < i < 2**31 for i in ids):
        raise ValueError("give positive 32-bit numbers")
    return ids


def reject_reason(home: Column, away: Column, known: Column, date: Column) -> Column:
    """Why a raw result row is skipped, or null."""
    blank = F.coalesce(F.trim(home), F.lit("")) == ""
    blank_away = F.coalesce(F.trim(away), F.lit("")) == ""
    return F.when(blank & blank_away, "blank").when(blank | blank_away, "missing team").when(~known, "unmapped").when(home == away, "self-play").when(date.isNull(), "bad date")


def played_or_none(home_goals: Column, away_goals: Column) -> Column:
    """played, unplayed, or a run-time failure for half a score."""
    return F.when(home_goals.isNotNull() & away_goals.isNotNull(), "played").when(home_goals.isNull() & away_goals.isNull(), "unplayed").otherwise(F.raise_error(F.lit("half a score")))


#: Fixed value: forced results that one request may hold.
MAX_FORCED = 50


def forced_results(rows: DataFrame, fixtures: DataFrame, season: int, most: int = MAX_FORCED) -> DataFrame:
    """Forced results as they are, if there are no more than ``most`` and none has a fault; fails otherwise."""
    found = forced_result_fault(rows, fixtures, season)
    n, fault = found.agg(F.count("*"), F.min("fault")).head()
    if n > most:
        raise ValueError(f"{n} forced results; {most} are allowed")
    if fault is not None:
        raise ValueError(f"a forced result is refused: {fault}")
    return rows


def forced_result_fault(rows: DataFrame, fixtures: DataFrame, season: int) -> DataFrame:
    """Forced results (match_id, home_goals, away_goals) with the reason each is refused, or null."""
    n = Window.partitionBy("match_id")
    goals = F.col("f_home").between(0, 20) & F.col("f_away").between(0, 20)
    asked = rows.select("match_id", F.col("home_goals").alias("f_home"), F.col("away_goals").alias("f_away"), F.count("*").over(n).alias("times"))
    reason = (
        F.when(F.col("times") > 1, "duplicate")
        .when(F.col("season").isNull(), "unknown match")
        .when(F.col("season") != season, "wrong season")
        .when(F.col("status") != "NS", "already played")
        .when(~F.coalesce(goals, F.lit(False)), "bad goals")
    )
    return asked.join(fixtures.select("match_id", "season", "status"), "match_id", "left").select("match_id", "f_home", "f_away", reason.alias("fault"))


# -------------------------------------------------------------------- joins
def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``, as a partial aggregate of its cells would give it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def ties_at_top(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """All rows that are first of their key, ties included."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def resolve(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Add ``team_id`` by ``aliases`` (raw_name, team_id); null where no alias is known."""
    return rows.join(aliases.select(F.col("raw_name").alias(name), "team_id"), name, "left")


def resolve_by_priority(rows: DataFrame, maps: Sequence[tuple[str, DataFrame]], into: str) -> DataFrame:
    """``into``: the first hit of several lookups, each (column of rows, frame of key and value)."""
    found = []
    for i, (column, lookup) in enumerate(maps):
        rows = rows.join(lookup.select(F.col("key").alias(column), F.col("value").alias(f"_hit{i}")), column, "left")
        found.append(F.col(f"_hit{i}"))
    return rows.withColumn(into, F.coalesce(*found)).drop(*[f"_hit{i}" for i in range(len(maps))])


def history(fixtures: DataFrame, team_games: DataFrame, last: int) -> DataFrame:
    """Each fixture (match_id, team, as_of) with its team's last games strictly before as_of.

    A team's games are numbered in order, and one pass over games and fixtures together tells how many came before
    each fixture; then an equi-join fetches the ``last`` numbers, so no fixture meets games that it does not keep.
    """
    games = team_games.select("team", F.col("kickoff").alias("past_kickoff"), F.col("match_id").alias("past_id"), "gf", "ga")
    games = games.withColumn("_n", F.row_number().over(Window.partitionBy("team").orderBy("past_kickoff", "past_id")))
    row = F.struct(*fixtures.columns)
    both = fixtures.select("team", F.col("as_of").alias("_at"), F.lit(0).alias("_game"), row.alias("_row"))
    both = both.unionByName(games.select("team", F.col("past_kickoff").alias("_at"), F.lit(1).alias("_game"), F.lit(None).cast(fixtures.schema).alias("_row")))
    before = F.sum("_game").over(Window.partitionBy("team").orderBy("_at", "_game").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = both.withColumn("_before", before).where("_game = 0 and _before > 0")
    asked = asked.select("_row.*", "_before", F.explode(F.sequence(F.greatest(F.col("_before") - last + 1, F.lit(1)), F.col("_before"))).alias("_n"))
    return asked.join(games, ["team", "_n"]).withColumn("age", (F.col("_before") - F.col("_n") + 1).cast("int")).select(*fixtures.columns, "past_kickoff", "past_id", "gf", "ga", "age")


def ordered_pairs(teams: DataFrame) -> DataFrame:
    """All (home_team, away_team) of one short list of clubs; its size is squared, so it is checked."""
    names = [r.team for r in teams.select("team").distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 clubs in one league")
    all_ids = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<int>")
    return teams.select(F.col("team").alias("home_team"), F.explode(all_ids).alias("away_team")).where("home_team <> away_team")


def missing_fixtures(matches: DataFrame) -> DataFrame:
    """Pairs that a double round robin has and ``matches`` does not."""
    teams = matches.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return ordered_pairs(teams).join(matches.select("home_team", "away_team"), ["home_team", "away_team"], "left_anti")


def paired_delta(base: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """other - base for every key; fails if the two do not hold the same keys."""
    left = base.select(key, *[F.col(c).alias(f"{c}_base") for c in columns])
    both = left.join(other.select(key, *columns), key, "full")
    gap = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in [*columns, f"{columns[0]}_base"]]) == 1, F.raise_error(F.lit("runs differ in their teams")).cast("double"))
    return both.select(key, *[F.coalesce(gap, F.col(c) - F.col(f"{c}_base")).alias(f"{c}_delta") for c in columns])


def promoted(team_seasons: DataFrame) -> DataFrame:
    """team_seasons (team, season, tier) with promoted: in a lower tier last season, and not in this one.

    A team of the first season on record is not promoted.
    """
    this = team_seasons.groupBy("team", "season").agg(F.min("tier").alias("tier"))
    before = this.select("team", (F.col("season") + 1).alias("season"), F.col("tier").alias("tier_before"))
    return this.join(before, ["team", "season"], "left").select("team", "season", "tier", F.coalesce(F.col("tier_before") > F.col("tier"), F.lit(False)).cast("int").alias("promoted"))
