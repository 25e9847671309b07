"""Data-quality checks: each gives the rows, or the counts, that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import standings as st


def season_counts(seasons: DataFrame, games: DataFrame, ranges: DataFrame, live_floor: float = 0.55, median_floor: float = 0.60) -> DataFrame:
    """Fixture counts of each season with a verdict: empty, range, low or ok.

    seasons: competition, season, is_live; games: competition, season; ranges: competition,
    low, high.  A live season needs ``live_floor`` of the lower bound only; a finished one
    also ``median_floor`` of its competition's upper median.
    """
    counted = seasons.join(games.groupBy("competition", "season").agg(F.count("*").alias("n")), ["competition", "season"], "left").na.fill(0, ["n"])
    by = Window.partitionBy("competition")
    some = counted.where("n > 0").select("competition", "n", F.row_number().over(by.orderBy("n")).alias("i"), F.count("*").over(by).alias("of"))
    medians = some.where("i = of div 2 + 1").select("competition", F.col("n").alias("median"))
    low = F.coalesce(F.col("low"), F.lit(0))
    floor = F.when(F.col("is_live"), F.floor(low * live_floor)).otherwise(low)
    inside = F.col("n").between(floor, F.coalesce(F.col("high"), F.lit(10_000)))
    verdict = F.when(F.col("n") == 0, "empty").when(~inside, "range").when(~F.col("is_live") & (F.col("n") < F.col("median") * median_floor), "low").otherwise("ok")
    return counted.join(ranges, "competition", "left").join(medians, "competition", "left").select("competition", "season", "n", "median", verdict.alias("verdict"))


def balance(team_games: DataFrame, by: Sequence[str] = ("season", "team"), share: float = 0.15) -> DataFrame:
    """Home and away games of each team, and whether they differ by more than is allowed."""
    counted = team_games.groupBy(*by).agg(F.count_if(F.col("venue") == "H").alias("home"), F.count_if(F.col("venue") == "A").alias("away"))
    allowed = F.greatest(F.lit(2), F.bround((F.col("home") + F.col("away")) * F.lit(share), 0).cast("int"))
    return counted.select(*by, "home", "away", (F.abs(F.col("home") - F.col("away")) > allowed).alias("unbalanced"))


def status_faults(matches: DataFrame) -> DataFrame:
    """One row of counts from one pass: statuses and half-time scores that contradict the score."""
    scored = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    half = F.col("home_goals_ht").isNotNull() | F.col("away_goals_ht").isNotNull()
    more = (F.col("home_goals_ht") > F.col("home_goals")) | (F.col("away_goals_ht") > F.col("away_goals"))
    return matches.agg(
        F.count_if((F.col("status") == "FT") & ~scored).alias("finished_without_score"),
        F.count_if((F.col("status") == "NS") & scored).alias("open_with_score"),
        F.count_if(half & ~scored).alias("half_time_without_full_time"),
        F.count_if(scored & F.coalesce(more, F.lit(False))).alias("half_time_above_full_time"),
    )


def goal_range(matches: DataFrame, most: int = 20) -> DataFrame:
    bad = lambda c: F.count_if(F.col(c).isNotNull() & ~F.col(c).between(0, most))
    return matches.agg(bad("home_goals").alias("home"), bad("away_goals").alias("away"))


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, references: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """How many rows of each foreign key column have no row to point at; nulls point at nothing and are fine."""
    out = None
    for column, target, key in references:
        some = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
        lost = some.join(target.select(F.col(key).alias("_k")), "_k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(column).alias("reference"), "orphans")
        out = lost if out is None else out.union(lost)
    return out


def conservation(matches: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """What any set of results must keep, group by group: points, goals, games and each row's own sums."""
    games = matches.where("home_goals is not null and away_goals is not null")
    made = games.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("home_goals") == F.col("away_goals")).alias("draws"))
    sums = st.totals(games, by).groupBy(*by).agg(
        F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum("played").alias("played"), F.count_if(F.col("won") + F.col("drawn") + F.col("lost") != F.col("played")).alias("odd_games"), F.count_if(F.col("points") != 3 * F.col("won") + F.col("drawn")).alias("odd_points")
    )
    ok = (F.col("points") == 3 * F.col("n") - F.col("draws")) & (F.col("gf") == F.col("ga")) & (F.col("played") == 2 * F.col("n")) & (F.col("odd_games") == 0) & (F.col("odd_points") == 0)
    return made.join(sums, list(by)).select(*by, "n", "draws", "points", "gf", "ga", "played", ok.alias("kept"))


def against_snapshot(table: DataFrame, stored: DataFrame, by: Sequence[str] = ("season", "team")) -> DataFrame:
    """Stored table rows that a reconstruction does not confirm, with the reason; stored: by..., points, played."""
    ours = table.select(*by, F.col("points").alias("own_points"), F.col("played").alias("own_played"))
    reason = F.when(F.col("own_points").isNull(), "no matches").when(F.col("own_points") != F.col("points"), "points").when(F.col("played").isNotNull() & (F.col("own_played") != F.col("played")), "played")
    return stored.join(ours, list(by), "left").select(*by, reason.alias("reason")).where("reason is not null")


def same_names(teams: DataFrame, name: str = "name") -> DataFrame:
    """Normalised names that several rows share."""
    return repeated(teams.select(text.name_key(F.col(name)).alias("name_key")), ["name_key"])


def half_time_repairs(matches: DataFrame) -> DataFrame:
    """Matches whose half-time score is above the final one."""
    return matches.where("home_goals is not null and away_goals is not null and (home_goals_ht > home_goals or away_goals_ht > away_goals)")


def alias_report(raw: DataFrame, aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """Raw names that lead to no team: raw (raw_name, season), aliases (raw_name, canonical), teams (canonical).

    Each with the kind of fault, how often it occurs and the first four seasons that have it.
    """
    found = raw.join(aliases, "raw_name", "left").join(teams.select(F.col("canonical"), F.lit(True).alias("known")), "canonical", "left")
    kind = F.when(F.col("canonical").isNull(), "no alias").when(F.col("known").isNull(), "no team")
    return found.withColumn("kind", kind).where("kind is not null").groupBy("raw_name", "kind").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("season")), 1, 4), ",").alias("seasons"))


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and digest of a table whatever its order or partitioning: one partial aggregate, no sort."""
    cell = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))
    part = lambda i: F.conv(F.substring(cell, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"digest_{i}") for i in range(2)])


def freshness(log: DataFrame, now: Column) -> DataFrame:
    """Seconds since each source's last success, whole; log: source, last_success."""
    return log.select("source", F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / 1_000_000).alias("age_seconds"))


def calendar_differences(calendar: DataFrame, stored: DataFrame) -> DataFrame:
    """A calendar against what is stored: fixtures that exist, those on another date, and times to be confirmed."""
    key = ["season", "home_team", "away_team"]
    both = calendar.join(stored.select(*key, F.col("kickoff").alias("stored_kickoff")), key, "left")
    return both.groupBy("season").agg(
        F.count("stored_kickoff").alias("existing"), F.count_if(F.col("stored_kickoff").isNull()).alias("new"), F.count_if(F.to_date("stored_kickoff") != F.to_date("kickoff")).alias("other_date"), F.count_if(F.col("time_tbc")).alias("to_be_confirmed")
    )


def data_state(matches: DataFrame) -> DataFrame:
    """Matches, seasons and teams of each competition."""
    rows = matches.select("competition", "season", "match_id", F.explode(F.array("home_team", "away_team")).alias("team"))
    return rows.groupBy("competition").agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("season").alias("seasons"), F.countDistinct("team").alias("teams"))


def score_changes(stored: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Finished matches whose score a source gives differently: key..., old and new as structs."""
    score = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("home_goals", "away_goals", "home_goals_ht", "away_goals_ht")])
    new = source.select(*key, score("").alias("new"))
    old = stored.where("status = 'FT'").select(*key, score("").alias("old"))
    return old.join(new, list(key)).where(~F.col("old").eqNullSafe(F.col("new")))


def expected_tables(spark, names: Sequence[str]) -> DataFrame:
    """Tables of the session's catalogue against a list: missing and unexpected ones."""
    there = {t.name for t in spark.catalog.listTables()}
    rows = [(n, "missing") for n in names if n not in there] + [(n, "unexpected") for n in sorted(there - set(names))]
    return spark.createDataFrame(rows, "name string, state string")
