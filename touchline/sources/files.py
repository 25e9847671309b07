"""Readers of result files, calendars, reference tables, alias lists and feed payloads.

All schemas are explicit; nothing is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text

RESULT_COLUMNS = ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HTHG", "HTAG", "HST", "AST")
CALENDAR = "matchday int, kickoff_utc string, home string, away string, time_tbc boolean"


def result_rows(spark: SparkSession, path: str, columns: Sequence[str] = RESULT_COLUMNS, encoding: str = "ISO-8859-1") -> DataFrame:
    """Rows of result CSV files as text, by header name; a byte-order mark goes, rows without any value too.

    Files may have more columns, in any order; those that a file lacks are null.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("inferSchema", False).csv(path)
    names = {c.lstrip("﻿").removeprefix("ï»¿").strip(): c for c in raw.columns}
    picked = [text.cleaned(F.col(f"`{names[c]}`")).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(*picked).na.drop("all")


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and lines of files of mixed encodings, each file decoded as what it is."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(F.split(text.decode(F.col("content")), r"\r?\n")).alias("line_number", "line")).where("line <> ''")


def results(rows: DataFrame) -> DataFrame:
    """Typed results: home, away, kickoff, goals, half-time goals, shots on target and status."""
    n = lambda c: numbers.lenient_int(F.col(c))
    played = n("FTHG").isNotNull() & n("FTAG").isNotNull()
    return rows.select(
        F.col("HomeTeam").alias("home"),
        F.col("AwayTeam").alias("away"),
        dates.kickoff(F.col("Date"), F.col("Time")).alias("kickoff"),
        *[n(c).alias(name) for c, name in zip(("FTHG", "FTAG", "HTHG", "HTAG", "HST", "AST"), ("home_goals", "away_goals", "home_goals_ht", "away_goals_ht", "home_sot", "away_sot"), strict=True)],
        F.when(played, "FT").otherwise("NS").alias("status"),
    )


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """A fixture list; a missing column, a bad value or a time without a zone fails."""
    header = [c.strip() for c in spark.read.text(path).head()[0].lstrip("﻿").split(",")]
    wanted = [f.split()[0] for f in CALENDAR.split(", ")]
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"the calendar lacks {missing}")
    kinds = dict(f.split() for f in CALENDAR.split(", "))
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
    rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
    return rows.select("matchday", dates.zoned(F.col("kickoff_utc")).alias("kickoff"), "home", "away", F.coalesce("time_tbc", F.lit(False)).alias("time_tbc"))


def reference_tables(spark: SparkSession, path: str) -> DataFrame:
    """Published tables from JSON: seasons are keys of an object, each with a list of rows."""
    row = "struct<position: int, team: string, played: int, won: int, drawn: int, lost: int, goals_for: int, goals_against: int, points: int>"
    raw = spark.read.option("multiLine", True).schema(f"seasons map<string, array<{row}>>").json(path)
    return raw.select(F.explode("seasons").alias("season", "rows")).select("season", F.explode("rows").alias("r")).select("season", "r.*")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """source, raw_name and canonical of a YAML registry (source: {raw: canonical}); a file of bounded size, read by Spark as one text."""
    import yaml

    whole = spark.read.text(path, wholetext=True).head()[0]
    held = yaml.safe_load(whole) or {}
    return spark.createDataFrame([(s, str(r), str(c)) for s, names in held.items() for r, c in (names or {}).items()], "source string, raw_name string, canonical string")


FIXTURE = "struct<fixture: struct<id: long, date: string, status: struct<short: string>>, league: struct<id: long, season: int, round: string>, teams: struct<home: struct<id: long, name: string>, away: struct<id: long, name: string>>, goals: struct<home: int, away: int>, score: struct<halftime: struct<home: int, away: int>>>"


def feed_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures out of landed feed payloads, one row each, with kept statuses and rounds as numbers."""
    raw = spark.read.option("multiLine", True).schema(f"response array<{FIXTURE}>").json(path)
    x = raw.select(F.explode("response").alias("x")).select("x.*")
    return x.select(
        F.col("fixture.id").alias("match_id"),
        F.col("league.season").alias("season"),
        text.last_number(F.col("league.round")).alias("matchday"),
        F.col("fixture.date").try_cast("timestamp").alias("kickoff"),
        numbers.status_of(F.col("fixture.status.short")).alias("status"),
        F.col("teams.home.name").alias("home"),
        F.col("teams.away.name").alias("away"),
        F.col("goals.home").alias("home_goals"),
        F.col("goals.away").alias("away_goals"),
        F.col("score.halftime.home").alias("home_goals_ht"),
        F.col("score.halftime.away").alias("away_goals_ht"),
    )


def feed_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of landed feed payloads, one row each; ``item`` is their type, and what it does not name is not read."""
    raw = spark.read.option("multiLine", True).schema(f"response array<{item}>").json(path)
    return raw.select(F.explode("response").alias("x")).select("x.*")


LEAGUE = "struct<league: struct<id: long, name: string, type: string>, country: struct<name: string>, seasons: array<struct<year: int, start: string, end: string, current: boolean>>>"
TEAM = "struct<team: struct<id: long, name: string, code: string, founded: int, logo: string>, venue: struct<name: string>>"
STANDING = "struct<league: struct<id: long, season: int, standings: array<array<struct<rank: int, team: struct<id: long>, points: int, form: string, all: struct<played: int, win: int, draw: int, lose: int, goals: struct<`for`: int, against: int>>>>>>>"
PLAYER = (
    "struct<player: struct<id: long, name: string, nationality: string, birth: struct<date: string>, position: string>, statistics: array<struct<team: struct<id: long>, league: struct<id: long, season: int>, "
    "games: struct<appearences: int, lineups: int, minutes: int, rating: string>, goals: struct<total: int, assists: int>, shots: struct<total: int, on: int>, passes: struct<total: int>, cards: struct<yellow: int, red: int>>>>"
)


def feed_leagues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Competitions (league_id, code, name, country, tier) and their seasons (league_id, start_year, start_date, end_date, is_current)."""
    x = feed_items(spark, path, LEAGUE)
    leagues = x.select(F.col("league.id").alias("league_id"), text.code_of(F.col("league.name")).alias("code"), F.col("league.name").alias("name"), F.coalesce("country.name", F.lit("Unknown")).alias("country"), F.when(F.col("league.type") == "League", 1).otherwise(2).alias("tier"))
    s = x.select(F.col("league.id").alias("league_id"), F.explode("seasons").alias("s")).where("s.year is not null")
    day = lambda c: F.col(f"s.{c}").try_cast("date")
    return leagues, s.select("league_id", F.col("s.year").alias("start_year"), day("start").alias("start_date"), day("end").alias("end_date"), F.coalesce("s.current", F.lit(False)).alias("is_current"))


def feed_teams(spark: SparkSession, path: str) -> DataFrame:
    x = feed_items(spark, path, TEAM)
    return x.select(F.col("team.id").alias("feed_id"), F.col("team.name").alias("canonical_name"), F.coalesce("team.code", F.lit("")).alias("short_name"), F.col("team.founded").alias("founded"), F.col("venue.name").alias("venue_name"), F.col("team.logo").alias("logo_url"))


def feed_standings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of published tables: league_id, start_year, feed_id and the table's columns; as_of_matchday is what the team has played."""
    x = feed_items(spark, path, STANDING)
    r = x.select(F.col("league.id").alias("league_id"), F.col("league.season").alias("start_year"), F.explode(F.flatten("league.standings")).alias("r"))
    whole = {"played": "played", "won": "win", "drawn": "draw", "lost": "lose", "goals_for": "goals.for", "goals_against": "goals.against"}
    return r.select("league_id", "start_year", F.col("r.team.id").alias("feed_id"), F.col("r.all.played").alias("as_of_matchday"), F.coalesce("r.rank", F.lit(0)).alias("position"), *[F.col(f"r.all.{c}").alias(n) for n, c in whole.items()], F.col("r.points").alias("points"), F.col("r.form").alias("form"))


def feed_players(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Players (player_id, name, ...), and their totals by team and season (player_id, feed_id, league_id, start_year, ...)."""
    x = feed_items(spark, path, PLAYER)
    players = x.select(F.col("player.id").alias("player_id"), F.coalesce("player.name", F.lit("Unknown")).alias("name"), F.col("player.nationality").alias("nationality"), F.col("player.birth.date").try_cast("date").alias("birth_date"), F.col("player.position").alias("position"))
    s = x.select(F.col("player.id").alias("player_id"), F.explode("statistics").alias("s"))
    totals = {
        "appearances": "games.appearences",
        "lineups": "games.lineups",
        "minutes": "games.minutes",
        "goals": "goals.total",
        "assists": "goals.assists",
        "shots": "shots.total",
        "shots_on_target": "shots.on",
        "passes": "passes.total",
        "yellows": "cards.yellow",
        "reds": "cards.red",
    }
    stats = s.select("player_id", F.col("s.team.id").alias("feed_id"), F.col("s.league.id").alias("league_id"), F.col("s.league.season").alias("start_year"), *[F.col(f"s.{c}").alias(n) for n, c in totals.items()], F.col("s.games.rating").try_cast("double").alias("rating"))
    return players, stats
