"""Entities of a feed merged into stored tables: competitions, seasons, teams with aliases, standings, players.

Each gives the table after the merge.  What a feed may change of a stored row differs by entity, so
``merged`` takes the cells that change and those that change only to a known value; all other
cells of a stored row stay, and rows of new keys come in whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import mutations

FEED = "api-football"


def merged(stored: DataFrame, new: DataFrame, key: Sequence[str], changed: Sequence[str] = (), known: Sequence[str] = ()) -> DataFrame:
    """``stored`` with ``new``: cells ``changed`` are the new ones, ``known`` too unless null; of new rows with one key the last by all cells counts."""
    columns = stored.columns
    rest = [c for c in columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_new"))
    both = stored.select(*key, F.struct(*rest).alias("_old")).join(one, list(key), "full")
    found = F.col("_new").isNotNull()

    def cell(c: str) -> Column:
        old, fresh = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        kept = F.when(found, fresh).otherwise(old) if c in changed else F.coalesce(fresh, old) if c in known else old
        return F.when(F.col("_old").isNull(), fresh).otherwise(kept).alias(c)

    return both.select(*[F.col(c) if c in key else cell(c) for c in columns])


def competitions(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """By league_id: code, name and country follow the feed, the tier stays."""
    return merged(stored, feed, ["league_id"], changed=["code", "name", "country"])


def seasons(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """By (league_id, start_year): whether it is current follows the feed, dates where it has them; new ones get their label, and the year's ends for dates that are missing."""
    year = F.col("start_year")
    whole = feed.withColumns({"label": text.season_label(year)})
    merge = merged(stored, whole.select(*stored.columns), ["league_id", "start_year"], changed=["is_current"], known=["start_date", "end_date"])
    return merge.withColumns({"start_date": F.coalesce("start_date", F.make_date(year, F.lit(1), F.lit(1))), "end_date": F.coalesce("end_date", F.make_date(year, F.lit(12), F.lit(31)))})


def teams(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """By feed_id: venue and logo follow the feed where it has them; all else of a stored team stays."""
    return merged(stored, feed.select(*stored.columns), ["feed_id"], known=["venue_name", "logo_url"])


def team_aliases(stored: DataFrame, feed: DataFrame, source: str = FEED) -> DataFrame:
    """Aliases (source, raw_name, feed_id) with the feed's own names of its teams; a name that has one keeps it."""
    names = feed.select(F.lit(source).alias("source"), F.col("canonical_name").alias("raw_name"), "feed_id").where("raw_name is not null")
    return stored.unionByName(mutations.insert_absent(stored, names, ["source", "raw_name"]))


def standings(stored: DataFrame, feed: DataFrame, known_teams: DataFrame, at: Column) -> DataFrame:
    """The snapshot log with the feed's rows of known teams appended."""
    rows = feed.join(known_teams.select("feed_id"), "feed_id", "left_semi")
    return stored.unionByName(mutations.snapshot(rows, at).select(*stored.columns))


def players(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """Stored players stay as they are; new ones come in."""
    return stored.unionByName(mutations.insert_absent(stored, feed.where("player_id is not null").select(*stored.columns), ["player_id"]))


def player_totals(stored: DataFrame, feed: DataFrame, known_teams: DataFrame) -> DataFrame:
    """By (player_id, feed_id, league_id, start_year): all totals follow the feed, for known teams."""
    key = ["player_id", "feed_id", "league_id", "start_year"]
    rows = feed.join(known_teams.select("feed_id"), "feed_id", "left_semi").select(*stored.columns)
    return merged(stored, rows, key, changed=[c for c in stored.columns if c not in key])
