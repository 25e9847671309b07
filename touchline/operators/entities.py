"""Team names and merged duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Canonical names that a lookup may hold in each task; more are refused.
MAX_CANONICAL = 10_000


def in_order(name: str) -> str:
    """A name in small letters with its words sorted."""
    return " ".join(sorted(name.lower().split()))


def common_part(a: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of which ``places`` has a bit mask for each letter."""
    rest = (1 << size) - 1
    for letter in a:
        here = rest & places.get(letter, 0)
        rest = ((rest + here) | (rest - here)) & ((1 << size) - 1)
    return size - rest.bit_count()


class Registry:
    """Canonical names, and the likest of them to a name: 200 times the common part of both, words sorted, over their lengths."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.forms = [in_order(n) for n in self.names]
        self.letters = np.stack([self.count(f) for f in self.forms]) if names else np.zeros((0, 64), dtype=np.int64)
        self.sizes = self.letters.sum(1)

    @staticmethod
    def count(form: str) -> np.ndarray:
        return np.bincount(np.array([ord(c) % 64 for c in form], dtype=np.int64), minlength=64)

    def likest(self, name: str, cut: float) -> str | None:
        """The likest name at ``cut`` or above, the first of equal ones; letters in common bound how alike two can be."""
        form = in_order(name)
        both = np.maximum(self.sizes + len(form), 1)
        most = 200.0 * np.minimum(self.letters, self.count(form)).sum(1) / both
        places: dict[str, int] = {}
        for i, letter in enumerate(form):
            places[letter] = places.get(letter, 0) | 1 << i
        best, found = cut, None
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] < best:
                break
            score = 200.0 * common_part(self.forms[i], places, len(form)) / both[i]
            if score > best or (score == best and (found is None or i < found)):
                best, found = score, i
        return None if found is None else self.names[found]


def propose_names(raw: DataFrame, canonical: DataFrame, cut: float = 75.0, overrides: dict[str, str] | None = None) -> DataFrame:
    """raw_name with its proposed canonical name and how it was found: override, exact, fuzzy or none.

    ``canonical`` is a registry of bounded size, checked, that each task gets; distinct raw
    names stay distributed, and most of the registry is ruled out for each by its letters.
    """
    names = [r[0] for r in canonical.where(F.col(canonical.columns[0]).isNotNull()).distinct().limit(MAX_CANONICAL + 1).collect()]
    if len(names) > MAX_CANONICAL:
        raise ValueError(f"more than {MAX_CANONICAL} canonical names")
    held = raw.sparkSession.sparkContext.broadcast((Registry(names), frozenset(names), dict(overrides or {})))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry, known, fixed = held.value
        for batch in batches:
            rows = []
            for name in batch.raw_name:
                if name in fixed:
                    rows.append((name, fixed[name], "override"))
                elif name in known:
                    rows.append((name, name, "exact"))
                else:
                    found = registry.likest(name, cut) if name is not None else None
                    rows.append((name, found, "none" if found is None else "fuzzy"))
            yield pd.DataFrame(rows, columns=["raw_name", "canonical", "how"])

    return raw.select(F.col(raw.columns[0]).alias("raw_name")).distinct().mapInPandas(match, "raw_name string, canonical string, how string")


def survivors(teams: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """loser_id and winner_id of teams that share a normalised name: most matches, then a name of ``preferred``, then the lowest id, survives.

    teams: team_id, name, matches; preferred: name, one row each.
    """
    by = Window.partitionBy("name_key").orderBy(F.col("matches").desc(), F.col("listed").desc(), "team_id")
    listed = F.lit(False) if preferred is None else F.col("_listed").isNotNull()
    known = teams if preferred is None else teams.join(preferred.select("name").distinct().withColumn("_listed", F.lit(True)), "name", "left")
    keyed = known.select("team_id", "matches", listed.alias("listed"), text.name_key(F.col("name")).alias("name_key"))
    ranked = keyed.select("team_id", F.first("team_id").over(by).alias("winner_id"))
    return ranked.where("team_id <> winner_id").select(F.col("team_id").alias("loser_id"), "winner_id")


def merge_teams(matches: DataFrame, losers: DataFrame) -> DataFrame:
    """Matches with losers replaced by winners: no self-play, and one row a fixture, a scored one if there is any.

    Among equals the survivor's own row, then the lowest match_id, stays.
    """
    home, away = (losers.select(F.col("loser_id").alias(f"{s}_team"), F.col("winner_id").alias(f"_{s}")) for s in ("home", "away"))
    moved = matches.join(home, "home_team", "left").join(away, "away_team", "left")
    own = F.col("_home").isNull() & F.col("_away").isNull()
    moved = moved.withColumns({"_own": own, "home_team": F.coalesce("_home", "home_team"), "away_team": F.coalesce("_away", "away_team")}).where("home_team <> away_team")
    place = F.row_number().over(Window.partitionBy("season", "home_team", "away_team").orderBy(F.col("home_goals").isNull(), ~F.col("_own"), "match_id"))
    return moved.withColumn("_place", place).where("_place = 1").select(*matches.columns)


def repoint(rows: DataFrame, losers: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Rows that refer to losers moved to winners; of rows that then share a (null-safe) key one stays, the winner's own first."""
    moved = rows.join(losers.select(F.col("loser_id").alias(column), "winner_id"), column, "left")
    moved = moved.withColumns({"_moved": F.col("winner_id").isNotNull(), column: F.coalesce("winner_id", column)})
    place = F.row_number().over(Window.partitionBy(column, *key).orderBy("_moved", *[c for c in rows.columns if c not in (column, *key)]))
    return moved.withColumn("_place", place).where("_place = 1").select(*rows.columns)


def new_teams(raw: DataFrame, teams: DataFrame, start: int) -> DataFrame:
    """Names that no team has yet, with ids from ``start`` on in order of name.

    raw: name; teams: name.  Ids are dense: names that begin alike are a part, which their own
    letters decide and no partitioning does; parts are counted, and names are ranked inside theirs.
    """
    names = raw.select("name").where("name is not null").distinct().join(teams.select("name"), "name", "left_anti")
    parts = names.select("name", F.substring("name", 1, 3).alias("p"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("name"))
    counts = parts.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a part
    return parts.withColumn("i", inside).join(before, "p").select((F.lit(start) + F.col("before") + F.col("i") - 1).alias("team_id"), "name")


def merged_aliases(*by_priority: DataFrame) -> DataFrame:
    """raw_name and canonical of several registries; the first one that has a name wins."""
    every = None
    for i, a in enumerate(by_priority):
        part = a.select("raw_name", F.struct(F.lit(i).alias("place"), "canonical").alias("x"))
        every = part if every is None else every.union(part)
    return every.groupBy("raw_name").agg(F.min("x").alias("x")).select("raw_name", "x.canonical")


def renamed(aliases: DataFrame, renames: DataFrame, overrides: DataFrame) -> DataFrame:
    """Alias targets renamed (old, new), after which single aliases (raw_name, canonical) are overridden."""
    moved = aliases.join(renames.select(F.col("old").alias("canonical"), "new"), "canonical", "left").select("raw_name", F.coalesce("new", "canonical").alias("canonical"))
    fixed = overrides.select("raw_name", F.col("canonical").alias("fixed"))
    return moved.join(fixed, "raw_name", "left").select("raw_name", F.coalesce("fixed", "canonical").alias("canonical"))
