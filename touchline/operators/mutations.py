"""Changes to tables as new tables: upserts, guarded and partial updates, snapshots, registries.

Each gives the state after the change as a DataFrame; ``sources.sinks`` writes it.  All
are joins or partial aggregates on the key, so running one twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows with those of ``new`` in place of theirs; of new rows with one key the last by all columns counts."""
    columns = stored.columns
    rest = [c for c in columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_new")) if rest else new.select(*key).distinct().withColumn("_new", F.struct(F.lit(1)))
    both = stored.select(*key, F.struct(*[F.col(c) for c in rest]).alias("_old")).join(one, list(key), "full")
    return both.select(*key, F.coalesce("_new", "_old").alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in columns])


def insert_absent(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that were inserted: keys not stored yet, one row each."""
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return one.join(stored.select(*key), list(key), "left_anti").select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in new.columns])


def fill_cells(stored: DataFrame, new: DataFrame, key: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Stored rows whose cells take known, different values of ``new``; changed_cells counts them."""
    values = new.select(*key, *[F.col(c).alias(f"_{c}") for c in cells])
    both = stored.join(values, list(key), "left")
    differs = {c: F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in cells}
    changed = sum((d.cast("int") for d in differs.values()), F.lit(0))
    return both.select(*[F.when(differs[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in differs else F.col(c) for c in stored.columns], changed.alias("changed_cells"))


GOALS = ["home_goals", "away_goals", "home_goals_ht", "away_goals_ht"]


def _checked(stored: DataFrame, results: DataFrame, key: Sequence[str], allow_score_changes: bool) -> DataFrame:
    """Results that have a score, as new columns, after the check that none rewrites a finished match's."""
    from .validation import score_changes

    if not allow_score_changes and (n := score_changes(stored, results, key).count()):
        raise ValueError(f"{n} finished matches would get another score")
    return results.where("home_goals is not null and away_goals is not null").select(*key, *[F.col(g).alias(f"_{g}") for g in GOALS])


def apply_results(stored: DataFrame, results: DataFrame, key: Sequence[str], allow_score_changes: bool = False) -> DataFrame:
    """Fixtures with new results; refuses, before anything is written, to rewrite the score of a finished match."""
    both = stored.join(_checked(stored, results, key, allow_score_changes), list(key), "left")
    known = F.col("_home_goals").isNotNull()
    out = {g: F.when(known, F.col(f"_{g}")).otherwise(F.col(g)) for g in GOALS} | {"status": F.when(known, "FT").otherwise(F.col("status"))}
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns])


def changed_results(stored: DataFrame, results: DataFrame, key: Sequence[str], allow_score_changes: bool = False) -> DataFrame:
    """Only the fixtures that ``apply_results`` changes, as they are after it."""
    both = stored.join(_checked(stored, results, key, allow_score_changes), list(key))
    same = F.col("status").eqNullSafe("FT")
    for g in GOALS:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = {g: F.col(f"_{g}") for g in GOALS} | {"status": F.lit("FT")}
    return both.where(~same).select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns])


def snapshot(table: DataFrame, at: Column) -> DataFrame:
    """A league table as rows of a snapshot log."""
    return table.withColumn("computed_at", at)


def latest_wins(log: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first under ``order``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("_place", place).where("_place = 1").drop("_place")


def promote(versions: DataFrame, name: str, version: str) -> DataFrame:
    """A registry (name, version, is_production) in which one version of a model is the production one and its siblings are not."""
    return versions.withColumn("is_production", F.when(F.col("name") == name, F.col("version") == version).otherwise(F.col("is_production")))


def freshness(log: DataFrame) -> DataFrame:
    """Attempts (source, at, error) as one row a source: the last success, and the error since, if any."""
    ok = F.col("error").isNull()
    out = log.groupBy("source").agg(F.max(F.when(ok, F.col("at"))).alias("last_success"), F.max_by("error", "at").alias("error"), F.max("at").alias("last_attempt"))
    return out


def keep_known(stored: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows that the source still has."""
    return stored.join(source.select(*key), list(key), "left_semi")


def repair(stored: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str], wrong: Column) -> tuple[DataFrame, DataFrame]:
    """The repaired table, and the rows as they were before."""
    values = source.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = stored.withColumn("_wrong", F.coalesce(wrong, F.lit(False))).join(values, list(key), "left")
    fixed = both.select(*[F.when(F.col("_wrong"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])
    return fixed, both.where("_wrong").select(*stored.columns)
