"""Incremental refresh: result files that arrive become commits of a keyed table of fixtures.

The late-correction guard is the batch one: a file that would rewrite the score of a
finished match stops the stream before anything is written, and so do files of one batch that
give a fixture two scores.  Where score changes are allowed, one whole row counts for each
fixture: one with a score before one without, then that of the file written last, of the greater
file name, of the greater values.  A commit holds the fixtures that a batch changes and carries the
batch's name, so a batch that is replayed after a crash is not committed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import numbers
from ..operators import mutations
from ..sources.keyed import KeyedTable

RESULTS = "season string, home_team string, away_team string, home_goals string, away_goals string, home_goals_ht string, away_goals_ht string"
KEY = ["season", "home_team", "away_team"]


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    raw = spark.readStream.schema(RESULTS).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)
    return raw.select(*[numbers.strict_int(F.col(c)).alias(c) for c in raw.columns], F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"))


def one_a_fixture(batch: DataFrame, allow_score_changes: bool) -> DataFrame:
    """The row of each fixture of ``batch`` that counts; fails where scores differ, unless that is allowed."""
    cells = [c for c in batch.columns if c not in (*KEY, "written", "file")]
    scored = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    score = F.when(scored, F.struct("home_goals", "away_goals"))
    best = batch.groupBy(*KEY).agg(F.max(F.struct(scored.alias("scored"), "written", "file", *cells)).alias("x"), F.min(score).alias("least"), F.max(score).alias("most"))
    differ = F.coalesce(F.col("least") != F.col("most"), F.lit(False)) & F.lit(not allow_score_changes)
    said = F.concat_ws(" ", F.lit("two scores of one fixture in a batch:"), *[F.col(c).cast("string") for c in KEY])
    checked = F.when(differ, F.raise_error(said).cast("int")).otherwise(F.col("x.home_goals"))
    return best.select(*KEY, checked.alias("home_goals"), *[F.col(f"x.{c}").alias(c) for c in cells if c != "home_goals"])


def refresh(spark: SparkSession, folder: str, table: str, checkpoint: str, allow_score_changes: bool = False) -> StreamingQuery:
    """Take all files that have arrived, in batches, into the keyed table under ``table``, and end."""
    fixtures = KeyedTable(spark, table, KEY)

    def apply(batch: DataFrame, number: int) -> None:
        one = one_a_fixture(batch, allow_score_changes).persist()  # read twice: to be checked and to be written
        try:
            fixtures.commit(lambda stored: mutations.changed_results(stored, one, KEY, allow_score_changes), f"{checkpoint}#{number}")
        finally:
            one.unpersist()

    return arriving(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
