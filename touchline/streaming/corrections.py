"""What is known of each fixture as files arrive, late and corrected ones too, kept as state.

A fixture's state is the best row that any file has said of it: one with a score before one without,
then the one written last, of the greater file name, of the greater values.  That order is total, so the
same files give the same state in whatever order and batches they arrive.  Each change is passed on as
an event with the score before it; a fixture that has no score ``grace`` after its kick-off, by the
watermark of the files' times, is passed on once as overdue.  ``keep`` writes events to a keyed table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import numbers
from ..sources.keyed import KeyedTable

KEY = ["season", "home_team", "away_team"]
SAID = ["home_goals", "away_goals"]
RAW = "season string, home_team string, away_team string, kickoff timestamp, home_goals string, away_goals string"
EVENTS = "season int, home_team int, away_team int, kind string, home_goals int, away_goals int, was_home_goals int, was_away_goals int, written timestamp, file string, change int"
STATE = "scored boolean, written timestamp, file string, home_goals int, away_goals int, changes int"
#: The state store that keeps timers: a setting of the session, not of the query.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _whole(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


class Fixture(StatefulProcessor):
    """The best row so far of one fixture."""

    def __init__(self, grace: dt.timedelta):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        known = self.said.get() if self.said.exists() else None
        old = (known[0], known[1], known[2], *known[3:5]) if known else None
        best, changes, kickoff = old, known[5] if known else 0, None
        for batch in rows:
            for r in batch.itertuples(index=False):
                h, a = _whole(r.home_goals), _whole(r.away_goals)
                scored = h is not None and a is not None
                new = (scored, r.written.to_pydatetime(), r.file, h if scored else None, a if scored else None)
                if best is None or self.order(new) > self.order(best):
                    best = new
                kickoff = None if pd.isna(r.kickoff) else r.kickoff
        if old is None and not best[0] and kickoff is not None:
            self.handle.registerTimer(int((kickoff.to_pydatetime().replace(tzinfo=dt.timezone.utc) + self.grace).timestamp() * 1000))
        moved = old is None or best[3:] != old[3:]
        changes += moved
        if best != old:
            self.said.update((*best, changes))
        if moved:
            before = old[3:] if old else (None, None)
            kind = "fixture" if not best[0] else "correction" if old and old[0] else "score"
            yield self.event(key, kind, best, before, changes)

    @staticmethod
    def order(x: tuple) -> tuple:
        return (x[0], x[1], x[2], *(-1 if v is None else v for v in x[3:]))

    @staticmethod
    def event(key: tuple, kind: str, best: tuple, before: tuple, changes: int) -> pd.DataFrame:
        goals = [pd.array([v], dtype="Int32") for v in (*best[3:], *before)]
        cells = [[key[0]], [key[1]], [key[2]], [kind], *goals, [pd.Timestamp(best[1])], [best[2]], pd.array([changes], dtype="Int32")]
        return pd.DataFrame(dict(zip([c.split()[0] for c in EVENTS.split(", ")], cells, strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.said.get()
        if not known[0]:
            yield self.event(key, "overdue", (False, known[1], known[2], None, None), (None, None), known[5])

    def close(self) -> None:
        pass


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    raw = spark.readStream.schema(RAW).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)
    whole = [numbers.strict_int(F.col(c)).alias(c) for c in (*KEY, *SAID)]
    return raw.select(*whole, "kickoff", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"))


def events(rows: DataFrame, grace: dt.timedelta = dt.timedelta(days=2), late: str = "365 days") -> DataFrame:
    """Changes of fixtures, as a stream.  ``late`` is how far behind the newest file a file's time may be."""
    keyed = rows.withWatermark("written", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(Fixture(grace), EVENTS, "Append", "EventTime")


def keep(spark: SparkSession, folder: str, table: str, checkpoint: str, files_at_once: int = 100, grace: dt.timedelta = dt.timedelta(days=2), late: str = "365 days") -> StreamingQuery:
    """Take all files that have arrived into the keyed table under ``table``: of each fixture the last event's score, and whether it is overdue."""
    fixtures = KeyedTable(spark, table, KEY)

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*KEY).agg(F.max_by(F.struct("kind", "home_goals", "away_goals", "written", "file", "change"), F.struct("change", (F.col("kind") == "overdue"))).alias("x"))
        rows = last.select(*KEY, "x.home_goals", "x.away_goals", (F.col("x.kind") == "overdue").alias("overdue"), "x.change")
        fixtures.commit(lambda _: rows, f"{checkpoint}#{number}")

    return events(arriving(spark, folder, files_at_once), grace, late).writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
