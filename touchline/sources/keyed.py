"""A keyed table that changes by appended deltas and is merged when it is read.

A commit is one folder of whole rows, ``c<number>-<tag>``, written by Spark and made part of the table by
creating one small file, ``log/<number>``, which holds the folder's name.  Creating a file that must not
exist yet is the one step that two writers cannot both take, so numbers are given out once; a writer that
comes second reads what the first has done and tries again.  A folder without its log file, which is what
a killed writer leaves behind, is no part of the table and in nobody's way.  A commit may carry a name
(a stream's batch); a name that is in the log already is not committed again.

Reading takes, of each key, the row of the last commit that has one.  What is written follows the change,
not the table; ``compact`` writes one commit that stands for all before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times that a writer tries again after another one.
TRIES = 20


class KeyedTable:
    """The table under ``path``, one row a ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ------------------------------------------------------------ the log
    def _numbers(self) -> list[str]:
        """Names of the log's files, which are numbers, in order; one that is empty is of a writer that was killed."""
        where = self._path(f"{self.path}/log")
        if not self._fs.exists(where):
            return []
        return sorted(n for s in self._fs.listStatus(where) if (n := s.getPath().getName()).isdigit())

    def log(self) -> list[dict]:
        """Commits in order: number, folder, name, whole (does it stand for all before it) and schema."""
        names = self._numbers()
        rows = self.spark.read.text([f"{self.path}/log/{n}" for n in names]).collect() if names else []  # a line a commit
        return sorted((json.loads(r.value) for r in rows if r.value), key=lambda x: x["number"])

    def _enter(self, entry: dict) -> bool:
        """Create the log file of a commit; false if another writer has that number."""
        place = self._path(f"{self.path}/log/{entry['number']:012d}")
        try:
            out = self._fs.create(place, False)  # not over a file that is there
        except Py4JJavaError as e:
            if self._fs.exists(place):
                return False
            raise RuntimeError(f"the log of {self.path} cannot be written") from e
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode() + b"\n"))
        out.close()
        return True

    # ------------------------------------------------------------ writing
    def commit(self, change: Callable[[DataFrame | None], DataFrame], name: str | None = None, whole: bool = False) -> int | None:
        """Add the rows that ``change`` makes of the table as it is (None: there is none); the commit's number.

        If another writer comes first, ``change`` is asked again, about the table with that one's rows.
        None, if ``name`` has been committed already.
        """
        for _ in range(TRIES):
            taken, log = self._numbers(), self.log()
            if name is not None and any(x["name"] == name for x in log):
                return None
            rows = change(self._merged(log) if log else None)
            number = int(taken[-1]) + 1 if taken else 1
            folder = f"c{number:012d}-{uuid.uuid4().hex[:12]}"
            rows.write.parquet(f"{self.path}/{folder}")
            if self._enter({"number": number, "folder": folder, "name": name, "whole": whole or not log, "schema": rows.schema.json()}):
                return number
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        raise RuntimeError(f"{self.path}: {TRIES} other writers came first")

    def compact(self) -> int | None:
        """One commit that stands for all before it, whose folders readers that have begun may still need."""
        return self.commit(lambda table: table, whole=True) if len(self._live(self.log())) > 1 else None

    def vacuum(self) -> list[str]:
        """Delete the folders that the table no longer needs, also those that a killed writer left; for when nobody writes or reads."""
        kept = {x["folder"] for x in self._live(self.log())} | {"log"}
        gone = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName() not in kept)
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return gone

    # ------------------------------------------------------------ reading
    @staticmethod
    def _live(log: list[dict]) -> list[dict]:
        first = max((i for i, x in enumerate(log) if x["whole"]), default=0)
        return log[first:]

    def _merged(self, log: list[dict]) -> DataFrame:
        live = self._live(log)
        schema = StructType.fromJson(json.loads(live[-1]["schema"]))
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{x['folder']}") for x in live]
        if len(parts) == 1:
            return parts[0]
        every = None
        for x, part in zip(live, parts, strict=True):
            part = part.withColumn("_commit", F.lit(x["number"]))
            every = part if every is None else every.unionByName(part)
        rest = [c for c in schema.fieldNames() if c not in self.key]
        last = every.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_commit").alias("_row"))
        return last.select(*[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in schema.fieldNames()])

    def read(self, number: int | None = None) -> DataFrame:
        """The table now, or as it was after a commit whose folders are still there."""
        log = [x for x in self.log() if number is None or x["number"] <= number]
        if not log:
            raise FileNotFoundError(self.path)
        return self._merged(log)
