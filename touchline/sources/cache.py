"""Scans that are kept for a session and seen anew when their files change."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class ScanCache:
    """Results of scans, kept by their plan and the names, sizes and times of the files they read.

    At most ``most`` are kept, and those least recently asked for go first; they lie in executors' memory
    and, beyond it, on their disks, so what is lost with an executor is read again.
    """

    def __init__(self, spark: SparkSession, most: int = 8):
        self.spark, self.most = spark, most
        self.held: OrderedDict[tuple, DataFrame] = OrderedDict()

    def fingerprint(self, frame: DataFrame) -> tuple:
        """The plan and the state of its files, as any file system Spark knows tells it; nothing is read."""
        path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsparkSession.sessionState().newHadoopConf()
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()  # of the plan as it was written: a kept scan has no files any more
        names = set()
        for i in range(leaves.size()):
            if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
                names |= set(leaves.apply(i).relation().location().inputFiles())
        files = []
        for name in sorted(names):
            where = path(name)
            status = where.getFileSystem(conf).getFileStatus(where)
            files.append((name, status.getLen(), status.getModificationTime()))
        return frame.semanticHash(), tuple(files)

    def get(self, scan: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        """What ``scan`` gives, kept from an earlier call with the same plan and unchanged files unless ``refresh`` is set."""
        frame = scan()  # a plan lists its files when it is made
        key = self.fingerprint(frame)
        if refresh and key in self.held:
            self.held.pop(key).unpersist()
        for old in [k for k in self.held if k[0] == key[0] and k[1] != key[1]]:
            self.held.pop(old).unpersist()  # of files that have changed
        if key not in self.held:
            self.held[key] = frame.persist(StorageLevel.MEMORY_AND_DISK)
            while len(self.held) > self.most:
                self.held.popitem(last=False)[1].unpersist()
        self.held.move_to_end(key)
        return self.held[key]

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()
