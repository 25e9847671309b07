"""Shared plumbing: shared-folder tables and vectorised word hashing.

The hashing helpers are plain numpy over one Arrow batch.  They never see more
than ``CHUNK_BYTES`` of text at once, so a task's memory does not depend on how
many rows it reads.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Text handled in one vectorised step.  Longer documents are steps of their own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MASK = (1 << 64) - 1
#: An odd multiplier and its inverse modulo 2**64, for rolling window hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BASE2 = 0xC2B2AE3D27D4EB4F
BASE2_INV = pow(BASE2, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is set, a fresh temporary one on a local master and an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage; the table outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing reads any more."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def whole_ids(frame: DataFrame, name: str = "doc_id") -> Column:
    """The column ``name`` as a long, for operators whose tables and files hold ids as whole numbers.

    Any other type is refused before anything runs; operators that only pass ids on keep their type instead.
    """
    kind = frame.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"column {name} must hold whole numbers; it is {kind.simpleString()}. Number the rows first, and keep the other id as a column of its own")
    return F.col(name).cast("long")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs begun inside: at most ``rows`` rows, which are large ones, are read and sent to a worker at once."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(rows))
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element-wise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_WIDE = 64
_TABLE = mix64(np.arange(_WIDE * 256, dtype=np.uint64) + U64(0x51ED270B))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes outside the inclusive ``ranges``: the bytes a word is made of."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``; all their separators are single bytes in UTF-8.
NOT_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself, or one from 256 on in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b if b in kept else 256 + rest.index(b)) for b in range(256)}


class Words:
    """Words of several texts: ``hash`` of each, and ``first[i]:first[i+1]`` those of text i.

    A word is a run of bytes of one class of ``word_byte``; class 0 parts words.
    """

    __slots__ = ("data", "first", "hash", "start", "stop")

    def __init__(self, texts: list[bytes | None], word_byte: np.ndarray, lower: bool):
        data = b" ".join(t or b"" for t in texts)
        self.data = data.lower() if lower else data
        raw = np.frombuffer(self.data, dtype=np.uint8)
        kind = word_byte.astype(np.uint8)[raw]
        inside = kind > 0
        change = np.diff(kind, prepend=0, append=0) != 0
        self.start, self.stop = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside) + 1
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts], out=begin[1:])
        self.first = np.searchsorted(self.start, begin)
        size = self.stop - self.start
        if not len(size):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        at = np.zeros(len(size), dtype=np.int64)
        np.cumsum(size[:-1], out=at[1:])
        letters = raw[inside].astype(np.int64)
        place = np.arange(len(letters), dtype=np.int64) - np.repeat(at, size)
        value = _TABLE[((place & (_WIDE - 1)) << 8) | letters]
        if size.max() > _WIDE:
            far = place >= _WIDE
            value[far] = mix64(((place[far] << 8) | letters[far]).astype(np.uint64))
        self.hash = mix64(np.add.reduceat(value, at) + size.astype(np.uint64) * U64(BASE2))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def windows(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values of ``h``; empty if there are fewer."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, n), powers(pow(base, -1, 1 << 64), n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def least_of_each(x: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` consecutive values, the place of the smallest; of equal ones the last."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, place = x[:n].copy(), np.arange(n)
    for j in range(1, w):
        here = x[j : j + n] <= least
        np.copyto(least, x[j : j + n], where=here)
        place[here] = np.flatnonzero(here) + j
    return place


def steps(sizes: list[bytes | int | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, given as they are or by their sizes, of at most ``limit`` bytes each, or of one text."""
    low = size = 0
    for i, t in enumerate(sizes):
        n = t if isinstance(t, int) else len(t or b"")
        if i > low and size + n > limit:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(sizes):
        yield low, len(sizes)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8, without a round trip through ``str``."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as int64, the type Spark has."""
    return x.view(np.int64)
