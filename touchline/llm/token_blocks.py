"""Token-id output as patched frame-of-reference blocks (operator 1).

A corpus is tokenised, ordered by ``doc_id`` and written as a table of
*segments*.  A segment is a binary value in this file format (little-endian)::

    magic "TLB1" | n_docs u32 | n_ids u64 | n_blocks u32
    ids of each document      u32[n_docs]
    block starts              u32[n_blocks + 1], offsets into what follows
    blocks, each of 1024 ids (the last may be shorter):
        minimum u32 | width u8 | zero u8 | exceptions u16
        (id - minimum) mod 2**width, packed at ``width`` bits
        exceptions: places u16[], (id - minimum) >> width u32[]

``width`` fits the value at a chosen percentile of the block, so a few large ids
do not widen the whole block; they are patched from the exception list.  Block
starts make any block readable alone.  Segments travel in Parquet, so writing
goes through Spark's committer and works on any file system Spark can write to.

Defined results: null text counts as empty text (just the end id); rows that
share a ``doc_id`` are separate documents, ordered by text; a null ``doc_id``
comes first; rows of one ``doc_id`` are in one task; an empty table gives no segments; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_letters, column, shared_dir, steps, whole_ids

BLOCK = 1024
MAGIC = b"TLB1"
HEAD = struct.Struct("<4sIQI")
BLOCK_HEAD = struct.Struct("<IBBH")
SEGMENTS = "part int, seq int, n_ids long, doc_ids array<long>, segment binary"
DOCUMENTS = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"
#: Parts of pieces whose ids a worker remembers; beyond that it starts afresh.
CACHE = 1_000_000
#: Beginnings of segments that may be broadcast: some 60 MB.  More are joined.
MAX_BROADCAST_SEGMENTS = 1_000_000
#: Text of one segment; a longer document is one of its own.
SEGMENT_BYTES = 8 << 20


# ---------------------------------------------------------------- the format
def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of uint32 values as rows of bytes, ``width`` bits each; 64 values are ``width`` 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype("<u8")
    words = np.zeros((width, lanes.shape[1]), dtype="<u8")
    for j, lane in enumerate(lanes):
        word, shift = divmod(j * width, 64)
        words[word] |= lane << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lane >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), -1)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    """What ``pack`` packed."""
    words = np.ascontiguousarray(rows.view("<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), dtype="<u4")
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | words[word + 1] << np.uint64(64 - shift)
        lanes[j] = lane & mask
    return np.ascontiguousarray(lanes.T).reshape(len(rows), -1)


def encode_segment(ids: np.ndarray, lengths: np.ndarray, percentile: float = 0.9) -> bytes:
    """``ids`` (uint32) of documents that have ``lengths`` ids each, as one segment."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, dtype="<u4")
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1, initial=0xFFFFFFFF)
    over = grid - low[:, None]
    k = min(BLOCK - 1, int(percentile * BLOCK))
    typical = np.partition(over, k, axis=1)[:, k] if n_blocks else low
    width = np.maximum(1, np.ceil(np.log2(typical.astype(np.float64) + 1))).astype(np.int64)
    high = (over.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype("<u4")
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out = pack(over[rows] & np.uint32((1 << w) - 1), w)
        for r, row in zip(rows.tolist(), out, strict=True):
            packed[r] = row[: -(-min(BLOCK, n - r * BLOCK) * w // 8)].tobytes()
    if n_blocks:
        high.reshape(-1)[n:] = 0
    row, place = np.nonzero(high)
    many = np.bincount(row, minlength=n_blocks)
    stop = np.cumsum(many)
    place, rest = place.astype("<u2"), high[row, place].astype("<u4")
    blocks, starts, at = [], np.zeros(n_blocks + 1, dtype="<u4"), 0
    for b in range(n_blocks):
        s = slice(stop[b] - many[b], stop[b])
        data = BLOCK_HEAD.pack(low[b], width[b], 0, many[b]) + packed[b] + place[s].tobytes() + rest[s].tobytes()
        blocks.append(data)
        at += len(data)
        starts[b + 1] = at
    return b"".join([HEAD.pack(MAGIC, len(lengths), n, n_blocks), lengths.astype("<u4").tobytes(), starts.tobytes(), *blocks])


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' lengths of a segment."""
    magic, n_docs, n, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size
    lengths = np.frombuffer(data, "<u4", n_docs, at)
    starts = np.frombuffer(data, "<u4", n_blocks + 1, at + 4 * n_docs).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at + 4 * n_docs + 4 * (n_blocks + 1))
    grid = np.zeros((n_blocks, BLOCK), dtype="<u4")
    heads = [BLOCK_HEAD.unpack_from(body, s) for s in starts[:-1].tolist()]
    low = np.array([h[0] for h in heads], dtype="<u4")
    width = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = np.zeros((len(rows), BLOCK * int(w) // 8), dtype=np.uint8)
        for i, b in enumerate(rows.tolist()):
            size = -(-min(BLOCK, n - b * BLOCK) * int(w) // 8)
            s = starts[b] + BLOCK_HEAD.size
            raw[i, :size] = body[s : s + size]
        grid[rows] = unpack(raw, int(w))
    for b, (_, w, _, many) in enumerate(heads):
        if many:
            e = starts[b + 1]
            rest = body[e - 4 * many : e].copy().view("<u4")
            place = body[e - 6 * many : e - 4 * many].copy().view("<u2")
            grid[b, place] |= rest << np.uint32(w)
    grid += low[:, None]
    return grid.reshape(-1)[:n], lengths


# ---------------------------------------------------------------- tokenising
#: Pieces of Latin-1 letters, then ASCII marks (no apostrophe), are cut between the two; the library cuts others.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}]*|[{MARKS}]*")


class _Ids:
    """Ids of white-space separated pieces of text, as rows of one flat array; row 0 is the end id.

    The vocabulary's rules never let a token cross ASCII white space, and drop
    it, so a text's ids are those of its pieces in turn.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.start = array("I", [self.end_id]), array("q", [0, 1])

    def ids_of(self, part: str) -> list[int]:
        """Ids of letters, or of marks: what the library's rules leave whole."""
        word = part.lower() if part.isascii() else part.lower().encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.library.model.tokenize(word)]

    def learn(self, parts: list[str]) -> None:
        row, flat, start, hard = self.row, self.flat, self.start, []
        for p in parts:
            if PLAIN.fullmatch(p) is None:
                hard.append(p)
                continue
            flat.extend(self.ids_of(p))
            row[p] = len(start) - 1
            start.append(len(flat))
        for low in range(0, len(hard), 20_000):
            some = hard[low : low + 20_000]
            for p, x in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                flat.extend(x.ids)
                row[p] = len(start) - 1
                start.append(len(flat))

    def rows(self, parts: pa.Array) -> np.ndarray:
        """The row of each of some letters, marks or whole pieces."""
        distinct = parts.dictionary_encode()
        parts = distinct.dictionary.to_numpy(zero_copy_only=False)
        found = list(map(self.row.get, parts))
        new = [p for p, r in zip(parts, found, strict=True) if r is None]
        if new:
            self.learn(new)
            found = list(map(self.row.__getitem__, parts))
        return np.array(found, dtype=np.int64)[distinct.indices.to_numpy()]


_IDS: dict[tuple[str, int], _Ids] = {}


def text_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text with the end id, and how many there are of each."""
    known = _IDS.get((path, end_id))
    if known is None:
        known = _IDS[path, end_id] = _Ids(path, end_id)
    if len(known.row) > CACHE:
        known.reset()
    pieces = pc.ascii_split_whitespace(texts.fill_null(""))
    last = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
    words = pieces.flatten().dictionary_encode()
    parts = pc.extract_regex(words.dictionary, f"^(?P<letters>[{LETTERS}]*)(?P<marks>[{MARKS}]*)$")  # null for other pieces
    letters = known.rows(pc.coalesce(pc.struct_field(parts, 0), words.dictionary))
    marks = known.rows(pc.coalesce(pc.struct_field(parts, 1), pa.scalar("")))
    row = np.stack([letters, marks], axis=1)[words.indices.to_numpy()].reshape(-1)
    row = np.insert(row, 2 * last, 0)
    flat, start = np.frombuffer(known.flat, np.uint32), np.frombuffer(known.start, np.int64)
    begin, many = start[row], start[row + 1] - start[row]
    upto = np.cumsum(many)
    ids = flat[np.repeat(begin - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
    ends = upto[2 * last + np.arange(len(last))]
    return ids.astype("<u4"), np.diff(ends, prepend=0)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, percentile: float) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, keys = batch.column(batch.schema.get_field_index("text")), column(batch, "doc_id")
        for a, b in steps(pc.binary_length(texts).to_pylist(), SEGMENT_BYTES):
            ids, lengths = text_ids(texts.slice(a, b - a), path, end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([keys[a:b]], pa.list_(pa.int64())), pa.array([encode_segment(ids, lengths, percentile)], pa.binary())],
                names=["part", "seq", "n_ids", "doc_ids", "segment"],
            )
            seq += 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, keys, before, data = (column(batch, c) for c in ("part", "doc_ids", "before", "segment"))
        for p, k, start, segment in zip(part, keys, before, data, strict=True):
            ids, lengths = decode_segment(segment)
            stop = np.cumsum(lengths, dtype=np.int64)
            begin = stop - lengths
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * len(k), pa.int32()), pa.array(k, pa.int64()), pa.array(begin + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


# ---------------------------------------------------------------- operators
def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, percentile: float = 0.9, partitions: int | None = None) -> None:
    """Tokenise ``docs`` (doc_id, text) and write their segments under ``path``.

    One range shuffle orders the documents; each task then streams its range.
    ``partitions`` (default: the session's shuffle partitions) bounds a task's share.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(whole_ids(docs).alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id, percentile=percentile), SEGMENTS).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """What the files under ``path`` hold: doc_id, start, n_tokens and the crc of each document's ids.

    ``start`` counts all ids before the document.  Per-segment totals, not ids,
    are summed over the whole table: one row a segment, then one a part.  Segments are
    read where they lie, unless there are too many to broadcast their beginnings.
    """
    segments = spark.read.parquet(path)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset"))
    begins = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(totals, "part")
    begins = begins.select("part", "seq", (F.col("inner") + F.col("offset")).alias("before"))
    # a row a segment of some 8 MB, so 100 TB of ids have some 12 million of them
    small = begins.count() <= MAX_BROADCAST_SEGMENTS
    placed = segments.join(F.broadcast(begins) if small else begins, ["part", "seq"])
    return placed.select("part", "doc_ids", "before", "segment").mapInArrow(_read, DOCUMENTS).select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, percentile: float = 0.9, path: str | None = None) -> DataFrame:
    """Write the blocks, then give the documents back from the files."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer, end_id, percentile)
    return read_token_blocks(spark, path)
