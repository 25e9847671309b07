"""Phrase collocations from vertical positional inverted lists (operator 11).

A task turns its documents into *blocks* of one language: the words of a block, each with the list of
positions where it stands, ascending.  Positions go on over documents with a gap between pieces, so
two words are neighbours exactly when their positions are.  A block is one row, and is written when its
task has read ``BLOCK`` words; a piece longer than that is cut, and what goes on begins with the last
words of what was before, so no phrase is lost at a cut: it counts where its last word is new.

Phrases grow level by level.  The list of a phrase is merge-joined by position with the postings of
the words that follow it: where it ends at p and a word stands at p + 1, the longer phrase has an
occurrence.  The length of a list is the exact frequency in the block, and one ``groupBy`` of
(language, phrase) adds blocks up.  Blocks are never joined with each other, as no occurrence goes
over a block's end, so nothing but lengths of lists is shuffled.

What is not frequent is never extended, and its list's length is not sent as a phrase.  Level by level the
lengths are first tallied by buckets of hashes, a byte or two each, and a bitmap tells the buckets that come
to the least frequency.  A list is extended only if the bucket of its phrase, and that of the phrase without
the first word of what comes out, are common; in the end the phrases of all lengths in common buckets are
counted by themselves, in one pass.  A task merges their counts and sends them packed: in order, as small
differences of numbers of words, by their first two words; what comes together is merged before phrases are
texts again, and a ``groupBy`` of those gives the sums.  A bitmap has ``BITMAP`` bits at most and is broadcast
once, compressed, so what is broadcast is bounded whatever the corpus; on a corpus far larger than that they rule out less.  A false positive costs an idle
list, never a result: what is frequent is decided by exact sums of phrases themselves.

Scores, the domination of phrases by longer ones and ranks are DataFrame operations with decimals of
38 digits.  A language's best are found in ``SALTS`` shares first, so no task ranks all its phrases.

Defined results: null texts count as empty; null languages are ``und``; texts without words give
nothing; repeated rows count as often as they stand there; ties are broken as stated, by bytes of the
phrase last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, U64, column, discard, materialize, mix64, small_batches, text_bytes

#: Words of a block.
BLOCK = 1 << 18
#: Ranges of buckets, as a power of two; each is tallied in one task.
RANGES = 8
#: Phrases of which a task merges the tallies before it sends them.
TALLIED = 1 << 22
#: Phrases of which a task merges the counts before it sends them.
MERGED = 1 << 21
#: Least and most parts that packed phrases are dealt to.
PARTITIONS = 24, 1024
#: Phrases that leave a task at once.
SENT = 1 << 15
#: Bits of the largest bitmap: 16 MB.
BITMAP = 1 << 27
#: Pieces of more bytes are turned into words bit by bit.
STEP = 4 << 20
SALTS = 64
#: Marks at which a text is parted: fixed values.
MARKS = b".,;:!?\n\x0b\x0c\r"
PARTS = bytes.maketrans(MARKS, b"\n" * len(MARKS))
WORD = re.compile(rb"[^\x20\x09]+")


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# ---------------------------------------------------------------- small numbers
def _zipped(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) if x else b""


def _unzipped(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) if x else b""


def _planes(x: np.ndarray) -> bytes:
    """Small whole numbers byte by byte, all first bytes first: mostly zeros, which compression makes small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(x: bytes) -> np.ndarray:
    """What ``_planes`` was given."""
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _gaps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values that ascend in runs as differences; ``first`` tells where each run begins."""
    return np.where(first, x, np.diff(x, prepend=0))


def _sums(gaps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What ``_gaps`` was given."""
    total, start = np.cumsum(gaps), np.flatnonzero(first)
    return total - np.repeat(total[start] - gaps[start], np.diff(start, append=len(gaps)))


def _starts(many: np.ndarray) -> np.ndarray:
    """Where each of the runs of ``many`` values, none of them empty, begins."""
    out = np.zeros(int(many.sum()), dtype=bool)
    out[np.cumsum(many) - many] = True
    return out


# ---------------------------------------------------------------- blocks
class Block:
    """The words of one language that a task has read and not yet written."""

    def __init__(self, words: list[bytes] = (), fresh: int = 0):
        self.number = _Numbers()
        self.ids: list[int] = []
        self.sizes: list[int] = []  # of the pieces that the words stand in
        self.fresh = fresh  # the position of the first word that no block before it has
        if words:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.ids.extend(map(self.number.__getitem__, words))
        self.sizes.append(len(words))

    def row(self, lang: str) -> list:
        ids, sizes = np.array(self.ids, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        at = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)  # a gap of one after each piece
        many = np.bincount(ids, minlength=len(self.number))
        lists = _gaps(at[np.argsort(ids, kind="stable")], _starts(many))
        return [lang, self.fresh, int((at >= self.fresh).sum()), _zipped(b"\x20".join(self.number)), _zipped(_planes(many)), _zipped(_planes(lists))]


FIELDS = {"lang": pa.string(), "fresh": pa.int32(), "n": pa.int64(), "words": pa.binary(), "many": pa.binary(), "at": pa.binary()}


def _written(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(FIELDS.values())], names=list(FIELDS))


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, block: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Block] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(column(batch, "lang"), text_bytes(batch), strict=True):
            for piece in (text or b"").lower().translate(PARTS).split(b"\n"):
                words = piece.split() if len(piece) < STEP else (m[0] for m in WORD.finditer(piece))
                some = list(islice(words, block)) if len(piece) >= STEP else words
                last: list[bytes] = []
                while len(some) >= block:  # a block of its own, and what of it the next one needs
                    yield _written([Block(last + some[:block], len(last)).row(lang)])
                    last = (last + some[:block])[-(longest - 1) :] if longest > 1 else []
                    some = some[block:] if len(piece) < STEP else list(islice(words, block))
                if last and some:
                    yield _written([Block(last + some, len(last)).row(lang)])
                elif some:
                    held.setdefault(lang, Block()).add(some)
                    total += len(some)
            if total >= block:
                for name, x in held.items():
                    yield _written([x.row(name)])
                held, total = {}, 0
    for name, x in held.items():
        yield _written([x.row(name)])


# ---------------------------------------------------------------- lists
def spread(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def folded(words: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """A hash of each row of ``phrases``, numbers of ``words``' hashes."""
    out = words[phrases[:, 0]]
    for k in range(1, phrases.shape[1]):
        out = mix64(out * U64(BASE) + words[phrases[:, k]])
    return out


def common(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have the bit of their bucket set in a bitmap of 2**k buckets."""
    at = hashes >> U64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0


class Bitmaps:
    """Bitmaps of the common buckets of 1, 2 ... words; each is broadcast once and compressed, so a machine holds one file of each."""

    def __init__(self, sent: tuple[Broadcast, ...] = ()):
        self.sent = sent

    def and_one(self, spark: SparkSession, bitmap: np.ndarray) -> Bitmaps:
        return Bitmaps((*self.sent, spark.sparkContext.broadcast(_zipped(bitmap.tobytes()))))

    @property
    def value(self) -> list[np.ndarray]:
        return [np.frombuffer(_unzipped(x.value), "<u8") for x in self.sent]

    def discard(self) -> None:
        """Delete the files that nothing reads any more."""
        for x in self.sent:
            x.destroy()


Found = tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray]


def _found(batches: Iterator[pa.RecordBatch], sizes: range, known: list[np.ndarray]) -> Iterator[Found]:
    """Of each block and size: its language and words, the phrases as numbers of words, their hashes, and the lengths of their lists.

    ``known`` holds bitmaps of the common buckets of 1, 2 ... words; what is not in one is not extended, or, of the last size, not found.
    """
    for batch in batches:
        for one in (batch.slice(i, 1) for i in range(batch.num_rows)):  # a block at a time
            lang, fresh, words, many, at = (column(one, c)[0] for c in ("lang", "fresh", "words", "many", "at"))
            seed = zlib.crc32(lang.encode())
            words, many = _unzipped(words).split(b"\x20"), _numbers(_unzipped(many))
            ends = _sums(_numbers(_unzipped(at)), _starts(many))
            phrases = np.arange(len(words))[:, None]
            which = np.repeat(np.arange(len(words)), many)  # of which phrase each occurrence is
            spreads = np.array([spread(w, seed) for w in words], dtype=np.uint64)
            here = np.full(int(ends.max()) + 2, -1, dtype=np.int64)
            for size in range(1, sizes.stop):
                if size > 1:
                    ends = ends + 1
                    follows = here[ends]  # the words whose lists hold the next position
                    met = follows >= 0
                    pairs, which = np.unique(which[met] * len(words) + follows[met], return_inverse=True)
                    ends = ends[met]
                    phrases = np.concatenate([phrases[pairs // len(words)], (pairs % len(words))[:, None]], axis=1)
                if not len(phrases):
                    break
                hashes = folded(spreads, phrases)
                good = common(known[size - 2], folded(spreads, phrases[:, 1:])) if size > 1 else np.ones(len(phrases), dtype=bool)
                if size <= len(known):
                    good &= common(known[size - 1], hashes)
                keep = good[which]
                which, ends = which[keep], ends[keep]
                if size == 1:
                    here[ends] = which
                if size in sizes:
                    n = np.bincount(which[ends >= fresh], minlength=len(phrases))
                    some = np.flatnonzero(n)
                    yield lang, words, phrases[some], hashes[some], n[some]


def _tallies(batches: Iterator[pa.RecordBatch], size: int, bitmaps, bits: int) -> Iterator[pa.RecordBatch]:
    """(part, gaps, n): how often each bucket of a range has a phrase in a task's blocks; gaps lead from one bucket that has any to the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    wide, total = bits - RANGES, 0

    def merge() -> int:
        every, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(every, kind="stable")
        every, many = every[order], many[order]
        first = np.flatnonzero(np.diff(every, prepend=-1))
        held[:] = [(every[first], np.add.reduceat(many, first))]
        return len(first)

    def sent() -> pa.RecordBatch:
        bucket, total = held.pop()
        start = np.flatnonzero(np.diff(bucket >> wide, prepend=-1))
        parts = [(int(bucket[a] >> wide), _zipped(_planes(np.diff(bucket[a:b] & (1 << wide) - 1, prepend=0))), _zipped(_planes(total[a:b]))) for a, b in zip(start, [*start[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in parts], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "gaps", "n"])

    for _, _, _, hashes, n in _found(batches, range(size, size + 1), bitmaps.value):
        if len(n):
            held.append(((hashes >> U64(64 - bits)).astype(np.int32), n))
            total += len(n)
        if total > TALLIED:
            total = merge()
            if total > TALLIED // 2:
                yield sent()
                total = 0
    if held:
        merge()
        yield sent()


def _common(group: pd.DataFrame, least: int, wide: int) -> pd.DataFrame:
    """The buckets of a range whose tallies come to ``least``, as a bitmap, compressed."""
    total = np.zeros(1 << wide, dtype=np.int64)
    for gaps, n in zip(group.gaps, group.n, strict=True):
        total[np.cumsum(_numbers(_unzipped(gaps)))] += _numbers(_unzipped(n))
    return pd.DataFrame({"part": [group.part.iloc[0]], "common": [_zipped(np.packbits(total >= least, bitorder="little").tobytes())]})


class Counts:
    """Phrases of one language, as rows of numbers of words (from 1; 0 stands after the last word), and how often each occurs."""

    def __init__(self, lang: str, longest: int):
        self.number, self.lang, self.longest = _Numbers(), lang, longest
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, words: list[bytes], phrases: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> None:
        """Rows of numbers of ``words`` from 1 on, filled up with 0."""
        own = np.zeros(len(words) + 1, dtype=np.int32)
        used = np.unique(phrases)
        used = used[used > 0]
        own[used] = [self.number[words[i - 1]] + 1 for i in used.tolist()]
        rows = np.zeros((len(n), self.longest), dtype=np.int32)
        rows[:, : phrases.shape[1]] = own[phrases]
        self.held.append((hashes, rows, n))

    def merge(self) -> int:
        """Adds up equal phrases; how many are left.  Where different phrases share a hash, some may stay apart: sums come later."""
        hashes, rows, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, rows, n = hashes[order], rows[order], n[order]
        new = np.ones(len(n), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.held = [(hashes[first], rows[first], np.add.reduceat(n, first))]
        return len(first)


def _merging(found: Iterator[tuple], longest: int) -> Iterator[Counts]:
    """Merged counts of (lang, words, phrases, hashes, n), a language at a time; no more than about ``MERGED`` phrases are held."""
    held: dict[str, Counts] = {}
    total = 0
    for lang, words, phrases, hashes, n in found:
        if len(n):
            held.setdefault(lang, Counts(lang, longest)).add(words, phrases, hashes, n)
            total += len(n)
        if total > MERGED:
            total = sum(x.merge() for x in held.values())
            if total > MERGED // 2:
                yield from held.values()
                held, total = {}, 0
    for x in held.values():
        x.merge()
        yield x


def _packed(batches: Iterator[pa.RecordBatch], longest: int, parts: int, bitmaps) -> Iterator[pa.RecordBatch]:
    """(part, lang, words, counts): the lengths of the lists of phrases of up to ``longest`` words in a task's blocks, of those whose bucket is common.

    A part has the phrases with some first two words, in order, so that each column is small differences.
    """
    found = ((lang, words, phrases + 1, hashes, n) for lang, words, phrases, hashes, n in _found(batches, range(1, longest + 1), bitmaps.value))
    for x in _merging(found, longest):
        _, rows, n = x.held[0]
        said, seed = list(x.number), zlib.crc32(x.lang.encode())
        spreads = np.array([0, *(spread(w, seed) for w in said)], dtype=np.uint64)
        part = (folded(spreads, rows[:, :2]) % U64(parts)).astype(np.int64)
        order = np.lexsort((*rows.T[::-1], part))
        part, rows, n = part[order], rows[order], n[order]
        start = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(start, [*start[1:], len(part)], strict=True):
            used, own = np.unique(rows[a:b], return_inverse=True)
            own = own.reshape(b - a, longest) + (used[0] > 0)
            first, columns = np.zeros(b - a, dtype=bool), []
            first[0] = True
            for k in range(longest):
                columns.append(_planes(_gaps(own[:, k], first)))
                first = first | (np.diff(own[:, k], prepend=-1) != 0)
            words = b"\x20".join([said[i - 1] for i in used.tolist() if i])
            row = (int(part[a]), x.lang, _zipped(words), _zipped(b"".join([*columns, _planes(n[a:b])])))
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["part", "lang", "words", "counts"])


def _unpacked(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n): what tasks have packed, merged."""

    def found() -> Iterator[tuple]:
        for batch in batches:
            for lang, words, counts in zip(*(column(batch, c) for c in ("lang", "words", "counts")), strict=True):
                *gaps, n = _numbers_of_rows(_unzipped(counts), longest + 1)
                rows, first = np.zeros((len(n), longest), dtype=np.int64), np.zeros(len(n), dtype=bool)
                first[0] = True
                for k in range(longest):
                    rows[:, k] = _sums(gaps[k], first)
                    first = first | (np.diff(rows[:, k], prepend=-1) != 0)
                said, seed = _unzipped(words).split(b"\x20"), zlib.crc32(lang.encode())
                spreads = np.array([0, *(spread(w, seed) for w in said)], dtype=np.uint64)
                yield lang, said, rows, folded(spreads, rows), n

    for x in _merging(found(), longest):
        _, rows, n = x.held[0]
        words, sizes = list(x.number), (rows > 0).sum(axis=1)
        for first in range(0, len(n), SENT):
            here, size = rows[first : first + SENT] - 1, sizes[first : first + SENT]
            said = pa.array([b"\x20".join([words[i] for i in p[:k]]) for p, k in zip(here.tolist(), size.tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x.lang] * len(here), pa.string()), pa.array(size, pa.int32()), said, pa.array(n[first : first + SENT], pa.int64())], names=["lang", "size", "phrase", "n"])


def _numbers_of_rows(x: bytes, columns: int) -> list[np.ndarray]:
    wide = len(x) // columns
    return [_numbers(x[k * wide : (k + 1) * wide]) for k in range(columns)]


def _lists(batches: Iterator[pa.RecordBatch], longest: int, bitmaps) -> Iterator[pa.RecordBatch]:
    """Packed and unpacked in one task."""
    return _unpacked(_packed(batches, longest, 1, bitmaps), longest)


def _tallied(lists: DataFrame, size: int, bitmaps: Bitmaps, bits: int, least: int) -> np.ndarray:
    """A bitmap of the buckets of phrases of ``size`` words that come to ``least``."""
    tallies = lists.mapInArrow(partial(_tallies, size=size, bitmaps=bitmaps, bits=bits), "part int, gaps binary, n binary")
    found = tallies.groupBy("part").applyInPandas(partial(_common, least=least, wide=bits - RANGES), "part int, common binary").toArrow()
    out = np.zeros((1 << bits) // 64, dtype=np.uint64)
    for part, bitmap in zip(found.column("part").to_pylist(), found.column("common").to_pylist(), strict=True):
        at, own = part << bits - RANGES - 6, np.frombuffer(_unzipped(bitmap), "<u8")
        out[at : at + len(own)] = own
    return out


# ---------------------------------------------------------------- operators
def frequent_phrases(blocks: DataFrame, longest: int = 4, least: int = 30, bitmap_bits: int = BITMAP) -> DataFrame:
    """(lang, size, phrase, a) of the phrases of 1, 2, ... ``longest`` words that occur ``least`` times or more, as a table."""
    spark = blocks.sparkSession
    lists = blocks.select("lang", "fresh", "words", "many", "at")
    words = blocks.agg(F.sum("n")).head()[0] or 0
    bits = max(RANGES + 6, min(bitmap_bits, int(words)).bit_length() - 1)
    bitmaps = Bitmaps()
    with small_batches(spark, 4):
        for size in range(1, longest + 1):
            bitmaps = bitmaps.and_one(spark, _tallied(lists, size, bitmaps, bits, least))
        parts = min(max(PARTITIONS[0], int(words) >> 24), PARTITIONS[1])
        packed = lists.mapInArrow(partial(_packed, longest=longest, parts=parts, bitmaps=bitmaps), "part int, lang string, words binary, counts binary")
        counted = packed.repartition(parts, "part").mapInArrow(partial(_unpacked, longest=longest), "lang string, size int, phrase string, n long")
        phrases = materialize(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "phrases")
    bitmaps.discard()
    return phrases


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, best: int = 2000, percent: int = 80, block: int = BLOCK, bitmap_bits: int = BITMAP) -> DataFrame:
    """The ``best`` phrases of 2 to ``longest`` words of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A phrase that a longer one of at least ``percent`` hundredths of its frequency holds is left out.
    """
    schema = "lang string, fresh int, n long, words binary, many binary, at binary"
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(partial(_blocks, longest=longest, block=block), schema), "blocks")
    phrases = frequent_phrases(blocks, longest, least, bitmap_bits)
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    discard(blocks)

    words = F.split("phrase", "\x20", -1)
    joined = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    candidates = phrases.where("size > 1").withColumn("words", words)
    # all that a longer phrase holds is held by one of a word more, which is as frequent at least
    inner = candidates.where("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    tops = inner.groupBy("lang", "phrase").agg(F.max("a").alias("top"))
    left = candidates.join(tops, ["lang", "phrase"], "left").where(F.col("top").isNull() | (F.lit(100) * F.col("top") < F.lit(percent) * F.col("a")))

    cut = left.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    parts = phrases.where(F.col("size") < longest)
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint)")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
