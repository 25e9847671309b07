"""Benchmark decontamination by winnowing (operator 2).

Of each ``w = window - k + 1`` consecutive k-gram hashes of a text the smallest
(of equal ones the last) is its *fingerprint*.  Two texts that share ``window``
consecutive words choose the same fingerprint inside them, so joining training and
test fingerprints and extending each hit word by word finds every shared span that
long, from about 2 / (w + 1) of all k-grams.  An item of fewer words than a window
is one window; there k is its length and w is 1.

Test fingerprints are broadcast only when the benchmark's texts are at most
``max_broadcast_bytes``, and then documents are only mapped, without any shuffle.
A larger benchmark is joined by fingerprint, a shuffle of fingerprints with a few
words around each; both ways give the same rows.

Defined results: null and empty texts have no words and no hits; items that repeat an
item_id count once, and an item without one marks words but is not listed; each row of
the documents is judged by itself; an empty benchmark contaminates nothing; other
columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, column, least_of_each, materialize, steps, text_bytes, whole_ids, windows, Words

WINDOW, K = 10, 5
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest of each ``w`` consecutive values; of equal ones the last."""
    return np.unique(least_of_each(grams, w))


class Index:
    """The fingerprints of a benchmark that was found small enough to hold."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int, k: int):
        self.window, self.k = window, k
        self.ids = [i for i, _ in items]
        self.words = w = Words([t for _, t in items], ALNUM, lower=True)
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i in range(len(items)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= window:
                grams = windows(w.hash[a:b], k)
                for p in winnow(grams, window - k + 1).tolist():
                    self.at.setdefault(0, {}).setdefault(int(grams[p]), []).append((i, a + p))
            elif b > a:
                self.at.setdefault(b - a, {}).setdefault(int(windows(w.hash[a:b], b - a)[0]), []).append((i, a))
        self.known = {n: np.sort(np.fromiter(x, dtype=np.uint64, count=len(x))) for n, x in self.at.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of shared spans; begin and end count all words of ``words``."""
        done: set[tuple[int, int, int]] = set()
        for n, known in self.known.items():
            grams = windows(words.hash, n or self.k)
            place = np.arange(len(grams)) if n else winnow(grams, self.window - self.k + 1)
            # a text that ends the chunk may be shorter than the chunk's last windows
            found = np.searchsorted(known, grams[place]).clip(max=len(known) - 1)
            for p in place[known[found] == grams[place]].tolist():
                doc = int(np.searchsorted(words.first, p, side="right")) - 1
                for item, q in self.at[n][int(grams[p])]:
                    if (doc, item, p - q) not in done:
                        done.add((doc, item, p - q))
                        yield from self.extend(words, doc, item, p - q)

    def extend(self, words: Words, doc: int, item: int, shift: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of equal words at one alignment that hold a whole window."""
        own = self.words
        a, b = int(own.first[item]), int(own.first[item + 1])
        need = min(self.window, b - a)
        low, high = max(int(words.first[doc]), a + shift), min(int(words.first[doc + 1]), b + shift)
        same = np.concatenate([[False], words.hash[low:high] == own.hash[low - shift : high - shift], [False]])
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= need and all(words.word(low + i) == own.word(low + i - shift) for i in range(s, e)):
                yield doc, item, low + s, low + e


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _judge(batches: Iterator[pa.RecordBatch], index, keep: bool) -> Iterator[pa.RecordBatch]:
    """Results of each row; with ``keep``, the clean rows themselves."""
    held = index.value
    for batch in batches:
        texts = text_bytes(batch)
        n_words, n_hit, n_items, sums = [], [], [], []
        for a, b in steps(texts):
            words = Words(texts[a:b], ALNUM, lower=True)
            marked, found = np.zeros(len(words.hash) + 1, dtype=np.int64), defaultdict(set)
            for doc, item, s, e in held.hits(words):
                marked[s] += 1
                marked[e] -= 1
                found[doc].add(held.ids[item])
            total = np.concatenate([[0], np.cumsum(np.cumsum(marked[:-1]) > 0)])
            n_words += np.diff(words.first).tolist()
            n_hit += (total[words.first[1:]] - total[words.first[:-1]]).tolist()
            for i in range(b - a):
                ids = found[i] - {None} if i in found else set()
                n_items.append(len(ids))
                sums.append(_digest(ids))
        hit = pa.array([n > 0 for n in n_hit], pa.bool_())
        if keep:
            yield batch.filter(pa.array([n == 0 for n in n_hit], pa.bool_()))
        else:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sums, pa.string()), hit],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


# ------------------------------------------------ the way for large benchmarks
PRINTS = "n int, print long, before int, key struct<id: long, sum: string>, at long, words array<binary>"


def _prints(batches: Iterator[pa.RecordBatch], window: int, k: int, short: tuple[int, ...], items: bool) -> Iterator[pa.RecordBatch]:
    """Fingerprints with the words around them; ``short``: lengths below a window that items have."""
    for batch in batches:
        texts, ids = text_bytes(batch), batch.column(0).to_pylist()
        out: list[tuple] = []
        for i, t in zip(ids, texts, strict=True):
            w = Words([t], ALNUM, lower=True)
            m = len(w.hash)
            sizes = [0] if m >= window else []
            sizes += ([m] if 0 < m < window else []) if items else [n for n in short if n <= m]
            key = {"id": i, "sum": hashlib.md5(t or b"").hexdigest()}
            for n in sizes:
                size = n or k
                around = 0 if n else window - k
                grams = windows(w.hash, size)
                for p in (range(len(grams)) if n else winnow(grams, window - k + 1).tolist()):
                    low = max(0, p - around)
                    out.append((n, int(grams[p].astype(np.int64)), p - low, key, p, [w.word(x) for x in range(low, min(m, p + size + around))]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        key_type = pa.struct([("id", pa.int64()), ("sum", pa.string())])
        kinds = [pa.int32(), pa.int64(), pa.int32(), key_type, pa.int64(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["n", "print", "before", "key", "at", "words"])


def _extend(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Words of a document that a window around a joined fingerprint covers."""
    for batch in batches:
        keys, items, low, high = [], [], [], []
        for r in batch.to_pylist():
            need, size = (r["n"], r["n"]) if r["n"] else (window, k)
            before = min(r["before"], r["item_before"])
            a, b = r["before"] - before, r["item_before"] - before
            same = [x == y for x, y in zip(r["words"][a:], r["item_words"][b:], strict=False)]
            s, e = before, before + size
            if not all(same[s:e]):
                continue
            while s and same[s - 1]:
                s -= 1
            while e < len(same) and same[e]:
                e += 1
            if e - s >= need:
                keys.append(r["key"])
                items.append(r["item_id"])
                low.append(r["at"] - before + s)
                high.append(r["at"] - before + e)
        key_type = pa.struct([("id", pa.int64()), ("sum", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(items, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["key", "item_id", "low", "high"])


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = text_bytes(batch), []
        for a, b in steps(texts):
            out += np.diff(Words(texts[a:b], ALNUM, lower=True).first).tolist()
        sums = [hashlib.md5(t or b"").hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), pa.array(out, pa.int64())], names=["doc_id", "sum", "n_words"])


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """hit_id, hit_sum, n_hit and items of each text that shares a window with the benchmark."""
    test = materialize(benchmark.mapInArrow(partial(_prints, window=window, k=k, short=(), items=True), PRINTS), "test-prints")
    short = tuple(sorted(r.n for r in test.where("n > 0").select("n").distinct().collect()))  # at most window - 1 numbers
    train = docs.mapInArrow(partial(_prints, window=window, k=k, short=short, items=False), PRINTS)
    right = test.select("n", "print", F.col("key.id").alias("item_id"), F.col("before").alias("item_before"), F.col("words").alias("item_words"))
    spans = train.join(right, ["n", "print"]).mapInArrow(partial(_extend, window=window, k=k), "key struct<id: long, sum: string>, item_id long, low long, high long")
    places = spans.select("key", F.explode(F.sequence("low", F.col("high") - 1)).alias("place")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = spans.select("key", "item_id").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return places.join(named, "key").select(F.col("key.id").alias("hit_id"), F.col("key.sum").alias("hit_sum"), "n_hit", "items")


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    hit = _hits(docs, benchmark, window, k)
    base = docs.mapInArrow(_n_words, "doc_id long, sum string, n_words long")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sum") == F.col("hit_sum")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


# ---------------------------------------------------------------- operators
def _held(benchmark: DataFrame, window: int, k: int, limit: int):
    """The broadcast index, or None if the benchmark is too large for one."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    if size > limit:
        return None
    items = [(r.item_id, None if r.text is None else r.text.encode()) for r in benchmark.collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Index(items, window, k))


def _plain(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(whole_ids(benchmark, "item_id").alias("item_id"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, max_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Each document's words, words that a benchmark window covers, and items found in it."""
    rows = docs.select(whole_ids(docs).alias("doc_id"), "text")
    held = _held(_plain(benchmark), window, k, max_broadcast_bytes)
    if held is None:
        return _joined(rows, _plain(benchmark), window, k)
    return rows.mapInArrow(partial(_judge, index=held, keep=False), "doc_id long, " + RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, max_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all their columns."""
    held = _held(_plain(benchmark), window, k, max_broadcast_bytes)
    if held is None:
        bad = _hits(docs.select(whole_ids(docs).alias("doc_id"), "text"), _plain(benchmark), window, k).select("hit_id", "hit_sum")
        # a text's digest goes with the id, so that rows of one id, or of none, are judged by their own texts
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.hit_id")) & (F.md5(F.col("d.text").cast("binary")) == F.col("h.hit_sum"))
        return docs.alias("d").join(bad.alias("h"), same, "left_anti")
    return docs.mapInArrow(partial(_judge, index=held, keep=True), docs.schema)
