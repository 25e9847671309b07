"""A quality classifier: hashed word n-grams, FTRL-proximal training (operator 6).

Texts are cut into runs of letters and digits and runs of marks, as they stand.
Single runs and neighbouring pairs are hashed into ``2**bits`` features; all pairs of
a run with itself share one, so that repetition is learnt whatever is repeated.  A text of
n features is the vector of its feature counts over sqrt(n), so scoring is a sparse
dot product, and the weights of a text's features are summed without building it.

Training follows the regularised leader (per-coordinate FTRL-proximal, L1 and L2)
over a bounded sample of labelled rows: at most about ``max_training_docs``, picked
by a hash of the key, so that it does not depend on partitioning.  The sample's
features go to one task; its size does not grow with the corpus.  The weights have
a fixed size of ``4 * 2**bits`` bytes, which is what makes broadcasting them safe.

Defined results: null and empty texts get the score of the bias alone; labels that
are null or disagree for a key are not learnt from; without usable labels every
score is 0.5; equal rows score alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, column, mix64, steps, text_bytes, whole_ids, Words

#: Byte classes: 0 blanks and controls, 1 letters, digits and all non-ASCII, 2 marks.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[:0x21] = 0
CLASSES[0x7F] = 0
CLASSES[0x80:] = 1
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    CLASSES[_low : _high + 1] = 1


def features(texts: list[bytes | None], bits: int) -> Iterator[np.ndarray]:
    """The feature numbers of each text, with repetition."""
    w = Words(texts, CLASSES, lower=False)
    one = (w.hash >> U64(64 - bits)).astype(np.int64)
    left, right = w.hash[:-1], w.hash[1:]
    pair = (mix64(np.where(left == right, U64(1), left * U64(3) + right)) >> U64(64 - bits)).astype(np.int64)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        yield np.concatenate([one[a:b], pair[a : max(a, b - 1)]])


def ftrl(rows: Iterator[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of the features; the bias is the last."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    kept = []
    for ids, label in rows:
        at, many = np.unique(ids, return_counts=True)
        kept.append((np.append(at, size - 1), np.append(many / np.sqrt(max(len(ids), 1)), 1.0), label))
    for _ in range(epochs):
        for at, x, label in kept:
            p = 1.0 / (1.0 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - label) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w[at]
            n[at] = grown
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
    return w.astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keys, labels = text_bytes(batch), batch.column(0).to_pylist(), column(batch, "label")
        for a, b in steps(texts):
            found = [f.astype("<i4").tobytes() for f in features(texts[a:b], bits)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(labels[a:b], pa.int32()), pa.array(found, pa.binary())], names=["key", "label", "features"])


def _train(batches: Iterator[pa.RecordBatch], bits: int, **rates: float) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(column(batch, "key"), column(batch, "label"), column(batch, "features"), strict=True)]
    rows.sort(key=lambda r: (int(mix64(np.array([r[0]], dtype=np.int64).view(np.uint64))[0]), r[0]))  # one order, however the rows came
    w = ftrl(((np.frombuffer(f, "<i4"), y) for _, y, f in rows), bits, **rates)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])


def train_quality(docs: DataFrame, labels: DataFrame, bits: int = 20, max_training_docs: int = 8000, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Learn from ``labels`` (doc_id, label 0/1) the weights that ``score_quality`` takes."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))
    known = clean.count()
    if not known:
        return np.zeros((1 << bits) + 1, dtype=np.float32)
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(min(1.0, max_training_docs / known) * (1 << 20))
    chosen = F.broadcast(clean.where(part))  # at most about max_training_docs rows
    rows = docs.select(whole_ids(docs).alias("doc_id"), "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    found = rows.select("doc_id", "text", "label").mapInArrow(partial(_features, bits=bits), "key long, label int, features binary")
    learn = partial(_train, bits=bits, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    return np.frombuffer(found.repartition(1).mapInArrow(learn, "weights binary").head()[0], np.float32)


def _score(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    w = weights.value
    bits = int(len(w) - 1).bit_length() - 1
    for batch in batches:
        texts, score = text_bytes(batch), []
        for a, b in steps(texts):
            for f in features(texts[a:b], bits):
                score.append(float(w[-1]) + float(w[f].sum(dtype=np.float64)) / np.sqrt(max(len(f), 1)))
        out = 1.0 / (1.0 + np.exp(-np.clip(np.array(score, dtype=np.float64), -35, 35)))
        keep = [n for n in batch.schema.names if n != "score"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(out)], names=[*keep, "score"])


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a ``score`` of 0 to 1 from ``text`` alone; a map, without any shuffle."""
    keep = docs.drop("score")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + ["score double"])
    return keep.mapInArrow(partial(_score, weights=docs.sparkSession.sparkContext.broadcast(weights)), schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
