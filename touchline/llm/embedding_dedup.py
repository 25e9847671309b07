"""Embedding near-duplicates over an inverted multi-index (operator 5).

Unit vectors are cut into halves with a codebook each; the pairs of nearest
centroids form a grid of cells, the index, which holds every vector.  A vector's search
is the multi-sequence traversal: both halves' centroids are sorted by a lower bound of the
distance to any vector of theirs, and a heap gives grid cells in the order of the bounds'
summed squares.  It ends when the next cell is beyond the radius that the target recall
needs.  At ``target_recall=1`` that is the squared distance which the cosine threshold
allows, so no linked vector can lie in an unvisited cell.  For a lower target it is what a
documented sample needs: vectors moved at random to exactly the threshold, of which that share
must stay in reach.  Whatever is visited is verified in double precision, so nothing below
the threshold links.  (Links are symmetric, so of two cells that reach each other one visits.)

Equal vectors are one class before the search, so copies are never paired.  Large cells
are split into blocks, and their searchers too, so a task's share is bounded whatever the
skew.  Groups return counts and a spanning forest, never pairs.

Codebooks are fitted on at most about ``sample`` vectors, with a number of centroids
that grows with the table so that cells stay near ``per_cell`` vectors.

Defined results: only vectors of equal, non-null labels and equal length are compared;
a vector that is null, empty or zero, or holds null or non-finite components, links with
nothing; rows that share a vec_id are vectors of their own with links of their own, and in one
component, since that is of ids; a null vec_id links with nothing; ids and labels keep their
types; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialize
from .components import connected_components

BLOCK, SEARCHERS = 256, 4096
#: Vectors that are held against the codebooks at once.
CHUNK = 1024


# ---------------------------------------------------------------- the index
def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centroids of ``x``, started from evenly spaced rows."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (np.square(c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        many = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[many > 0] = total[many > 0] / many[many > 0, None]
    return np.unique(c, axis=0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and a lower bound of its distance to each cell.

    The cell of a centroid lies on its side of the plane halfway to the nearest one.
    """
    long = np.square(c).sum(1)
    d = np.square(x).sum(1)[:, None] + long[None, :] - 2 * x @ c.T
    best = d.argmin(1)
    rows = np.arange(len(x))
    apart = long[best][:, None] + long[None, :] - 2 * c[best] @ c.T
    out = np.maximum((d - d[rows, best][:, None]) / (2 * np.sqrt(np.maximum(apart, 0.0) + 1e-13)), 0.0)
    out[rows, best] = 0.0
    return best, out


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Places (i, j) of two ascending sequences in the order of a[i] + b[j], as long as that is at most ``most``."""
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            break
        out.append((i, j))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):  # each place is reached in one way
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class Codebooks:
    """Two codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, k: int, radius2: float, target_recall: float):
        self.half = x.shape[1] // 2
        self.parts = [kmeans(h, k) for h in (x[:, : self.half], x[:, self.half :])]
        self.radius2 = radius2
        if target_recall < 1.0:
            rng = np.random.default_rng(0)
            move = rng.standard_normal(x.shape)
            move -= (move * x).sum(1)[:, None] * x
            move /= np.maximum(np.linalg.norm(move, axis=1), 1e-300)[:, None]
            cos = 1 - radius2 / 2
            there = cos * x + np.sqrt(1 - cos * cos) * move
            need = np.zeros(len(x))
            for part, a, b in zip(self.parts, self.split(x), self.split(there), strict=True):
                for at in range(0, len(x), CHUNK):
                    rows = slice(at, at + CHUNK)
                    low, near = bounds(a[rows], part)[1], bounds(b[rows], part)[0]
                    need[rows] += np.square(low[np.arange(len(low)), near])
            self.radius2 = float(min(radius2, np.quantile(need, target_recall)))

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def visit(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each row's own cell, and the cells from its own on that its search visits."""
        (near1, low1), (near2, low2) = (bounds(h, c) for h, c in zip(self.split(x), self.parts, strict=True))
        m = len(self.parts[1])
        own, out = near1 * m + near2, []
        order1, order2 = low1.argsort(1, kind="stable"), low2.argsort(1, kind="stable")
        for i in range(len(x)):
            p, q = order1[i], order2[i]
            met = multi_sequence(np.square(low1[i, p]), np.square(low2[i, q]), self.radius2 + 1e-9)
            out.append([c for c in (int(p[u]) * m + int(q[v]) for u, v in met) if c >= own[i]])
        return own, out


# ---------------------------------------------------------------- tasks
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles, their digest and length; all null for vectors that link with nothing."""
    for batch in batches:
        ids, labels, keys, raws, dims = column(batch, "vec_id"), column(batch, "label"), [], [], []
        for i, v, label in zip(ids, column(batch, "embedding"), labels, strict=True):
            ok = bool(v) and i is not None and label is not None and None not in v
            x = np.array(v if ok else [], dtype="<f8") + 0.0
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            raw = x.tobytes()
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
            raws.append(raw if ok else None)
            dims.append(len(x) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "dim", "digest", "raw"])


def _unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<f8")
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _visit(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    held = books.value
    for batch in batches:
        dims, raws = column(batch, "dim"), column(batch, "raw")
        cell, visits = [0] * len(dims), [[0] for _ in dims]
        for d in set(dims) & set(held):
            rows = [i for i, x in enumerate(dims) if x == d]
            for at in range(0, len(rows), CHUNK):
                some = rows[at : at + CHUNK]
                own, cells = held[d].visit(np.stack([_unit(raws[i]) for i in some]))
                for i, c, v in zip(some, own.tolist(), cells, strict=True):
                    cell[i], visits[i] = c, v
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "visits"])


def _link(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block of a cell: how many each vector has here, and a root that it reaches."""
    held, coming = group[group.held], group[~group.held]
    a = np.stack([_unit(r) for r in held.raw]) if len(held) else np.zeros((0, 1))
    ids = np.concatenate([held.node.to_numpy(), coming.node.to_numpy()])
    weight = np.concatenate([held.n.to_numpy(), coming.n.to_numpy()])
    left, right = [], []
    if len(a) and bool(held.within.iloc[0]):
        i, j = np.nonzero(np.triu(a @ a.T >= threshold, 1))
        left.append(i)
        right.append(j)
    if len(a) and len(coming):
        i, j = np.nonzero(np.stack([_unit(r) for r in coming.raw]) @ a.T >= threshold)
        left.append(i + len(a))
        right.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = links > 0
    return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})


# ---------------------------------------------------------------- operators
def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, target_recall: float = 1.0, sample: int = 20_000, per_cell: int = 512, max_codes: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label).

    Codebooks grow with the square root of the vectors a label has, so that cells stay near
    ``per_cell``, up to ``max_codes`` centroids a half; beyond 4096**2 * 512 vectors a label cells grow.
    """
    spark = vectors.sparkSession
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    rows = materialize(plain.mapInArrow(_read, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, digest binary, raw binary"), "vectors")
    same = ["label", "dim", "digest"]
    grouped = rows.where("digest is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("raw").alias("raw"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")  # numbers, since two classes may share an id

    total, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).head()
    k = max(4, min(max_codes, int(np.ceil(np.sqrt(total / max(1, labels) / per_cell)))))
    part = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20)) + 1
    found: dict[int, list[np.ndarray]] = {}
    for r in classes.where(part).select("dim", "raw").collect():  # at most about ``sample`` rows
        found.setdefault(r.dim, []).append(_unit(r.raw))
    books = spark.sparkContext.broadcast({d: Codebooks(np.stack(x), k, 2 - 2 * threshold, target_recall) for d, x in found.items()})
    index = materialize(classes.mapInArrow(partial(_visit, books=books), classes.schema.simpleString()[7:-1] + ",cell:int,visits:array<int>"), "vector-index")

    cell = ["label", "dim", "at"]
    visits = index.select("label", "dim", "node", "n", "raw", "cell", F.explode("visits").alias("at"))
    sizes = visits.groupBy(*cell).agg(F.sum((F.col("cell") == F.col("at")).cast("long")).alias("own"), F.count("*").alias("come"))
    sizes = sizes.where("own > 0").select(*cell, F.ceil(F.col("own") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("come") / SEARCHERS).cast("int").alias("shifts"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    shift = F.pmod(F.xxhash64("node", F.lit(1)), F.col("shifts")).cast("int")
    here = F.col("cell") == F.col("at")
    # a held vector stands in its block for every shift; as a searcher it goes to later blocks, or all blocks of other cells
    held = F.when(here, F.transform(F.sequence(F.lit(0), F.col("shifts") - 1), lambda s: F.struct(block.alias("block"), s.alias("shift"), F.lit(True).alias("held"), (s == 0).alias("within"))))
    first = F.when(here, block + 1).otherwise(F.lit(0))
    goes = F.when(first < F.col("blocks"), F.transform(F.sequence(first, F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), shift.alias("shift"), F.lit(False).alias("held"), F.lit(False).alias("within"))))
    empty = F.array().cast("array<struct<block:int,shift:int,held:boolean,within:boolean>>")
    dealt = visits.join(sizes, cell).select(*cell, "node", "n", "raw", F.explode(F.concat(F.coalesce(held, empty), F.coalesce(goes, empty))).alias("x")).select(*cell, "node", "n", "raw", "x.*")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return _link(group, threshold)

    links = materialize(dealt.groupBy(*cell, "block", "shift").applyInPandas(link, "node long, links long, root long"), "vector-links")

    discard(index)

    placed = materialize(rows.select("vec_id", *same).join(classes.select(*same, "node"), same, "left").select("vec_id", "node"), "vector-places")
    discard(rows)
    shared = placed.where("node is not null").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    ties = placed.join(shared, "vec_id").select("a", F.col("node").alias("b"))
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(ties))
    least = classes.join(groups, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "rep", "n").join(counted, "node", "left").join(groups.join(least, "component").select("node", "component_id"), "node", "left")
    known = materialize(known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-known")
    for table in (classes, links, groups):
        discard(table)
    out = placed.join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
