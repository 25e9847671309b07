"""Gradient-boosted trees with one softmax over the outcomes, grown from distributed histograms.

Features become bins once.  A round grows one tree an outcome, all from the same probabilities: each
level is one pass over the rows that sums gradients and hessians by (outcome, node, feature, bin), a
partial sum in every task and one ``groupBy`` over them, and the driver picks each node's split from
sums whose number depends on the trees and bins only.  Gradients are rounded to multiples of
``1 / UNIT`` first, so sums of whole numbers are exact and the same trees come out whatever the
partitioning.  Rows are packed in blocks of ``BLOCK``, whose margins are written anew every ``RENEW``
rounds; between that a task adds the few trees since.

The number of rounds is chosen on the last rows by kick-off: it is the best one before ``patience``
rounds without a better log loss; then all rows are used with that number of rounds.

Defined results: null features count as larger than all others; rows without an outcome are not learnt
from; fewer than ``LEAST`` rows get no early stop; no rows at all are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .metrics import P

UNIT = float(1 << 30)
#: Rows of a block; their sums stay exact in doubles.
BLOCK = 1 << 15
#: Rounds after which margins are written anew.
RENEW = 10
#: Rows below which nothing is held out.
LEAST = 200
#: A split must gain more than this.
GAIN = 1e-6
CLASSES = 3


@dataclass
class Tree:
    """Nodes in rows of a complete tree: those after node i are 2 i + 1 (below the cut) and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where each row stands after at most ``levels`` splits."""
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] >= self.cut[at]), at)
        return at

    def add(self, bins: np.ndarray, margin: np.ndarray) -> None:
        margin += self.value[self.nodes(bins, len(self.feature).bit_length() - 1)]


@dataclass
class Forest:
    features: list[str]
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)  # after 0, 1, 2 ... rounds of the trial

    def importance(self, top: int | None = None) -> list[tuple[str, float]]:
        """Features by the mean gain of their splits, as shares of one."""
        total, many = np.zeros(len(self.features)), np.zeros(len(self.features))
        for trees in self.rounds:
            for t in trees:
                some = t.feature >= 0
                np.add.at(total, t.feature[some], t.gain[some])
                np.add.at(many, t.feature[some], 1)
        mean = total / np.maximum(many, 1)
        mean = mean / max(mean.sum(), 1e-300)
        return sorted(((f, round(float(x), 5)) for f, x in zip(self.features, mean, strict=True)), key=lambda x: -x[1])[:top]

    def artifact(self) -> dict:
        """All that ``restored`` needs, as JSON has it."""
        trees = [[{k: getattr(t, k).tolist() for k in ("feature", "cut", "value", "gain")} for t in r] for r in self.rounds]
        return {"model": "boosted trees", "features": self.features, "edges": [e.tolist() for e in self.edges], "rounds": trees}

    @classmethod
    def restored(cls, artifact: dict) -> Forest:
        if artifact.get("model") != "boosted trees":
            raise ValueError(f"no boosted trees: {artifact.get('model')!r}")
        rounds = [[Tree(*(np.array(t[k], dtype=kind) for k, kind in (("feature", int), ("cut", int), ("value", float), ("gain", float)))) for t in r] for r in artifact["rounds"]]
        return cls(list(artifact["features"]), [np.array(e, dtype=float) for e in artifact["edges"]], rounds)

    def nodes(self) -> list[tuple[int, int, int, str | None, float | None, float]]:
        """(round, outcome, node, feature, threshold, value) of all nodes in use; no feature at a leaf."""
        out = []
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                used = {0}
                for i in range(len(t.feature)):
                    if i in used:
                        f = int(t.feature[i])
                        out.append((r, k, i, self.features[f], float(self.edges[f][t.cut[i] - 1]), float(t.value[i])) if f >= 0 else (r, k, i, None, None, float(t.value[i])))
                        used |= {2 * i + 1, 2 * i + 2} if f >= 0 else set()
        return out

    @classmethod
    def of_nodes(cls, features: Sequence[str], nodes: Sequence[tuple]) -> Forest:
        """The forest of a table as ``nodes`` gives it."""
        cuts: dict[str, set[float]] = {f: set() for f in features}
        depth, rounds = 0, 0
        for r, _, node, feature, threshold, _ in nodes:
            depth, rounds = max(depth, (node + 1).bit_length() - 1), max(rounds, r + 1)
            if feature is not None:
                cuts[feature].add(float(threshold))
        out = cls(list(features), [np.array(sorted(cuts[f])) for f in features], [[Tree.empty(depth) for _ in range(CLASSES)] for _ in range(rounds)])
        for r, k, node, feature, threshold, value in nodes:
            t = out.rounds[r][k]
            t.value[node] = value
            if feature is not None:
                t.feature[node] = out.features.index(feature)
                t.cut[node] = int(np.searchsorted(out.edges[t.feature[node]], threshold)) + 1
        return out


# ---------------------------------------------------------------- columns and tasks
def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each feature, at its quantiles; a value equal to a cut is above it."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, max(10_000, 50 * bins)).alias(f) for f in features]).head()
    return [np.unique(np.array(found[f] or [], dtype=float)) for f in features]


def _values(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of values; what is no number is in the last one."""
    return np.stack([np.searchsorted(e, np.where(np.isnan(v), np.inf, v), side="right") for v, e in zip(values.T, edges, strict=True)], axis=1)


def _packed(batches: Iterator[pa.RecordBatch], features: Sequence[str], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            cells = [some.column(some.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_id", "_y", "_held")]
            raw = [cells[0].astype("<i8"), binned(_values(some, features), edges).astype("<u2"), cells[1].astype("<i1"), cells[2].astype("<i1"), np.zeros((some.num_rows, CLASSES))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw], names=["id", "bins", "y", "held", "margin"])


BLOCKS = "id binary, bins binary, y binary, held binary, margin binary"


def _rows_of(batch: pa.RecordBatch, i: int, wide: int) -> tuple[np.ndarray, ...]:
    kinds = ("<i8", "<u2", "<i1", "<i1", "<f8")
    ids, bins, y, held, margin = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate(kinds))
    return ids, bins.reshape(-1, wide).astype(np.int64), y.astype(np.int64), held > 0, margin.reshape(-1, CLASSES).copy()


def drawn(ids: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a digest of the row, the seed and the tree's number."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + turn) % (1 << 63))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def probabilities(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss by outcome k's margin, in units; the hessian is the usual upper bound of twice p (1 - p)."""
    p = probabilities(margin)[:, k]
    return np.rint((p - (y == k)) * UNIT), np.rint(np.maximum(2 * p * (1 - p), 1e-16) * UNIT)


def _sums(batches: Iterator[pa.RecordBatch], since: list[list[Tree]], now: list[Tree], level: int, sizes: tuple[int, ...], columns: list[list[int]], turn: int, seed: int, share: float, trial: bool) -> Iterator[pa.RecordBatch]:
    """(key, g, h): sums of what the nodes of a level hold, and, before a round of a trial, the loss of the rows held out under keys -1."""
    wide, bins, nodes = len(sizes), max(sizes), 1 << level
    for batch in batches:
        for i in range(batch.num_rows):
            ids, cells, y, held, margin = _rows_of(batch, i, wide)
            for trees in since:
                for k, t in enumerate(trees):
                    t.add(cells, margin[:, k])
            keys, gs, hs = [], [], []
            if trial and not level:
                loss = -np.log(np.clip(probabilities(margin)[held, y[held]], 1e-15, 1.0))
                keys, gs, hs = [[-1]], [[np.rint(loss * UNIT).sum()]], [[held.sum()]]
            for k, t in enumerate(now):
                here = t.nodes(cells, level) - (nodes - 1)
                used = (here >= 0) & drawn(ids, seed, turn * CLASSES + k, share) & ~(held & trial)
                g, h = gradients(margin, y, k)
                for f in columns[k]:
                    at = here[used] * bins + cells[used, f]
                    many = np.bincount(at, minlength=nodes * bins)
                    some = np.flatnonzero(many)
                    keys.append(((k * nodes + some // bins) * wide + f) * bins + some % bins)
                    gs.append(np.bincount(at, g[used], nodes * bins)[some])
                    hs.append(np.bincount(at, h[used], nodes * bins)[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, gs, hs)], names=["key", "g", "h"])


def _renewed(batches: Iterator[pa.RecordBatch], since: list[list[Tree]], wide: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            _, cells, _, _, margin = _rows_of(batch, i, wide)
            for trees in since:
                for k, t in enumerate(trees):
                    t.add(cells, margin[:, k])
            out.append(margin.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=batch.schema.names)


# ---------------------------------------------------------------- growing
def best_split(g: np.ndarray, h: np.ndarray, columns: list[int], penalty: float, least: float) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, cut, sums of both sides) of one node from its (features, bins) sums, the first of equal ones."""
    scale = lambda x: x / UNIT
    best = None
    for f in columns:
        total_g, total_h = g[f].sum(), h[f].sum()
        left_g, left_h = np.cumsum(g[f])[:-1], np.cumsum(h[f])[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        worth = lambda a, b: scale(a) ** 2 / (scale(b) + penalty)
        gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(total_g, total_h)
        gain = np.where((scale(left_h) >= least) & (scale(right_h) >= least), gain, -np.inf)
        if len(gain) and gain.max() > max(GAIN, best[0] if best else GAIN):
            c = int(gain.argmax())
            best = (float(gain[c]), f, c + 1, np.array([[left_g[c], left_h[c]], [right_g[c], right_h[c]]]))
    return best


@dataclass
class Settings:
    trees: int = 750
    depth: int = 4
    step: float = 0.05
    min_weight: float = 10.0
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    held: float = 0.2
    patience: int = 25
    bins: int = 256
    seed: int = 42

    def some_columns(self, turn: int, wide: int) -> list[int]:
        """The features that a tree sees."""
        n = max(1, int(self.columns * wide))
        return sorted(np.random.default_rng([self.seed, turn]).permutation(wide)[:n].tolist())


def _grow(blocks: DataFrame, forest: Forest, s: Settings, rounds: int, trial: bool) -> list[list[Tree]]:
    """``rounds`` rounds of trees; in a trial, those up to the best one on the rows held out."""
    wide, sizes = len(forest.features), tuple(len(e) + 1 for e in forest.edges)
    bins = max(sizes)
    table, out, since = blocks.persist(), [], []
    best = (float("inf"), 0)
    for turn in range(rounds + trial):
        now = [Tree.empty(s.depth) for _ in range(CLASSES)]
        columns = [s.some_columns(turn * CLASSES + k, wide) for k in range(CLASSES)]
        open_ = [(k, 0) for k in range(CLASSES)] if turn < rounds else []
        for level in range(s.depth):
            if not open_ and (level or not trial):
                break
            task = partial(_sums, since=since, now=now, level=level, sizes=sizes, columns=columns if open_ else [[]] * CLASSES, turn=turn, seed=s.seed, share=s.rows, trial=trial)
            sums = table.mapInArrow(task, "key long, g long, h long").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            key, g, h = (sums.column(c).to_numpy() for c in ("key", "g", "h"))
            if trial and not level:
                lost, many = int(g[key < 0].sum()), int(h[key < 0].sum())
                loss = lost / UNIT / max(many, 1)
                forest.held_losses.append(loss)
                if loss < best[0] and turn:
                    best = (loss, turn)
                if turn == rounds or turn and turn - best[1] >= s.patience:
                    table.unpersist()
                    return out[: max(best[1], 1)]
            nodes = 1 << level
            cube = np.zeros((2, CLASSES * nodes * wide * bins))
            cube[0][key[key >= 0]], cube[1][key[key >= 0]] = g[key >= 0], h[key >= 0]
            cube = cube.reshape(2, CLASSES, nodes, wide, bins)
            coming = []
            for k, node in open_:
                t, (own_g, own_h) = now[k], cube[:, k, node - (nodes - 1)]
                if not level:
                    first = columns[k][0]
                    t.value[0] = -own_g[first].sum() / UNIT / (own_h[first].sum() / UNIT + s.penalty) * s.step
                split = best_split(own_g, own_h, columns[k], s.penalty, s.min_weight)
                if split is None:
                    continue
                t.gain[node], t.feature[node], t.cut[node], sides = split
                for side, (a, b) in enumerate(sides):
                    t.value[2 * node + 1 + side] = -a / UNIT / (b / UNIT + s.penalty) * s.step
                    coming.append((k, 2 * node + 1 + side))
            open_ = coming
        out.append(now)
        since.append(now)
        if len(since) == RENEW:
            new = written(table.mapInArrow(partial(_renewed, since=since, wide=wide), BLOCKS)).persist()
            table.unpersist()
            table, since = new, []
    table.unpersist()
    return out


def fit(rows: DataFrame, features: Sequence[str], outcome: str = "outcome", key: str = "match_id", settings: Settings | None = None) -> Forest:
    """Learn ``outcome`` (0, 1, 2) from ``features`` of ``rows``, which have a kickoff and a whole number ``key``."""
    s = settings or Settings()
    known = rows.where(F.col(outcome).isNotNull())
    at = F.unix_micros(F.col("kickoff").cast("timestamp"))
    n, last = known.agg(F.count("*"), F.percentile_approx(at, 1.0 - s.held, 1_000_000)).head()
    if not n:
        raise ValueError("no rows to learn from")
    forest = Forest(list(features), bin_edges(known, features, s.bins))
    slim = known.select(F.col(key).cast("long").alias("_id"), F.col(outcome).cast("int").alias("_y"), (at > last).alias("_held"), *[F.col(f).cast("double").alias(f) for f in features])
    slim = slim.coalesce(-(-n // BLOCK))  # no more tasks than there are blocks
    blocks = written(slim.mapInArrow(partial(_packed, features=list(features), edges=forest.edges), BLOCKS))
    rounds = s.trees
    if s.patience and s.held and n >= LEAST:
        rounds = len(_grow(blocks, forest, s, s.trees, trial=True))
    forest.rounds = _grow(blocks, forest, s, rounds, trial=False)
    return forest


# ---------------------------------------------------------------- predicting
def _predicted(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = binned(_values(batch, forest.features), forest.edges)
        margin = np.zeros((len(cells), CLASSES))
        for trees in forest.rounds:
            for k, t in enumerate(trees):
                t.add(cells, margin[:, k])
        p = probabilities(margin)
        keep = [i for i, c in enumerate(batch.schema.names) if c not in P]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(p[:, k].copy()) for k in range(CLASSES))], names=[*(batch.schema.names[i] for i in keep), *P])


def predict(forest: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with p_home, p_draw and p_away; a map without a shuffle."""
    keep = rows.drop(*P)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + [f"{c} double" for c in P])
    return keep.mapInArrow(partial(_predicted, forest=forest), schema)
