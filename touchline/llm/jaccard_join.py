"""Exact Jaccard join of word n-gram sets with signature trees (operator 7).

A document's set holds the hashes of its word shingles.  Documents of equal sets are
one class.  Two classes link when their sets' Jaccard similarity is at least a ratio.

The signature tree has two levels that are joined and one that is traversed.

1. *Size ranges.*  The root's children hold sets of sizes L to 2L - 1.  Only sets of one
   range or of neighbouring ones can overlap enough, so a set takes part in its own range
   and, if it is near the range's lower end, in the one below.
2. *Signatures.*  In a range, elements are dealt by hash into m parts.  Sets that link differ
   in at most d = n (1-t)/t elements, n being the size of either, so all but d parts are the
   same in both, and among any set's best d + 1 parts, in an order that depends on a part's
   content alone, is one that the other set has among its own.  The order is by how rare a
   part's elements are in the corpus, so that common words and shared passages are left out
   of signatures, and so are empty parts.  Sets that have no part of their signatures in common
   have too small a possible overlap: their node pair is pruned, by an equi-join.  Frequencies
   are tallied in a table of ``CELLS`` counters over all documents; how full the table is
   changes how much is pruned and never what is found.
3. *Families.*  Sets of one part are tied to the least of them (the least is a partial
   aggregate, so a frequent part is reduced before it is shuffled); connected components of these
   ties are families, which no link leaves.  A family is cut by size, again into ranges that
   only neighbours can link across, and into blocks, and pairs of blocks are searched in one task.
4. *Trees.*  In a task, sets are leaves of a tree whose nodes hold the OR of their members'
   token bitmaps and their range of sizes.  Two nodes are traversed together and pruned when
   the largest overlap their bitmaps allow is too small for their sizes; what remains is
   verified on the sets of 64-bit shingle hashes.  (Two different shingles of a pair of
   documents have one hash with a chance of 2**-64 times the product of their sizes; equal
   sets are told by their size and two 64-bit sums.)

For components, nodes that are already in one are pruned too, and tasks return the links
of a spanning forest.  ``link_counts`` verifies every pair that bitmaps do not rule out,
and tasks return how many rows each class links with, not the pairs.

Defined results: null and empty texts have empty sets and link with nothing; a text of
fewer words than a shingle is one shingle; rows that share a doc_id are joined as one
node; a null doc_id, or one that is no number, links with nothing; an empty table gives none;
other columns are ignored by ``near_duplicates``.  ``keep_one`` judges texts whatever their
doc_id: of rows that share one, each goes or stays by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE2, NOT_BLANK, U64, column, discard, materialize, mix64, signed, steps, text_bytes, whole_ids, windows, Words
from .components import connected_components

#: Sets, and elements of sets, that a block of a family holds on average; two blocks meet in a task.
BLOCK, BLOCK_ELEMENTS = 128, 1 << 20
#: Rows of places in families that may be broadcast: some 40 MB.  More are joined.
MAX_BROADCAST_ROWS = 500_000
#: Counters of the table of frequencies (4 bytes each), and how many make a row of it.
CELLS, CHUNK = 1 << 20, 1 << 10
#: Parts in a range, as a multiple of those that its largest sets keep.
SPARE = 1.5
BITS = 2048
LEAF = 4
#: What a set is known by: its size and two sums of hashes of its elements.
KEY = ["n_shingles", "one", "two"]


# ---------------------------------------------------------------- sets
def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles."""
    for a, b in steps(texts):
        w = Words(texts[a:b], NOT_BLANK, lower=True)
        grams = windows(w.hash, k)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j - i >= k:
                yield np.unique(grams[i : j - k + 1])
            else:
                yield windows(w.hash[i:j], j - i) if j > i else np.zeros(0, dtype=np.uint64)


def cell(s: np.ndarray) -> np.ndarray:
    return (s & U64(CELLS - 1)).astype(np.int64)


def parts_of_range(low: int, ratio: Fraction) -> int:
    """Parts that sets of sizes ``low`` to ``2 * low - 1`` are dealt into."""
    return int(((2 * low - 1) * (1 - ratio) / ratio + 1) * Fraction(SPARE)) + 1


def signature(s: np.ndarray, ratio: Fraction, rare: np.ndarray) -> np.ndarray:
    """Hashes of the set's best parts in each size range where it may meet others.

    rare: for each cell, the logarithm of its share of all elements.  A part is as rare as its
    rarest element, to a factor of two, and then the better the more and rarer elements it has.
    """
    n, out = len(s), []
    mixed, weight = mix64(s ^ U64(BASE2)), rare[cell(s)]
    keep = int(n * (1 - ratio) / ratio) + 1
    low, least = 1 << (n.bit_length() - 1), math.ceil(n * ratio)
    while True:
        m = parts_of_range(low, ratio)
        place = ((mixed >> U64(7)) % U64(m)).astype(np.int64)
        by = place.argsort(kind="stable")  # equal parts have their elements in one order, and so equal sums of weights
        first = np.flatnonzero(np.diff(place[by], prepend=-1))
        full = place[by][first]
        hashes = mix64(np.add.reduceat(mixed[by], first) + mix64(full.astype(np.uint64) + U64(low << 24)))
        if len(full) > keep:
            rarest = np.floor(np.minimum.reduceat(weight[by], first) / math.log(2))
            hashes = hashes[np.lexsort((hashes, np.add.reduceat(weight[by], first), rarest))[:keep]]
        elif len(full) < keep:  # empty parts come last
            empty = np.ones(m, dtype=bool)
            empty[full] = False
            hashes = np.concatenate([hashes, np.sort(mix64(mix64(np.flatnonzero(empty).astype(np.uint64) + U64(low << 24))))[: keep - len(full)]])
        out.append(hashes)
        if least >= low:
            return np.concatenate(out)
        low //= 2


# ---------------------------------------------------------------- trees
class Node:
    __slots__ = ("bits", "low", "high", "lost", "members", "children")

    def __init__(self, bits: np.ndarray, low: int, high: int, lost: int, members: list[int], children: list[Node]):
        self.bits, self.low, self.high, self.lost, self.members, self.children = bits, low, high, lost, members, children


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(s >> U64(20)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def grow(sets: list[np.ndarray], members: list[int]) -> Node | None:
    """A binary tree of ``members``; alike sets are put side by side by size and least element."""
    if not members:
        return None
    order = sorted(members, key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i]), i))
    level = []
    for at in range(0, len(order), LEAF):
        some = order[at : at + LEAF]
        maps = [bitmap(sets[i]) for i in some]
        sizes = [len(sets[i]) for i in some]
        lost = max(n - int(np.bitwise_count(m).sum()) for n, m in zip(sizes, maps, strict=True))
        level.append(Node(np.bitwise_or.reduce(maps), min(sizes), max(sizes), lost, some, []))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 2):
            two = level[at : at + 2]
            if len(two) == 1:
                above.append(two[0])
            else:
                a, b = two
                above.append(Node(a.bits | b.bits, min(a.low, b.low), max(a.high, b.high), max(a.lost, b.lost), a.members + b.members, two))
        level = above
    return level[0]


def tree_links(sets: list[np.ndarray], left: list[int], right: list[int] | None, ratio: Fraction, every: bool = False) -> list[tuple[int, int]]:
    """Verified links that join what can be joined, or ``every`` one: within ``left``, or between it and ``right``."""
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    num, den = ratio.numerator, ratio.denominator
    out: list[tuple[int, int]] = []
    a = grow(sets, left)
    b = a if right is None else grow(sets, right)
    stack = [(a, b)] if a and b else []
    while stack:
        x, y = stack.pop()
        if x.high * den < num * y.low or y.high * den < num * x.low:
            continue
        most = min(int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.lost, y.lost), x.high, y.high)
        # overlap / (sizes - overlap) >= ratio needs overlap (den + num) >= num * sizes
        if most * (den + num) < num * (x.low + y.low):
            continue
        if x is y:
            if x.children:
                p, q = x.children
                stack += [(p, q), (q, q), (p, p)]
                continue
            pairs = [(i, j) for n, i in enumerate(x.members) for j in x.members[n + 1 :]]
        elif x.children or y.children:
            if not every and len({root(i) for i in x.members} | {root(i) for i in y.members}) == 1:
                continue
            if y.children and (not x.children or len(y.members) >= len(x.members)):
                stack += [(x, c) for c in y.children]
            else:
                stack += [(c, y) for c in x.children]
            continue
        else:
            pairs = [(i, j) for i in x.members for j in y.members]
        for i, j in pairs:
            if not every and root(i) == root(j):
                continue
            s, t = sets[i], sets[j]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and both * (den + num) >= num * (len(s) + len(t)):
                up[root(j)] = root(i)
                out.append((i, j))
    return out


# ---------------------------------------------------------------- tasks
def _tally(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """How often each cell is met in a partition: one row a chunk of the table."""
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        texts = text_bytes(batch)
        for a, b in steps(texts):
            w = Words(texts[a:b], NOT_BLANK, lower=True)
            grams = windows(w.hash, k)  # those across two texts do no harm
            counts += np.bincount(cell(grams), minlength=CELLS)
    yield from _chunks(dict(enumerate(counts.reshape(-1, CHUNK))))


def _chunks(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = sorted(held)
    for at in range(0, len(keys), 256):
        some = keys[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([held[i].astype("<i8").tobytes() for i in some], pa.binary())], names=["chunk", "counts"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk added up as they stream past; memory is one table at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(column(batch, "chunk"), column(batch, "counts"), strict=True):
            held[i] = held.get(i, 0) + np.frombuffer(c, "<i8")
    yield from _chunks(held)


def rarity(texts: DataFrame, k: int) -> np.ndarray:
    """The logarithm of each cell's share of all shingles of ``texts`` (text): ``CELLS`` numbers, whatever the corpus."""
    tallied = texts.select("text").where("text is not null").mapInArrow(partial(_tally, k=k), "chunk int, counts binary")
    counts = np.ones(CELLS)
    for r in tallied.repartition("chunk").mapInArrow(_total, "chunk int, counts binary").collect():  # 8 MB
        counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.counts, "<i8")
    return np.log(counts / counts.sum()).astype(np.float32)


def _parts(batches: Iterator[pa.RecordBatch], k: int, ratio: Fraction, rare) -> Iterator[pa.RecordBatch]:
    weights = rare.value
    for batch in batches:
        keys, parts = [], []
        for s in shingle_sets(text_bytes(batch), k):
            keys.append(set_key(s))
            parts.append(signed(signature(s, ratio, weights)) if len(s) else np.zeros(0, dtype=np.int64))
        keep = [n for n in batch.schema.names if n != "text"]
        columns = [pa.array([x[i] for x in keys], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), *columns, pa.array(parts, pa.list_(pa.int64()))], names=[*keep, *KEY, "parts"])


def set_key(s: np.ndarray) -> tuple[int, int, int]:
    total = np.array([s.sum(dtype=np.uint64), mix64(s * U64(BASE2)).sum(dtype=np.uint64)], dtype=np.uint64)
    return len(s), *signed(mix64(total + U64(len(s)))).tolist()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n for n in batch.schema.names if n != "text"]
        elements = pa.array([s.tobytes() for s in shingle_sets(text_bytes(batch), k)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), elements], names=[*keep, "elements"])


def _verified(group: pd.DataFrame, ratio: Fraction, every: bool) -> list[tuple[int, int]]:
    sets = [np.frombuffer(e, np.uint64) for e in group.elements]
    place = group.place.to_numpy()
    i, j = int(group.i.iloc[0]), int(group.j.iloc[0])
    return tree_links(sets, np.flatnonzero(place == i).tolist(), None if i == j else np.flatnonzero(place == j).tolist(), ratio, every)


def _count(group: pd.DataFrame, ratio: Fraction) -> pd.DataFrame:
    """How many rows each node of a group links with in it."""
    group = group.drop_duplicates("node")
    rows, links = group.n_rows.to_numpy(), np.array(_verified(group, ratio, True), dtype=np.int64).reshape(-1, 2)
    n = np.zeros(len(group), dtype=np.int64)
    np.add.at(n, links[:, 0], rows[links[:, 1]])
    np.add.at(n, links[:, 1], rows[links[:, 0]])
    return pd.DataFrame({"node": group.node.to_numpy()[n > 0], "n": n[n > 0]}, dtype="int64")


def _search(group: pd.DataFrame, ratio: Fraction) -> pd.DataFrame:
    group = group.drop_duplicates("node")
    ids, links = group.node.to_numpy(), _verified(group, ratio, False)
    return pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links]}, dtype="int64")


# ---------------------------------------------------------------- the join
def _families(dealt: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """node and family of each node of ``dealt`` (node, part) that shares a part with another, and tables that this reads."""
    shared = dealt.groupBy("part").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("part", "least")
    near = materialize(dealt.join(shared, "part").where("node <> least").select("node", "least"), "ties")
    # each node hooks to the smallest of its leasts, and that one's; what then still ties two tops is
    # little, as a large group's many ties become one
    up = materialize(near.groupBy("node").agg(F.min("least").alias("up")), "hooks")
    tops = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up", "left").select("node", F.coalesce("upper", "up").alias("top"))
    tops = materialize(tops, "tops")
    other = tops.select(F.col("node").alias("least"), F.col("top").alias("b"))
    ties = near.join(tops, "node").join(other, "least", "left").select(F.col("top").alias("a"), F.coalesce("b", "least").alias("b")).where("a <> b").distinct()
    linked = connected_components(ties).select(F.col("node").alias("top"), "component")
    roots = near.select(F.col("least").alias("node")).distinct().join(tops.select("node"), "node", "left_anti").select("node", F.col("node").alias("top"))
    return tops.union(roots).join(linked, "top", "left").select("node", F.coalesce("component", "top").alias("family")), [near, up, tops]


def _groups(sets: DataFrame, ratio: Fraction) -> DataFrame:
    """Rows of ``sets`` (node, family, n_shingles, rep, ...) with i, j and place: one row for each group (family, i, j) of theirs.

    A family is cut into ranges of sizes, such that sets that link are in one or in neighbouring
    ones, and these into blocks; a set's place is its block.  Two blocks i <= j meet in one group.
    """
    width = math.log(1 / ratio) * (1 + 1e-9)  # a little more, for what rounding does at a range's end
    span = F.floor(F.log(F.col("n_shingles").cast("double")) / width).cast("int")
    placed = sets.withColumn("span", span)
    sizes = placed.groupBy("family", "span").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    sizes = materialize(sizes.withColumn("blocks", blocks).select("family", "span", "blocks"), "family-blocks")
    above = sizes.select("family", (F.col("span") - 1).alias("span"), F.col("blocks").alias("above"))
    below = sizes.select("family", (F.col("span") + 1).alias("span"), F.col("blocks").alias("below"))
    around = sizes.join(above, ["family", "span"], "left").join(below, ["family", "span"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    number = lambda span, block: span.cast("long") * F.lit(1 << 32) + block  # noqa: E731  blocks in order of their ranges
    others = lambda n, step: F.transform(F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda b: number(F.col("span") + step, b.cast("long")))
    met = F.concat(others(F.col("blocks"), 0), others(F.col("above"), 1), others(F.col("below"), -1))
    placed = placed.join(around, ["family", "span"]).withColumn("place", number(F.col("span"), own)).withColumn("other", F.explode(met))
    return placed.withColumns({"i": F.least("place", "other"), "j": F.greatest("place", "other")}).drop("other", "span", "blocks", "above", "below")


def _join(docs: DataFrame, k: int, ratio: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, sum of the text, key), their classes (key, rep, n_rows, node), and groups of sets to search.

    Nodes are classes, so that texts which share a doc_id stay apart.
    """
    texts = docs.select(whole_ids(docs).alias("doc_id"), F.xxhash64("text").alias("sum"), "text")
    rare = docs.sparkSession.sparkContext.broadcast(rarity(texts, k))
    rows = materialize(texts.mapInArrow(partial(_parts, k=k, ratio=ratio, rare=rare), "doc_id long, sum long, n_shingles long, one long, two long, parts array<long>"), "sets")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*KEY).agg(F.min(F.struct("doc_id", "sum")).alias("rep"), F.count("*").alias("n_rows"))
    classes = materialize(classes.select(*KEY, "rep.*", "n_rows", F.monotonically_increasing_id().alias("node")), "set-classes")

    own = usable.select("doc_id", "sum", *KEY, "parts").join(classes.select("doc_id", "sum", *KEY, "node"), ["doc_id", "sum", *KEY])
    families, used = _families(own.select("node", F.explode("parts").alias("part")))
    places = _groups(families.join(classes, "node").select("node", "family", "n_shingles", "doc_id", "sum", "n_rows"), ratio)
    places = materialize(places.groupBy("doc_id", "sum", "node", "n_rows").agg(F.collect_list(F.struct("family", "i", "j", "place")).alias("places")), "places")
    for table in used:
        discard(table)
    small = places.agg(F.sum(F.size("places"))).head()[0] or 0
    here = texts.join(F.broadcast(places) if small <= MAX_BROADCAST_ROWS else places, ["doc_id", "sum"])
    sets = here.select("node", "n_rows", "places", "text").mapInArrow(partial(_sets, k=k), "node long, n_rows long, places array<struct<family: long, i: long, j: long, place: long>>, elements binary")
    return rows, classes, sets.select("node", "n_rows", "elements", F.explode("places").alias("x")).select("node", "n_rows", "elements", "x.*")


def _links(groups: DataFrame, ratio: Fraction) -> DataFrame:
    """Links (a, b) of nodes that join what can be joined in each of ``groups``."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return _search(group, ratio)

    return materialize(groups.groupBy("family", "i", "j").applyInPandas(search, "a long, b long"), "links")


# ---------------------------------------------------------------- operators
def near_duplicates(docs: DataFrame, k: int = 5, similarity: str = "0.8") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links lead to, the row's own included.
    """
    ratio = Fraction(similarity)
    rows, classes, groups = _join(docs, k, ratio)
    links = _links(groups, ratio)
    # classes that share a doc_id are one node
    held = materialize(rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", *KEY).join(classes.select(*KEY, "node"), KEY).select("doc_id", "node"), "nodes")
    several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    ties = several.join(held, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    linked = connected_components(links.union(ties))
    known = materialize(classes.join(linked, "node", "left").select(*KEY, "doc_id", F.coalesce("component", "node").alias("component")), "set-components")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = known.join(least, "component").select(*KEY, "component_id")
    out = rows.select("doc_id", *KEY).join(known, KEY, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def link_counts(docs: DataFrame, k: int = 5, similarity: str = "0.8") -> DataFrame:
    """doc_id, n_shingles and n_links of each row of ``docs`` (doc_id, text): the other rows that it links with.

    Rows that share a doc_id count as rows; one without a doc_id or a word has no links.
    """
    ratio = Fraction(similarity)
    rows, classes, groups = _join(docs, k, ratio)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return _count(group, ratio)

    found = materialize(groups.groupBy("family", "i", "j").applyInPandas(count, "node long, n long"), "link-counts")
    others = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = materialize(classes.join(others, "node", "left").select(*KEY, (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n")), "set-links")
    n = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    return rows.select("doc_id", *KEY).join(known, KEY, "left").select("doc_id", "n_shingles", F.coalesce(n, F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, similarity: str = "0.8") -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts, that of the least doc_id."""
    ratio = Fraction(similarity)
    rows, classes, groups = _join(docs, k, ratio)
    linked = connected_components(_links(groups, ratio))
    known = classes.join(linked, "node", "left").select(*KEY, F.coalesce("component", "node").alias("component"))
    each = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "sum", *KEY).agg(F.count("*").alias("n"))
    judged = materialize(each.join(known, KEY).select("doc_id", "sum", "n", "component"), "judged")
    kept = materialize(judged.groupBy("component").agg(F.min(F.struct("doc_id", "sum")).alias("w")).select("w.*"), "kept")

    def among(left: DataFrame, some: DataFrame, how: str) -> DataFrame:
        same = (F.col("d.doc_id").try_cast("long") == F.col("h.doc_id")) & (F.xxhash64("d.text") == F.col("h.sum"))
        return left.alias("d").join(some.alias("h"), same, how)

    out = among(docs, judged.select("doc_id", "sum").join(kept, ["doc_id", "sum"], "left_anti"), "left_anti")
    twice = judged.where("n > 1").join(kept, ["doc_id", "sum"], "left_semi").select("doc_id", "sum")
    if not twice.head(1):
        return out
    # rows that repeat doc_id and text: any one of them
    return among(out, twice, "left_anti").union(among(out, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
