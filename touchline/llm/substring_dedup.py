"""Removal of repeated passages with suffix automata (operator 9).

A word goes if ``span`` consecutive words of its document around it also start in a
document with a smaller doc_id.  The reference for that is every passage's first
occurrence.  Broadcasting automata of a whole corpus to all its documents would cost
the square of the corpus, so first it is found which documents can meet which:

1. Equal texts are one class; only its least document is searched.
2. Winnowing chooses one fingerprint inside every span.  Fingerprints that occur in
   one document only rule their spans out; the hashes of the other spans are
   reduced to the first document of each (both by partial aggregation).
3. A document's spans that occur later, and only these, are its *reference shard*.
   A suffix automaton of the shard is built in the task it is sent to, and the
   passages that can repeat it are streamed through: the matching statistics give at
   each word the longest shard substring that ends there, and maximal spans of at
   least ``span`` words go.  A shard is bounded by one document.  It is sent once to each
   group of at most about ``GROUP`` of its passages, and in front of them, so a passage that
   a million documents repeat is dealt to many tasks, each of which builds the automaton once.

Hashes only decide what is compared; the automata decide on the words themselves.

Defined results: null and empty texts have no words and lose none; rows that share a
doc_id are never each other's smaller document; a null doc_id neither loses nor removes
words; an empty table gives none; other columns are ignored by ``repeated_spans`` and
kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE2, NOT_BLANK, column, least_of_each, materialize, signed, steps, text_bytes, whole_ids, windows, Words

SPAN, K = 50, 10
#: Bytes of shared fingerprints, and of what stands beside them, that may be broadcast.  More are joined.
MAX_BROADCAST_BYTES = 32 << 20
#: Passages that a reference shard is sent to at once.
GROUP = 2000


class SuffixAutomaton:
    """All substrings of some word lists; none reaches from one list into the next."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for n, passage in enumerate(passages):
            for word in (n, *passage) if n else passage:  # a number parts two passages
                last = self._extend(last, word)

    def _extend(self, last: int, word: bytes | int) -> int:
        nxt, link, size = self.next, self.link, self.size
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        return cur

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``words`` covered by matches of ``least`` words or more."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out: list[list[int]] = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(word)
            if to is not None:
                state = to
                length += 1
            if length >= least:
                begin = i + 1 - length
                if out and begin <= out[-1][1]:
                    out[-1][1] = i + 1
                    out[-1][0] = min(out[-1][0], begin)
                else:
                    out.append([begin, i + 1])
        return [(a, b) for a, b in out]


# ---------------------------------------------------------------- tasks
def _class(text: bytes | None) -> bytes:
    return hashlib.blake2b(b" ".join((text or b"").split()), digest_size=16).digest()


PRINTS = "doc_id long, n_words long, sha string, class binary, prints array<long>"


def _prints(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each text: its words, their digests, and its distinct fingerprints."""
    for batch in batches:
        texts, n_words, prints, shas, classes = text_bytes(batch), [], [], [], []
        for a, b in steps(texts):
            w = Words(texts[a:b], NOT_BLANK, lower=False)
            grams = windows(w.hash, k)
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                own = grams[i : max(i, j - k + 1)]
                n_words.append(j - i)
                prints.append(signed(np.unique(own[least_of_each(own, span - k + 1)])) if j - i >= span else np.zeros(0, dtype=np.int64))
        for t in texts:
            joined = b" ".join((t or b"").split())
            shas.append(hashlib.sha256(joined).hexdigest())
            classes.append(hashlib.blake2b(joined, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), pa.array(classes, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "class", "prints"])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and where each row's begin; nothing becomes a Python object."""
    held = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    return held.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _windows(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Distinct spans of a text whose fingerprint others have too, as two hashes each."""
    for batch in batches:
        same = [c == _class(t) for t, c in zip(text_bytes(batch), column(batch, "class"), strict=True)]
        batch = batch.filter(pa.array(same, pa.bool_()))  # noqa: PLW2901  not other rows of its doc_id
        prints, at = _lists(batch, "prints")
        prints, one, two = prints.to_numpy(), [], []
        for i, t in enumerate(text_bytes(batch)):
            h = Words([t], NOT_BLANK, lower=False).hash
            grams = windows(h, k)
            ok = np.isin(signed(grams[least_of_each(grams, span - k + 1)]), prints[at[i] : at[i + 1]])
            x, place = np.unique(windows(h, span)[ok], return_index=True)
            one.append(signed(x))
            two.append(signed(windows(h, span, BASE2)[ok][place]))
        keep = [n for n in batch.schema.names if n not in ("prints", "class")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(one, pa.list_(pa.int64())), pa.array(two, pa.list_(pa.int64()))], names=[*keep, "one", "two"])


PASSAGES = "ref long, cid long, start long, passages array<string>"


def _passages(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """A text's reference shard (cid is null), and its passages that others' shards may hold."""
    for batch in batches:
        known, at = _lists(batch, "known")
        ones, refs = (pc.struct_field(known, n).to_numpy() for n in ("one", "ref"))
        rows: list[tuple] = []
        for i, (t, own) in enumerate(zip(text_bytes(batch), column(batch, "cid"), strict=True)):
            words = (t or b"").split()
            h = signed(windows(Words([t], NOT_BLANK, lower=False).hash, span))
            keys, vals = ones[at[i] : at[i + 1]], refs[at[i] : at[i + 1]]
            order = np.argsort(keys)
            keys, vals = keys[order], vals[order]
            place = np.searchsorted(keys, h).clip(max=len(keys) - 1)
            which = np.where(keys[place] == h, vals[place], -1)
            edge = np.flatnonzero(np.diff(which, prepend=-2, append=-2))
            shard = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if which[a] >= 0:
                    text = b" ".join(words[a : b - 1 + span]).decode()
                    if which[a] == own:
                        shard.append(text)
                    else:
                        rows.append((int(which[a]), own, a, [text]))
            if shard:
                rows.append((own, None, 0, shard))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds, strict=True)], names=["ref", "cid", "start", "passages"])


def _match(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Stream passages through the automata of their shards; a group's shard (cid is null) comes before its passages."""
    automaton = None
    for batch in batches:
        found = []
        passages = batch.column(batch.schema.get_field_index("passages"))
        for i, (c, start) in enumerate(zip(column(batch, "cid"), column(batch, "start"), strict=True)):
            texts = [p.encode().split() for p in passages[i].as_py()]
            if c is None:
                automaton = SuffixAutomaton(texts)
            else:
                found += [(c, start + a, start + b) for a, b in automaton.spans(texts[0], span)]
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], names=["cid", "low", "high"])


def _kept(words: list[bytes], spans: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        gone[s["low"]] += 1
        gone[s["high"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, shas = [], []
        for t, spans in zip(text_bytes(batch), column(batch, "spans"), strict=True):
            words = (t or b"").split()
            kept = _kept(words, spans)
            gone.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("cid")), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], names=["cid", "n_gone", "kept_sha"])


# ---------------------------------------------------------------- operators
def _tables(docs: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows' digests, classes' least documents, texts that share spans, and words to remove of each class."""
    texts = docs.select(whole_ids(docs).alias("doc_id"), "text")
    rows = materialize(texts.mapInArrow(partial(_prints, span=span, k=k), PRINTS), "prints")
    # a number for each class: written once, so it stays the same, and a third of the digest's size in every shuffle
    classes = materialize(rows.where("doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "text-classes")
    reps = rows.where(f"n_words >= {span}").join(classes.select("class", F.col("least").alias("doc_id"), "cid"), ["class", "doc_id"]).dropDuplicates(["cid"])
    dealt = materialize(reps.select("cid", "doc_id", F.explode("prints").alias("print")), "fingerprints")
    shared = dealt.groupBy("print").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("print")
    hits = dealt.join(shared, "print").groupBy("cid", "doc_id").agg(F.collect_list("print").alias("prints"))
    hits = materialize(hits.join(classes.select("cid", "class"), "cid"), "shared-prints")

    size = hits.agg(F.sum(8 * F.size("prints") + 100)).head()[0] or 0
    own = texts.join(F.broadcast(hits) if size <= MAX_BROADCAST_BYTES else hits, "doc_id").select("cid", "class", "doc_id", "text", "prints")
    involved = materialize(own.mapInArrow(partial(_windows, span=span, k=k), "cid long, doc_id long, text string, one array<long>, two array<long>"), "involved")
    spans = involved.select("cid", "doc_id", F.explode(F.arrays_zip("one", "two")).alias("x")).select("cid", "doc_id", "x.one", "x.two")
    first = spans.groupBy("one", "two").agg(F.min(F.struct("doc_id", "cid")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most")
    known = spans.join(first.select("one", "two", F.col("first.cid").alias("ref"), F.col("first.doc_id").alias("least")), ["one", "two"]).where("cid = ref or doc_id > least")
    known = known.groupBy("cid").agg(F.collect_list(F.struct("one", "ref")).alias("known"))
    passages = materialize(involved.select("cid", "text").join(known, "cid").mapInArrow(partial(_passages, span=span), PASSAGES), "passages")
    groups = passages.groupBy("ref").agg(F.ceil(F.count("cid") / GROUP).cast("int").alias("groups"))
    salt = F.when(F.col("cid").isNull(), F.sequence(F.lit(0), F.greatest("groups", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", "start"), F.col("groups")).cast("int")))
    dealt = passages.join(groups, "ref").select("ref", F.explode(salt).alias("salt"), "cid", "start", "passages")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "ref", "salt").sortWithinPartitions("ref", "salt", F.col("cid").asc_nulls_first(), "start")
    found = ordered.select("cid", "start", "passages").mapInArrow(partial(_match, span=span), "cid long, low long, high long")
    gone = materialize(found.groupBy("cid").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "repeats")
    return rows, classes, involved.select("cid", "text"), gone


def repeated_spans(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, of each row of ``docs``."""
    rows, classes, involved, gone = _tables(docs, span, k)
    cut = materialize(involved.join(gone, "cid").mapInArrow(_cut, "cid long, n_gone long, kept_sha string").dropDuplicates(["cid"]), "cut")
    rows = rows.drop("prints")
    kept = [F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")]
    short = rows.where(f"n_words < {span}").select("doc_id", "n_words", *kept)  # empty texts are one class, and nothing to join
    out = rows.where(f"n_words >= {span}").join(classes, "class", "left").join(cut, "cid", "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    own = F.col("doc_id").isNotNull() & F.col("n_gone").isNotNull()
    return short.union(
        out.select(
            "doc_id",
            "n_words",
            F.when(later, F.col("n_words")).when(own, F.col("n_gone")).otherwise(0).cast("long").alias("n_removed"),
            F.when(later, F.lit(nothing)).when(own, F.col("kept_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        )
    )


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_class(t) for t in text_bytes(batch)], pa.binary())], names=[*batch.schema.names, "class"])


def _rewrite(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, i, least, spans in zip(text_bytes(batch), column(batch, "doc_id"), column(batch, "least"), column(batch, "spans"), strict=True):
            words = (t or b"").split() if i is not None and (spans or (least is not None and i > least)) else []
            if words and i > least and len(words) >= span:
                t = b""  # noqa: PLW2901
            elif words and spans:
                t = b" ".join(_kept(words, spans))  # noqa: PLW2901
            out.append(None if t is None else t.decode())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(out, pa.string())], names=["row", "text"])


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``docs`` without the repeated words; a text that loses some has the others joined by one space, all others stay as they are."""
    _, classes, _, gone = _tables(docs, span, k)
    marks = classes.join(gone, "cid", "left").select("class", "least", "spans")
    packed = docs.select(F.struct(*docs.columns).alias("row"), whole_ids(docs).alias("doc_id"), F.col("text").alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    tagged = packed.mapInArrow(_tag, f"row {row}, doc_id long, text string, class binary")
    found = tagged.join(marks, "class", "left").mapInArrow(partial(_rewrite, span=span), f"row {row}, text string")
    return found.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")
