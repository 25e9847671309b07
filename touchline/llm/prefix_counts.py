"""Exact token counts of every prefix by dynamic programming (operator 8).

A byte-pair encoding is unique, and a sequence of tokens is one exactly when each
two neighbours are.  So the last token of a prefix is the one vocabulary entry
that ends there and may follow the last token of the prefix before it, and::

    count[i] = count[i - len(last[i])] + 1

gives the count of *every* prefix in one left-to-right pass.  Texts split into
*runs* (white space and what follows up to the next white space) that the rules
never join, so a document's table is the running sum of its runs' tables, and
each distinct run is worked out once per worker, as long as it is remembered: what a worker
remembers is bounded by bytes.  Runs without a blank in them are pieces as long as the text, so a
piece's table is two arrays, and the entries that may end at a byte are found by walking back
through the vocabulary's endings, not by trying all lengths.

``prefix_counts`` stores the tables; ``fits`` and ``count_at`` answer truncation
and budget questions from them without encoding anything again.

Defined results: null text counts as empty (0 bytes, 0 tokens); equal rows give
equal results; an empty table gives none; columns other than the key and the
text are passed through unless they clash with a result's name.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_letters, steps, text_bytes

#: Unicode white space, as the vocabulary's splitting rule has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LEAD = re.compile(f"[{SPACE}]*")
#: Runs whose split is plain to see: a word of Latin-1 letters, then marks.
SIMPLE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: Endings that the rule takes whole, but not in part.
WHOLE = {"'re", "'ve", "'ll"}
#: Bytes of each of the three things that a worker remembers; beyond that it forgets them all.
ROOM = 128 << 20
#: Pieces and runs longer than this are not remembered.
LONG = 1024


class PrefixTables:
    """Tables of runs under one byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        added = library.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.encode = library.model.tokenize
        names = {t.content for t in added.values()}
        self.vocab = {t for t in library.get_vocab(with_added_tokens=True) if t not in names}
        self.endings = {t[i:] for t in self.vocab for i in range(len(t))}
        self.letters = byte_letters()
        self.first = {t.content[0] for t in added.values()}
        self.follows: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes | array] = {}
        self.totals: dict[str, int] = {}
        self.held = dict.fromkeys(("follows", "words", "totals"), 0)

    def keep(self, name: str, key, value, size: int) -> None:
        """Remember something of about ``size`` bytes."""
        held = self.held[name] + size
        known = getattr(self, name)
        if held > ROOM:
            known.clear()
            held = size
        known[key] = value
        self.held[name] = held

    def may_follow(self, a: str, b: str) -> bool:
        found = self.follows.get((a, b))
        if found is None:
            found = [t.value for t in self.encode(a + b)] == [a, b]
            self.keep("follows", (a, b), found, 280)
        return found

    def grow(self, u: str, count: array, size: array) -> None:
        """Append, for the prefixes of ``u`` that they lack, the counts and the lengths of the last tokens; ``u`` has a letter for each byte."""
        vocab, follows, endings = self.vocab, self.follows, self.endings
        for i in range(len(count), len(u) + 1):
            # most often the last token grows by a byte; else the longest that may stand there
            j = i - 1 - size[-1]
            t = u[j:i]
            if t not in vocab or (j and not (follows.get((u[j - size[j] : j], t)) or self.may_follow(u[j - size[j] : j], t))):
                low, ends = i - 1, []
                while low >= 0 and (t := u[low:i]) in endings:
                    if t in vocab:
                        ends.append(low)
                    low -= 1
                for j in reversed(ends):
                    if not j or follows.get((u[j - size[j] : j], u[j:i])) or self.may_follow(u[j - size[j] : j], u[j:i]):
                        break
                else:
                    raise ValueError(f"no encoding ends at byte {i} of a piece that begins {u[:100]!r}")
            count.append(count[j] + 1)
            size.append(i - j)

    def store(self, u: str, count: array) -> bytes | array:
        found = bytes(count.tolist()) if len(u) < 256 else count[:]
        if len(u) <= LONG:
            self.keep("words", u, found, 200 + (2 if len(u) < 256 else 5) * len(u))
        return found

    def piece(self, u: str) -> bytes | array:
        """Counts of the prefixes of a piece."""
        found = self.words.get(u)
        if found is None:
            count, size = array("i", [0]), array("i", [0])
            self.grow(u, count, size)
            found = self.store(u, count)
        return found

    def learn(self, runs: set[str]) -> dict[str, int]:
        """Counts of the tokens of runs that are words of Latin-1 letters, perhaps with marks after them.

        Words are worked out in alphabetical order: what two neighbours begin with is worked out once.
        """
        simple = {r: m.groups() for r in runs if (m := SIMPLE.fullmatch(r)) and self.first.isdisjoint(r)}
        words = {w: self.letters_of(w) for w, _ in simple.values()}
        last, count, size, many = "", array("i", [0]), array("i", [0]), {}
        for u in sorted(words.values()):
            found = self.words.get(u)
            if found is None:
                same, most = 0, min(len(u), len(last))
                while same < most and u[same] == last[same]:
                    same += 1
                del count[same + 1 :], size[same + 1 :]
                self.grow(u, count, size)
                found, last = self.store(u, count), u
            many[u] = found[-1]
        return {r: many[words[w]] + (self.piece(marks)[-1] if marks else 0) for r, (w, marks) in simple.items()}

    def letters_of(self, word: str) -> str:
        """A word of Latin-1 letters, perhaps after a blank, with a letter for each byte."""
        return word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def plain(self, run: str) -> list[int]:
        """Counts of the prefixes of a run without special tokens, by characters."""
        if m := SIMPLE.fullmatch(run):
            word, marks = m.groups()
            counts = self.piece(self.letters_of(word))
            if word.isascii():
                out = list(counts)
            else:
                out = [counts[e] for e in accumulate((1 if c < "\x80" else 2 for c in word), initial=0)]
            if marks:
                out = out + [out[-1] + c for c in self.piece(marks)[1:]]
            return out
        out, base = [0], 0
        for u, (a, b) in self.split(run):
            part = run[a:b]
            counts = self.piece(u)
            if part.isascii():
                own = list(counts[1:])
            else:
                own = [counts[e] for e in accumulate(len(c.encode()) for c in part)]
            if part in WHOLE:
                own[1] = 2
            out += [base + c for c in own]
            base += counts[-1]
        lead = LEAD.match(run).end()
        if lead > 1 and lead < len(run):
            out[: lead + 1] = self.plain(run[:lead])
        return out

    def table(self, run: str) -> list[int]:
        """Counts of the prefixes of ``run`` of 0, 1, 2 ... characters."""
        at, out = 0, [0]
        for m in self.special.finditer(run) if not self.first.isdisjoint(run) else ():
            own = self.plain(run[at : m.end()])
            base = out[-1]
            out += [base + c for c in own[1:-1]] + [base + self.plain(run[at : m.start()])[-1] + 1]
            at = m.end()
        if at < len(run):
            base = out[-1]
            out += [base + c for c in self.plain(run[at:])[1:]]
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """The runs of each text, and the count of tokens before each of them, then of all."""
        every = [RUN.findall(t) for t in texts]
        known, new = self.totals, {r for runs in every for r in runs}
        new = {r for r in new if r not in known}
        here = self.learn(new)
        here |= {r: self.table(r)[-1] for r in new if r not in here}
        for runs in every:
            counts = [known[r] if r in known else here[r] for r in runs]
            total = np.zeros(len(runs) + 1, dtype=np.int64)
            np.cumsum(counts, out=total[1:])
            yield runs, total
        for r, n in here.items():
            if len(r) <= LONG:
                self.keep("totals", r, n, 180 + 2 * len(r))

    def document(self, text: str) -> tuple[list[str], np.ndarray]:
        return next(iter(self.documents([text])))

    def fit(self, runs: list[str], total: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        k = int(np.searchsorted(total[:-1], budget)) - 1
        if k < 0:
            return 0
        if total[-1] <= budget:
            return sum(map(len, runs))
        own = self.table(runs[k])
        here = max((j for j, c in enumerate(own) if total[k] + c <= budget), default=0)
        return sum(map(len, runs[:k])) + here

    def steps(self, runs: list[str]) -> bytes:
        """The whole prefix table: differences of neighbouring counts, compressed."""
        diff = [np.diff(np.array(self.table(r))) for r in runs]
        return zlib.compress((np.concatenate(diff) if diff else np.zeros(0)).astype("<i4").tobytes(), 1)


def unpack_steps(data: bytes) -> np.ndarray:
    """Counts of the prefixes of 0, 1, 2 ... characters from a stored table."""
    diff = np.frombuffer(zlib.decompress(data), "<i4")
    return np.concatenate([[0], np.cumsum(diff, dtype=np.int64)])


def count_at(data: bytes, chars: int) -> int:
    return int(unpack_steps(data)[chars])


def fits(data: bytes, budget: int) -> int:
    return int(np.flatnonzero(unpack_steps(data) <= budget)[-1]) if budget >= 0 else 0


_TABLES: dict[str, PrefixTables] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, budget: int, store: bool) -> Iterator[pa.RecordBatch]:
    if path not in _TABLES:
        _TABLES[path] = PrefixTables(path)
    tables = _TABLES[path]
    for batch in batches:
        size, many, fit, kept = [], [], [], []
        raws = text_bytes(batch)
        for a, b in steps(raws):
            for raw, (runs, total) in zip(raws[a:b], tables.documents([(x or b"").decode() for x in raws[a:b]]), strict=True):
                size.append(len(raw or b""))
                many.append(int(total[-1]))
                fit.append(tables.fit(runs, total, budget))
                kept.append(tables.steps(runs) if store else None)
        arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        arrays += [pa.array(size, pa.int64()), pa.array(many, pa.int64()), pa.array(fit, pa.int64())]
        names += ["n_bytes", "n_tokens", "n_chars_in_budget"]
        if store:
            arrays.append(pa.array(kept, pa.binary()))
            names.append("prefix_table")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int = 512, store: bool = False) -> DataFrame:
    """Token counts of ``docs.text``; a map, without any shuffle.

    Adds n_bytes, n_tokens, n_chars_in_budget (characters of the longest prefix of
    at most ``budget`` tokens) and, with ``store``, prefix_table: the count at
    every prefix, to be read by ``count_at`` and ``fits``.
    """
    made = ["n_bytes", "n_tokens", "n_chars_in_budget", *(["prefix_table"] if store else [])]
    keep = docs.select(*[c for c in docs.columns if c != "text" and c not in made], F.col("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name != "text"]
    kinds = {"prefix_table": "binary"}
    schema = ", ".join(fields + [f"{c} {kinds.get(c, 'long')}" for c in made])
    return keep.mapInArrow(partial(_count, path=tokenizer, budget=budget, store=store), schema)
