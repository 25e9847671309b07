"""Exact byte-pair encoding and decoding by dynamic programming over prefixes (operator 12).

A byte-pair encoding is unique, and tokens in a row are one exactly when each two neighbours are.
So every prefix of a piece has one last token: the vocabulary entry that ends there and may follow
the last token of the prefix before it.  Which entries end at a place tells a *suffix automaton* of
the whole vocabulary: its state after some symbols is the longest ending that any entry holds, and
the entries among that ending's own endings hang on the state's suffix links.  Whether two tokens
may be neighbours tells a *pair test* that needs no encoding: walk down what the left token was
merged from along its right edge, and the right one along its left edge; the pair is broken when
two of these parts have a merge of their own that comes before either part was used up.  The ids
are read off by following the back pointers from the last prefix.

Pieces come from the vocabulary's own normaliser and splitter.  Both work on runs of characters
without white space one by one, so each distinct piece is encoded once per worker, as long as it is
remembered; what a worker remembers is bounded by bytes.  Both directions are maps without a shuffle.

Defined results: null text counts as empty and has no ids, which decode to an empty text; equal rows
give equal results; an empty table gives none; ids and other columns keep their types and are passed
through, unless they clash with a result's name; strings of special tokens inside a text become
their ids, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_letters, column, steps, text_bytes

#: Unicode white space, as the vocabulary's rules have it.
BLANKS = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[^{BLANKS}]+")
#: Bytes of a generation of the pieces that a worker remembers; it has two of them.
ROOM = 48 << 20
#: Pairs of tokens that a worker remembers.
PAIRS = 500_000
#: Pieces longer than this are not remembered.
LONG = 512
#: Runs of which any vocabulary with these rules makes a word and its marks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
#: Stands for the end of a word in strings of symbols.
END = "\n"
FOREVER = 1 << 40


class SuffixAutomaton:
    """Of several strings: states with transitions, suffix links, the length of a state's longest string and the entry that this is."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.long = [-1], [0]
        self.entry: dict[int, int] = {}
        for k, s in enumerate(strings):
            last = 0
            for c in s:
                last = self._extend(last, c)
            self.entry[last] = k  # an entry is the longest string of its state, since no other one ends where it does
        order = sorted(range(len(self.long)), key=self.long.__getitem__)
        self.above = [-1] * len(order)  # the next state on the suffix links that has an entry
        for v in order[1:]:
            up = self.link[v]
            self.above[v] = up if up in self.entry else self.above[up]

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of the state ``q`` for the strings that ``p`` leads to by ``c``."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.long.append(self.long[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: str) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.long[known] == self.long[last] + 1 else self._split(last, c, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.long.append(self.long[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.long[q] == self.long[p] + 1 else self._split(p, c, q)
        return new


class Codec:
    """One vocabulary of the tokenizers library: byte-pair merges with an end-of-word suffix, no decoder, blanks dropped."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, suffix = said["model"], said["model"].get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or said["decoder"] or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no byte-pair vocabulary with an end-of-word suffix and without a decoder")
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        ids: dict[str, int] = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = whole
            self.parts.setdefault(whole, (ids[a], ids[b]))
            self.rank.setdefault(whole, rank)
        self.pairs: dict[int, bool] = {}
        # an entry counts if its parts may stand side by side when nothing joins them earlier: else no encoding has it
        reached = {t: i for t, i in ids.items() if t not in added and (i in self.parts or len(t.removesuffix(suffix)) == 1) and self.reachable(i)}
        strings = list(reached)
        self.automaton = SuffixAutomaton([t.removesuffix(suffix) + END if t.endswith(suffix) else t for t in strings])
        self.token_of = [-1] * len(self.automaton.long)
        for v, k in self.automaton.entry.items():
            self.token_of[v] = reached[strings[k]]
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    # ------------------------------------------------------------ the pair test
    def edge(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The parts of ``token`` along one edge, each with the rank of the merge that uses it up."""
        used = FOREVER
        while True:
            yield token, used
            if token not in self.parts:
                return
            used = self.rank[token]
            token = self.parts[token][side]

    def apart(self, a: int, b: int, before: int = FOREVER) -> bool:
        """Whether no merge of rank below ``before`` joins parts of ``a`` and ``b`` across their border."""
        right = list(self.edge(b, 0))
        for x, x_used in self.edge(a, 1):
            for y, y_used in right:
                whole = self.merged.get((x, y))
                # of equal merges the left one is made first
                if whole is not None and self.rank[whole] < min(x_used, before) and self.rank[whole] <= y_used:
                    return False
        return True

    def reachable(self, token: int) -> bool:
        """Whether encoding what ``token`` spells gives it back."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.apart(a, b, self.rank[token]) and self.reachable(a) and self.reachable(b)

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.apart(a, b)
        return found

    # ------------------------------------------------------------ encoding
    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces as little-endian unsigned integers.

        Pieces go in alphabetical order, so the prefixes that two neighbours have in common are worked out once: of each
        prefix, as the beginning of something longer, are kept its last token, where that begins, and the automaton's state.
        """
        after, link, long, above = self.automaton.next, self.automaton.link, self.automaton.long, self.automaton.above
        token_of, pairs = self.token_of, self.pairs
        before, last, back, states, sizes = "", [-1], [0], [0], [0]
        out = {}
        for piece in sorted(pieces):
            n = len(piece)
            same, most = 0, min(len(last), n, len(before) + 1) - 1
            while same < most and before[same] == piece[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :], states[same + 1 :], sizes[same + 1 :]
            state, size = states[same], sizes[same]
            for i in range(same + 1, n + 1):
                c = piece[i - 1]
                for symbol in (c, END) if i == n else (c,):
                    while state and symbol not in after[state]:
                        state = link[state]
                        size = long[state]
                    state = after[state].get(symbol, 0)
                    size = size + 1 if state else 0
                # entries that end here, the longest first
                v = state if token_of[state] >= 0 and long[state] <= size else above[state]
                while v >= 0:
                    token, at = token_of[v], i - long[v] + (i == n)
                    if not at:
                        break
                    fits = pairs.get(last[at] << 20 | token)
                    if fits is None:
                        fits = self.may_follow(last[at], token)
                    if fits:
                        break
                    v = above[v]
                else:
                    raise ValueError(f"no encoding ends at byte {i} of a piece that begins {piece[:100]!r}")
                if i < n:
                    last.append(token)
                    back.append(at)
                    states.append(state)
                    sizes.append(size)
            before = piece
            ids = array("I", [token])
            while at:  # back from the end
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            out[piece] = (ids if sys.byteorder == "little" else np.array(ids, "<u4")).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        every = [self.runs(t) for t in texts]
        made: dict[str, list[str]] = {}
        for run in {r for runs in every for r in runs}:
            if m := PLAIN.fullmatch(run):  # what the rules do to it is plain to see
                word, marks = m[1].lower(), m[2]
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.letters)
                made[run] = [word, marks] if marks else [word]
            elif run not in self.added:
                made[run] = [u for u, _ in self.split(self.normalize(run))]
        young, old = self.young, self.old
        pieces: dict[str, bytes] = {}
        new: set[str] = set()
        for us in made.values():
            for u in us:
                if u not in pieces and u not in new:
                    found = young.get(u) or old.get(u)
                    if found is None:
                        new.add(u)
                    else:
                        pieces[u] = found
        pieces |= self.learn(new)
        self.remember(pieces)
        here = {run: pieces[us[0]] if len(us) == 1 else b"".join([pieces[u] for u in us]) for run, us in made.items()}
        here |= {run: np.array([i], dtype="<u4").tobytes() for run, i in self.added.items()}
        return [b"".join(map(here.__getitem__, runs)) for runs in every]

    def remember(self, pieces: dict[str, bytes]) -> None:
        """Keep what was asked for; it is forgotten after a generation in which nothing asks for it."""
        for u, ids in pieces.items():
            if len(u) <= LONG and u not in self.young:
                if self.held > ROOM:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[u] = ids
                self.held += 190 + len(u) + len(ids)

    def runs(self, text: str) -> list[str]:
        """The runs of a text; a special token's string is one of its own, which no other run equals."""
        if self.special is None or not self.special.search(text):
            return RUN.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*RUN.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + RUN.findall(text[at:])


class Names:
    """What ids stand for; without a decoder a text is its tokens with blanks between them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["decoder"]:
            raise ValueError(f"{path} has a decoder")
        self.names = {i: t.encode() for t, i in said["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in said["added_tokens"]}

    def decode(self, ids: bytes) -> bytes:
        """The text of ids; unknown ones are left out."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in names])


_HELD: dict[tuple[type, str], Codec | Names] = {}


def held(kind: type, path: str) -> Codec | Names:
    """A worker's only one for a vocabulary."""
    if (kind, path) not in _HELD:
        _HELD[kind, path] = kind(path)
    return _HELD[kind, path]


def _with(batch: pa.RecordBatch, without: str, made: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != without]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made.values()], names=[*(batch.schema.names[i] for i in kept), *made])


def _coded(batches: Iterator[pa.RecordBatch], path: str, text: str, back: bool) -> Iterator[pa.RecordBatch]:
    own, names = held(Codec, path), held(Names, path) if back else None
    for batch in batches:
        raws = text_bytes(batch, text)
        for a, b in steps(raws):
            ids = own.encode([(r or b"").decode() for r in raws[a:b]])
            made = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if back:
                made["decoded"] = pa.array(map(names.decode, ids), pa.binary()).cast(pa.string())
            yield _with(batch.slice(a, b - a), text, made)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    names = held(Names, path)
    for batch in batches:
        ids = column(batch, "ids")
        for a, b in steps(ids):
            texts = pa.array([None if x is None else names.decode(x) for x in ids[a:b]], pa.binary())
            yield _with(batch.slice(a, b - a), "", {"decoded": texts.cast(pa.string())})


def _schema(frame: DataFrame, without: set[str], made: str) -> tuple[DataFrame, str]:
    keep = frame.select(*[f"`{c}`" for c in frame.columns if c not in without])
    return keep, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + [made])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ids (binary, four little-endian bytes a token) and n_tokens in place of the text.

    ``back`` adds the text of those ids as decoded, from the same task.
    """
    made = ["ids binary", "n_tokens long", *(["decoded string"] if back else [])]
    keep, _ = _schema(docs, {m.split()[0] for m in made} - {text}, "")
    _, schema = _schema(keep, {text}, ", ".join(made))
    return keep.mapInArrow(partial(_coded, path=tokenizer, text=text, back=back), schema)


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """``coded`` with the text of its ids as decoded; null ids give null."""
    keep, schema = _schema(coded, {"decoded"}, "decoded string")
    return keep.mapInArrow(partial(_decode, path=tokenizer), schema)
