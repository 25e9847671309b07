"""Secrets by assignment-aware lexing (operator 3).

Source and configuration text is lexed into tokens (strings of all quotings, names, operators,
brackets, ends of lines with their indentation), from which pairs of a *name* and what it is
given are read: assignments of names, attributes, subscripts and tuples, annotated or not;
keyword arguments and pairs of arguments; keys of JSON, YAML (values on the next line and block
scalars too), INI and shell; elements and attributes of XML.  A value goes on to the end of its
statement, over brackets and continued lines, and holds string literals, unquoted words and the
names of others.  Constants propagate: a use means the last definition before it in the
innermost scope that has one, or else the next one after it, and sensitivity goes back from
sensitive names over all uses to a fixed point, so a literal reached through other names
(``x = "..."; password = x``) is found where it stands.  Literals are scored by how sensitive
the names are that they reach, and how random they look.  Arguments of calls are no part of a
value, except of calls that only convert; text of comments is lexed as any other.

Three fixed kinds of base findings are always reported; lexing adds ``literal``
findings outside them:

* assign: a sensitive name, ``:`` or ``=``, and a value of 6 or more characters
* access: ``AKIA`` and capitals or digits, 20 or more characters in all
* hex: a run of 24 or more lower-case hexadecimal digits

Spans are code points, the end exclusive.  Defined results: null text counts as
empty and has no findings; long texts are scanned whole; equal rows give equal
results; ids keep their type; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much each part of a target's name says that its value is secret.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "secretkey": 1.0, "authkey": 0.9, "bearer": 0.8}
#: Parts that say the value is about a secret rather than one.
NAME_DISCOUNTS = {"url": 0.5, "uri": 0.5, "path": 0.5, "file": 0.5, "field": 0.5, "name": 0.5, "type": 0.6, "length": 0.7, "count": 0.7, "hint": 0.5, "policy": 0.5, "expiry": 0.7, "ttl": 0.7}
#: Values that stand for a secret to be filled in.
PLACEHOLDERS = {"password", "passwd", "changeme", "example", "placeholder", "redacted", "undefined", "default", "secret", "required", "string", "process.env", "os.environ"}
#: No sensitive name is without one of these.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")

TOKEN = re.compile(
    r"""(?P<triple>[rRbBuUfF]{0,2}(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''))
    |(?P<str>[rRbBuUfF]{0,2}"(?:[^"\\\n]|\\.)*"|(?:[rRbBuUfF]{1,2}|(?<!\w))'(?:[^'\\\n]|\\.)*'|`[^`]*`)
    |(?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|(?P<op>:=|=>|->|[=!<>]=|\+=|[=:+])
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<end>;)|(?P<nl>\\?\r?\n[\x20\t]*)|(?P<other>\S)""",
    re.ASCII | re.VERBOSE,
)
QUOTE = re.compile(r"""[rRbBuUfF]{0,2}(\"{3}|'{3}|["'`])""")
#: What an unquoted value goes on over.
BARE = re.compile(r"""[^\s"'`,;+(){}\[\]]+""")
#: What stands before a line's first word; the marks of lists count.
MARGIN = re.compile(r"[\x20\t]*(?:-[\x20\t]+)*")
LINE = re.compile(r"\n([\x20\t]*)([^\n]*)")
KEY = re.compile(r"[A-Za-z_$][\w$.-]*", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z][\w:.-]*)(?:\s[^<>]*)?>([^<>]+)</")
TAG = re.compile(r"<[A-Za-z][^<>]*>([^<>]*)")
ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
ASSIGNS = {"=", ":", ":=", "=>", "+="}
DECLARES = {"let", "var", "const", "val", "local", "my", "auto"}
#: Calls whose arguments are still the value.
CONVERTS = {"str", "bytes", "string", "bytearray", "encode", "decode", "b64decode", "strip", "trim", "concat", "join"}
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
THRESHOLD = 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, leftmost and apart within a kind."""
    low = text.lower() if any(c in text for c in "=:") else ""
    found = []
    if low and any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    parts = [p.lower() for p in CAMEL.findall(name)]
    both = [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]
    score = max((NAME_WEIGHTS.get(p, 0.0) for p in both), default=0.0)
    return score * min([1.0, *(NAME_DISCOUNTS.get(p, 1.0) for p in parts)])


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1: how much a value looks like a secret rather than a word or a gap to fill."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or value[0] in "<$%{" or len(set(value)) < 4:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if not quoted and not mixed:
        return 0.0
    return min(1.0, bits / 3.0)


class Source:
    """The tokens of a text, what bracket each stands in, and its scope."""

    def __init__(self, text: str):
        self.text, self.kind, self.at = text, [], []
        for m in TOKEN.finditer(text):
            self.kind.append("str" if m.lastgroup == "triple" else m.lastgroup)
            self.at.append(m.span())
        n = len(self.kind)
        self.starts = [a for a, _ in self.at]
        self.line_at = [0] + [m.end() for m in re.finditer("\n", text)]
        self.pair = self.pairs()
        for i, kind in enumerate(self.kind):
            if kind in ("open", "close") and i not in self.pair:
                self.kind[i] = "other"  # a bracket without its partner opens and closes nothing
        self.inside, self.scope, self.parent = [-1] * n, [0] * n, [-1]
        self.span = [[0, n]]  # the tokens of each scope
        self.taken: set[int] = set()  # colons of conditional expressions
        self.run = (0, 0)  # the last run of characters that an unquoted value goes on over
        stack: list[int] = []
        scopes: list[tuple[str, int, int]] = [("all", -1, 0)]  # how it ends, by what, its number
        waiting = None  # the indentation of a ``def`` whose body has not begun

        def begin(how: str, what: int, i: int) -> None:
            self.parent.append(scopes[-1][2])
            self.span.append([i, n])
            scopes.append((how, what, len(self.parent) - 1))

        def end(i: int) -> None:
            self.span[scopes.pop()[2]][1] = i

        for i, kind in enumerate(self.kind):
            if kind == "nl" and not stack or (kind == "nl" and self.word(stack[-1]) == "{"):
                deep, after = self.indent(i), self.kind[i + 1] if i + 1 < n else "nl"
                if after != "nl":
                    while scopes[-1][0] == "indent" and deep <= scopes[-1][1]:
                        end(i)
                    if waiting is not None and deep > waiting:
                        begin("indent", waiting, i)
                    waiting = None
            elif kind == "close":
                opened = stack.pop()
                while scopes[-1][0] == "indent" and scopes[-1][2] and self.span[scopes[-1][2]][0] > opened:
                    end(i)
                if scopes[-1][0] == "brace" and scopes[-1][1] == opened:
                    end(i)
            self.inside[i], self.scope[i] = stack[-1] if stack else -1, scopes[-1][2]
            if kind == "open":
                before = self.kind[i - 1] if i else "nl"
                if self.word(i) == "{" and (before == "close" or before == "name" and (i < 2 or self.kind[i - 2] != "op")):
                    begin("brace", i, i)
                stack.append(i)
            elif kind == "name" and self.word(i) in ("def", "class"):
                waiting = self.indent_of_line(i)
        # where what stands at a token ends at the latest: the next comma or end in its bracket, or the bracket's own end
        self.stop, coming = [n] * n, {}
        for i in range(n - 1, -1, -1):
            if self.kind[i] in ("comma", "end"):
                coming[self.inside[i]] = i
            elif self.kind[i] == "close":
                coming[self.pair[i]] = i
            self.stop[i] = coming.get(self.inside[i], n)

    def pairs(self) -> dict[int, int]:
        """Partners of brackets.  A closing one takes the last open one of its kind; those opened since then have none."""
        out: dict[int, int] = {}
        stack: list[int] = []
        waiting = Counter()
        for i, kind in enumerate(self.kind):
            if kind == "open":
                stack.append(i)
                waiting[self.word(i)] += 1
            elif kind == "close":
                opens = "([{"[")]}".index(self.word(i))]
                if waiting[opens]:
                    while self.word(stack[-1]) != opens:
                        waiting[self.word(stack.pop())] -= 1
                    waiting[opens] -= 1
                    out[i] = stack.pop()
                    out[out[i]] = i
        return out

    def word(self, i: int) -> str:
        return self.text[slice(*self.at[i])]

    def indent(self, i: int) -> int:
        """The indentation after the end of line ``i``."""
        return len(self.word(i).rpartition("\n")[2])

    def indent_of_line(self, i: int) -> int:
        """Where the first word of the line that token ``i`` stands in begins."""
        start = self.line_at[bisect_right(self.line_at, self.at[i][0]) - 1]
        return MARGIN.match(self.text, start).end() - start

    def bare(self, j: int) -> tuple[int, int]:
        """The end of the unquoted value that begins with token ``j``, and its last token: up to a blank or quote, or a pair of its own."""
        a, n = self.at[j][0], len(self.kind)
        if not self.run[0] <= a < self.run[1]:
            m = BARE.match(self.text, a)
            self.run = (a, m.end() if m else a)
        end = self.run[1]
        while j + 1 < n and self.at[j + 1][1] <= end:
            if self.kind[j + 1] == "op" and self.word(j + 1) in ASSIGNS and self.is_(j, "name") and self.at[j + 1][1] < end and self.at[j][0] > a:
                return self.at[j][0], j - 1
            j += 1
        return end, j

    def content(self, i: int) -> tuple[int, int]:
        """A string without its quotes."""
        a, b = self.at[i]
        quote = QUOTE.match(self.text, a)
        return quote.end(), max(quote.end(), b - len(quote[1]))

    def is_(self, i: int, kind: str, words: str | set[str] | None = None) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == kind and (words is None or self.word(i) in ({words} if isinstance(words, str) else words))

    def key(self, i: int) -> str | None:
        """The name that token ``i`` is or spells."""
        if self.is_(i, "name"):
            return self.word(i)
        if self.is_(i, "str"):
            said = self.text[slice(*self.content(i))]
            return said if KEY.fullmatch(said) else None
        return None

    def target(self, i: int) -> tuple[str, int] | None:
        """The name that ends before token ``i``, and the token it begins with."""
        if self.is_(i - 1, "close", "]") and i - 1 in self.pair:
            opened = self.pair[i - 1]
            if self.is_(opened - 2, "op", ":") and (k := self.key(opened - 3)):  # a type with arguments
                return k, opened - 3
            base, k = self.key(opened - 1), self.key(opened + 1) if opened + 3 == i else None
            return (f"{base}.{k}", opened - 1) if base and k else None
        if (k := self.key(i - 1)) is None:
            return None
        if self.is_(i, "op", "=") and self.is_(i - 2, "op", ":") and self.is_(i - 1, "name") and (named := self.key(i - 3)):  # annotated
            return named, i - 3
        return k, i - 1

    def targets(self, i: int) -> list[tuple[str, int]]:
        """The names that the operator ``i`` gives something to; several for a tuple."""
        last = self.target(i)
        if last is None:
            return []
        out = [last]
        if self.is_(i, "op", {"=", ":="}) and (self.inside[i] < 0 or self.is_(self.inside[i], "open", "{")):
            while self.is_(out[0][1] - 1, "comma") and (before := self.target(out[0][1] - 1)):
                out.insert(0, before)
        return out

    def values(self, i: int, many: int) -> list[list[tuple]]:
        """What follows the operator ``i``, in ``many`` parts: literals (start, end, quoted) and names (name, from where it is looked up, start, end)."""
        text, n, j, parts = self.text, len(self.kind), i + 1, [[]]
        loose = self.inside[i] < 0 or self.is_(self.inside[i], "open", "{")  # a line ends what stands here
        entered: list[int] = []
        fresh, asked = True, 0  # whether an operand may begin; question marks that wait for their colons
        if self.is_(j, "other", {"|", ">"}) and self.is_(i, "op", ":"):
            while j < n and self.kind[j] != "nl" and self.word(j) in "|>-+0123456789":
                j += 1
            if self.is_(j, "nl"):
                return [[self.block(j, self.indent_of_line(i))]] + [[]] * (many - 1)
            j = i + 1
        while j < n:
            kind = self.kind[j]
            if kind == "nl":
                if self.word(j)[0] != "\\" and loose and not entered:
                    after = j + 1
                    while self.is_(after, "nl"):
                        after += 1
                    deeper = after < n and self.indent(after - 1) > self.indent_of_line(i)
                    # a value may begin on the next line, unless that is a pair of its own
                    begins = j == i + 1 and deeper and not self.is_(after, "other", "-") and not (self.key(after) and self.is_(after + 1, "op", ASSIGNS))
                    if not begins and not self.is_(j - 1, "op", "+") and not self.is_(after, "op", "+") and not (deeper and self.is_(after, "other", {"?", "|", "&", "."})):
                        break
                    j = after
                else:
                    j += 1
                continue
            if kind == "end" or kind == "close" and not entered:
                break
            if kind == "comma" and not entered:
                if len(parts) >= many:
                    break
                parts.append([])
                fresh = True
            elif kind == "close":
                entered.pop()
            elif kind == "open":
                before = self.kind[j - 1] if j > i + 1 else "op"
                called = before == "name" and self.word(j) == "(" and self.word(j - 1).lower().rpartition(".")[2] in CONVERTS
                if self.word(j) == "{" or before in ("name", "close", "str") and not called:
                    j = self.pair.get(j, n)
                else:
                    entered.append(j)
                    fresh = True
            elif kind == "str":
                if not (self.is_(j + 1, "op", ASSIGNS - {":"}) or entered and self.is_(j + 1, "op", ":")):
                    parts[-1].append((*self.content(j), True))
                fresh = False
            elif kind == "name":
                a, b = self.at[j]
                if fresh and not entered and b < len(text) and text[b] not in "=:?<>!" and BARE.match(text, b, b + 1):
                    end, j = self.bare(j)
                    parts[-1].append((a, end, False))
                elif self.is_(j + 1, "open", "(") and self.at[j + 1][0] == b:
                    pass  # a call
                elif self.is_(j + 1, "open", "[") and self.at[j + 1][0] == b:
                    k = self.key(j + 2) if self.is_(j + 3, "close", "]") else None
                    parts[-1].append((f"{self.word(j)}.{k}" if k else self.word(j), i, a, a))
                else:
                    parts[-1].append((self.word(j), i, a, b if fresh else a))
                fresh = False
            elif kind == "other" and fresh and not entered and BARE.match(text, self.at[j][0], self.at[j][1]):
                a = self.at[j][0]
                end, j = self.bare(j)
                parts[-1].append((a, end, False))
                fresh = False
            elif kind == "other" and self.word(j) == "?":
                asked, fresh = asked + 1, True
            elif kind == "op":
                if self.word(j) == ":" and asked:
                    self.taken.add(j)
                    asked -= 1
                elif self.word(j) in ASSIGNS:  # a pair of its own; what it defines is the value of this one too
                    if entered:
                        if targets := self.targets(j):
                            parts[-1] += [(name, j + 1, 0, 0) for name, _ in targets]
                            j = self.stop[j]
                            fresh = True
                            continue
                    else:
                        if self.word(j) != ":" and parts[-1] and len(parts[-1][-1]) == 4:
                            name = parts[-1].pop()
                            parts[-1].append((name[0], j + 1, 0, 0))
                        break
                fresh = self.word(j) in ("+", ":")
            j += 1
        return parts + [[]] * (many - len(parts)) if len(parts) > 1 or many == 1 else parts * many

    def block(self, j: int, indent: int) -> tuple[int, int, bool]:
        """The lines after the end of line ``j`` that stand deeper than ``indent``."""
        start = end = self.at[j][0]
        for m in LINE.finditer(self.text, start):
            if m[2].strip():
                if len(m[1]) <= indent:
                    break
                start, end = start if end > self.at[j][0] else m.start(2), m.end(2)
        return start, end, True


class Flow:
    """Definitions of names, by scope and place, and what each is made of."""

    def __init__(self, source: Source):
        self.source = source
        self.scores: list[float] = []
        self.literals: list[list[tuple[int, int, bool]]] = []
        self.uses: list[list[tuple[str, int, int, int]]] = []
        self.known: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
        self.homes: dict[str, list[int]] = defaultdict(list)  # the scopes that define a name

    def chain(self, name: str, scope: int) -> Iterator[int]:
        """The scopes around ``scope`` that define ``name``, the innermost first."""
        homes = self.homes.get(name, ())
        if len(homes) > 8:
            while scope >= 0:
                if (scope, name) in self.known:
                    yield scope
                scope = self.source.parent[scope]
        else:
            at, _ = self.source.span[scope]
            yield from sorted((h for h in homes if h == scope or h < scope and self.source.span[h][0] <= at < self.source.span[h][1]), reverse=True)

    def define(self, name: str, token: int, first: int, value: list[tuple]) -> None:
        s = self.source
        home = s.scope[first]
        declared = s.is_(first - 1, "name") or s.is_(first, "str")
        if not declared and home and not s.is_(first - 1, "name", DECLARES):
            outer = next(self.chain(name, home), home)
            # in braces a name without a declaration is the outer one
            opened = s.inside[first]
            home = outer if opened >= 0 and s.is_(opened, "open", "{") else home
        version = len(self.scores)
        self.scores.append(name_score(name))
        self.literals.append([x for x in value if len(x) == 3])
        uses = [x for x in value if len(x) == 4]
        if s.is_(token, "op", "+="):
            uses.append((name, token, 0, 0))
        self.uses.append(uses)
        if (home, name) not in self.known:
            self.known[home, name] = ([], [])
            self.homes[name].append(home)
        places, versions = self.known[home, name]
        places.append(token)
        versions.append(version)

    def meant(self, name: str, token: int) -> int | None:
        """The version of ``name`` that a use means: the last one given before ``token``, or else the next."""
        later = None
        for scope in self.chain(name, self.source.scope[min(token, len(self.source.scope) - 1)]):
            places, versions = self.known[scope, name]
            i = bisect_left(places, token)
            if i:
                return versions[i - 1]
            if later is None:
                later = versions[0]
        return later

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        made: list[list[int]] = []
        for i, uses in enumerate(self.uses):
            made.append([])
            for name, token, a, b in uses:
                version = self.meant(name, token)
                if version is not None and version != i:
                    made[i].append(version)
                elif version is None and b > a:
                    self.literals[i].append((a, b, False))  # a word that nothing defines
        queue = [(-score, i) for i, score in enumerate(self.scores) if score]
        heapq.heapify(queue)
        while queue:  # the most sensitive first, so each version is settled once
            score, i = heapq.heappop(queue)
            if -score < self.scores[i]:
                continue
            for e in made[i]:
                if self.scores[e] < -score:
                    self.scores[e] = -score
                    heapq.heappush(queue, (score, e))
        looks: dict[tuple[int, int, bool], float] = {}
        for score, literals in zip(self.scores, self.literals, strict=True):
            for x in literals if score else ():
                if x not in looks:
                    looks[x] = literal_score(text[x[0] : x[1]], x[2])
                if score * looks[x] >= THRESHOLD:
                    yield x[0], x[1]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, by assignment or through constants."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    source = Source(text)
    flow = Flow(source)
    for i, kind in enumerate(source.kind):
        if kind == "op" and source.word(i) in ASSIGNS and i not in source.taken:
            if targets := source.targets(i):
                for (name, first), value in zip(targets, source.values(i, len(targets)), strict=True):
                    flow.define(name, i, first, value)
        elif kind == "comma" and source.is_(i - 1, "str") and source.is_(i + 1, "str") and source.is_(source.inside[i], "open", "("):
            # a name and a value as neighbouring arguments
            if (source.is_(i - 2, "open") or source.is_(i - 2, "comma")) and (source.is_(i + 2, "close") or source.is_(i + 2, "comma")) and (k := source.key(i - 1)):
                flow.define(k, i, i - 1, [(*source.content(i + 1), False)])
    found = set(flow.found(text))
    if "<" in text:
        for m in ELEMENT.finditer(text):
            a, b = m.start(2) + len(m[2]) - len(m[2].lstrip()), m.start(2) + len(m[2].rstrip())
            if name_score(m[1]) * literal_score(text[a:b], True) >= THRESHOLD:
                found.add((a, b))
        for m in TAG.finditer(text):
            said = {x[1].lower(): x.span(2) if x[2] is not None else x.span(3) for x in ATTRIBUTE.finditer(text, m.start(), m.start(1))}
            if named := said.get("key") or said.get("name"):
                a, b = said.get("value") or m.span(1)
                if name_score(text[slice(*named)]) * literal_score(text[a:b], True) >= THRESHOLD:
                    found.add((a, b))
    return sorted(found)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base findings of ``text``, and all findings in order."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], [-1, *accumulate((e for _, _, e in base), max)]
    added = [(a, 3, b) for a, b in lexed_spans(text) if reach[bisect_right(starts, a)] < b]
    return base, sorted(base + added)


def show(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many, sums, shown = ([], [], []), [], []
        for text in column(batch, "text"):
            base, every = spans(text or "")
            for k in range(3):
                many[k].append(sum(1 for s in base if s[1] == k))
            sums.append(hashlib.sha256(show(base).encode()).hexdigest())
            shown.append(show(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in many), pa.array(sums, pa.string()), pa.array(shown, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Findings in each row of ``docs`` (doc_id, text); a map, without any shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; nulls stay null."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in column(batch, "text"):
                at, parts = 0, []
                for a, _, b in spans(text)[1] if text else ():
                    if b > at:
                        parts += [text[at : max(a, at)], mark] if a >= at else []
                        at = b
                out.append(text if text is None else "".join([*parts, text[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(rewrite, docs.schema)
