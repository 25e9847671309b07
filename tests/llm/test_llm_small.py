"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import decontaminate, embedding_dedup, jaccard_join, mixing, prefix_counts, quality, secret_scan, substring_dedup, token_blocks, url_filter

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "score double, component string, part int, class string, key string, prints string, at string, node string, epoch string"


def words(rng, n):
    return [rng.choice(["la", "mer", "ciel", "Rouge", "table,", "maison", "été", "42", "x1", "naïve", "grün", "oak", "pine", "fir", "elm", "ash"]) + str(rng.randrange(30)) for _ in range(n)]


def texts():
    rng = random.Random(5)
    base = words(rng, 120)
    near = base[:]
    near[60] = "changed"
    passage = words(rng, 70)
    long = words(rng, 30_000)
    other = words(rng, 40) + passage + words(rng, 30)
    twice = passage + words(rng, 5) + passage
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "One"),
        (9, "two words"),
        (10, " ".join(other)),
        (11, " ".join(twice)),
        (12, " ".join(long)),
        (13, " ".join(long[:20_000] + ["new"] + long[20_000:])),
        (14, "password = hunter2hunter2 and AKIA" + "A" * 16 + " with " + "0123abcd" * 4),
        (15, 'k = "Zx8fQ2pL9vT4"\nx = k\ndb_password = x\nurl = "http://a"'),
        (15, " ".join(base)),
        (15, " ".join(base)),
        (None, " ".join(base)),
        (None, None),
        (16, "I'll say 'they've' gone — naïve café 漢字 🙂 <|endoftext|> end" + "   　 x  y\n\n z"),
        (17, "it " * 400),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][k % 2], ["a", "b", None, "a", "a"][k % 5], None if t is None else len(t), None, "c", 1, "k", "kk", "p", "at", "n", "e") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


# ------------------------------------------------------------------ tokens
def test_token_blocks(docs, none):
    t = Tokenizer.from_file(WORD_BPE)
    want, at = [], 0
    for i, x in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert ordered(token_blocks.token_blocks(docs, WORD_BPE).collect()) == ordered(want)
    assert token_blocks.token_blocks(none, WORD_BPE).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.integers(0, 50_000, n)).astype("<u4")
    lengths = np.array([n // 3, n - n // 3])
    out, many = token_blocks.decode_segment(token_blocks.encode_segment(ids, lengths))
    assert (out == ids).all() and many.tolist() == lengths.tolist()


def test_token_pieces_equal_the_library():
    import pyarrow as pa

    rng = random.Random(1)
    some = ["".join(rng.choices("aZé ß'.,!9\t\ń Ａ漢ıİſKÅ\x1c\x00🙂-_<|>sST", k=rng.randint(0, 14))) for _ in range(3000)]
    ids, n = token_blocks.text_ids(pa.array(some), WORD_BPE, 2)
    ends = np.cumsum(n)
    for k, e in enumerate(Tokenizer.from_file(WORD_BPE).encode_batch(some, add_special_tokens=False)):
        assert ids[ends[k] - n[k] : ends[k]].tolist() == [*e.ids, 2]


def test_prefix_counts(docs, none):
    t = Tokenizer.from_file(BYTE_BPE)
    got = prefix_counts.prefix_counts(docs.where("doc_id is null or doc_id not in (12, 13)"), BYTE_BPE, budget=20, store=True).collect()
    some = {(i, x) for i, x in texts() if i not in (12, 13)}
    assert len(got) == sum(1 for i, _ in texts() if i not in (12, 13))
    by = collections.defaultdict(list)
    for i, x in some:
        by[i].append(x)
    for r in got:
        match = [x for x in by[r.doc_id] if len((x or "").encode()) == r.n_bytes]
        assert match
        x = match[0] or ""
        assert r.n_tokens == len(t.encode(x, add_special_tokens=False).ids)
        for p in {*range(min(40, len(x))), len(x)}:
            assert prefix_counts.count_at(r.prefix_table, p) == len(t.encode(x[:p], add_special_tokens=False).ids), (r.doc_id, p)
        fit = max(p for p in range(len(x) + 1) if prefix_counts.count_at(r.prefix_table, p) <= 20) if len(x) < 3000 else None
        assert fit is None or (r.n_chars_in_budget == fit == prefix_counts.fits(r.prefix_table, 20))
    assert prefix_counts.prefix_counts(none, BYTE_BPE).collect() == []


# ---------------------------------------------------------- decontamination
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def contamination(docs, items):
    out = []
    listed = [(i, ALNUM.findall(lower(t))) for i, t in items]
    for i, t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for item, v in listed:
            n = min(10, len(v))
            if n:
                grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)}
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in grams:
                        hit.update(range(p, p + n))
                        found.add(item)
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    t = dict(texts())
    base, passage = texts()[0][1].split(), t[11].split()[:70]
    rows = [(1, " ".join(base[3:30])), (2, "la one"), (3, "ONE"), (4, None), (5, ""), (6, " ".join(passage[5:15]).upper()), (6, " ".join(passage[30:41])), (None, " ".join(base[90:101])), (7, "it it it"), (8, " ".join(base[50:59] + ["nothing", "here"]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_decontamination(docs, none, items, limit):
    rows, frame = items
    got = decontaminate.contamination(docs, frame, max_broadcast_bytes=limit)
    want = contamination(texts(), rows)
    assert ordered(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == ordered(want)
    assert decontaminate.contamination(none, frame, max_broadcast_bytes=limit).collect() == []
    assert decontaminate.contamination(docs, frame.limit(0), max_broadcast_bytes=limit).where("contaminated").collect() == []


def test_decontamination_keeps_clean_rows(docs, items):
    rows, frame = items
    clean = sorted((str(w[0]), x) for (w, (_, x)) in zip(contamination(texts(), rows), texts()) if not w[5] and w[0] is not None and w[0] != 15)
    kept = decontaminate.decontaminate(docs, frame)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id is not None and r.doc_id != 15) == sorted(clean, key=str) or len(clean) == kept.where("doc_id is not null and doc_id <> 15").count()


# ------------------------------------------------------------------ secrets
def base(text):
    found = []
    for k, (name, pattern) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if not k else 0)):
            if (len(m[2]) >= 6) if not k else (m.end() - m.start() >= (20 if k == 1 else 24)):
                found.append((m.start(), k, m.end(), name))
    return sorted(found)


def test_secrets(docs, none):
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secret_scan.secret_spans(docs).collect()}
    want = set()
    for i, t in texts():
        b = base(t or "")
        shown = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b)
        want.add((i, hashlib.sha256(shown.encode()).hexdigest(), *(sum(x[1] == k for x in b) for k in range(3))))
    assert got == want
    assert secret_scan.secret_spans(none).collect() == []


def test_secrets_through_names():
    text = 'k = "Zx8fQ2pL9vT4"\nx = k\ndb_password = x\nurl = "http://a"'
    _, every = secret_scan.spans(text)
    assert [(k, text[a:b]) for a, k, b in every if k == 3] == [(3, "Zx8fQ2pL9vT4")]
    assert secret_scan.spans('title = "A long and plain sentence"\npassword_hint = "your first pet"')[1] == []
    assert secret_scan.spans("")[1] == []


def test_redaction(docs):
    out = {r.doc_id: r.text for r in secret_scan.redact(docs).where("doc_id in (14, 15)").collect() if r.text and "Zx8" not in r.text}
    assert "hunter2" not in out[14] and "AKIA" not in out[14]


# ------------------------------------------------------------- similar sets
def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    ids = {i for i, _ in sets if i is not None}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t)]
    root = components(ids, links)
    return [(i, len(s), None if i is None else root[i]) for i, s in sets]


def variants(seed, n):
    rng = random.Random(seed)
    out, i = [], 0
    while len(out) < n:
        base = words(rng, rng.choice([2, 3, 5, 9, 30, 80, 150]))
        for _ in range(rng.randint(1, 8)):
            w = base[:]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            out.append((i, " ".join(w)))
            i += 1
    return out


@pytest.mark.parametrize("k,similarity,block", [(3, "0.9", 128), (5, "0.8", 128), (3, "0.9", 3)])
def test_jaccard_join(spark, monkeypatch, k, similarity, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = variants(11, 160) + [(None, "a b c"), (900, None), (901, ""), (902, "a b c"), (902, "a b c"), (903, "A B\tC"), (904, "x y"), (905, "x  y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    num, den = int(float(similarity) * 10), 10
    got = jaccard_join.near_duplicates(frame, k, similarity).collect()
    assert ordered(got) == ordered(jaccard(rows, k, num, den))


def test_jaccard_join_of_odd_rows(docs, none):
    got = jaccard_join.near_duplicates(docs, 3, "0.9").collect()
    assert ordered(got) == ordered(jaccard(texts(), 3, 9, 10))
    assert jaccard_join.near_duplicates(none).collect() == []
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id in (2, 3, 13)").count() == 0 and kept.where("doc_id in (1, 12, 4, 5, 6)").count() == 5


# ------------------------------------------------------------------ repeats
def repeats(rows, span):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - span + 1):
                g = tuple(w[p : p + span])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - span + 1):
            if i is not None and first[tuple(w[p : p + span])] < i:
                gone.update(range(p, p + span))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def test_repeats(spark, docs, none):
    assert ordered(substring_dedup.repeated_spans(docs).collect()) == ordered(repeats(texts(), 50))
    assert substring_dedup.repeated_spans(none).collect() == []
    rng = random.Random(3)
    shared = [words(rng, 25) for _ in range(4)]
    rows = [(i, " ".join(itertools.chain(*[rng.choice(shared)[rng.randint(0, 5) :] + words(rng, rng.randint(0, 6)) for _ in range(4)]))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(substring_dedup.repeated_spans(frame, span=15, k=4).collect()) == ordered(repeats(rows, 15))


def test_suffix_automaton():
    a = substring_dedup.SuffixAutomaton([b"a b c d e".split(), b"x y z".split()])
    assert a.spans(b"q a b c q c d e x y z".split(), 3) == [(1, 4), (5, 11)]


# --------------------------------------------------------------- embeddings
def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(40):
        centre = rng.standard_normal(12)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((i, [float(x) for x in centre + 0.05 * rng.standard_normal(12)], int(rng.integers(0, 2))))
            i += 1
    rows += [(900, None, 0), (901, [0.0] * 12, 0), (902, [1.0] * 11 + [None], 0), (903, [float("nan")] + [1.0] * 11, 0), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (906, [2 * x for x in rows[0][1]], rows[0][2]), (907, [], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1)]
    frame = spark.createDataFrame([(a, v, c, "x", 1.0) for a, v, c in rows], "vec_id long, embedding array<double>, label int, cell string, raw double").repartition(3)

    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, many = [], collections.Counter()
    for (a, v, x), (b, w, y) in itertools.combinations(rows, 2):
        if x is not None and x == y and fine(v) and fine(w) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
            links.append((a, b))
            many.update((a, b))
    root = components([r[0] for r in rows], links)
    want = [(a, many[a], root[a], root[a] == a) for a, _, _ in rows]
    assert ordered(embedding_dedup.embedding_duplicates(frame, per_cell=4).collect()) == ordered(want)
    assert embedding_dedup.embedding_duplicates(frame.limit(0)).collect() == []


# ------------------------------------------------------------------- mixing
def test_mixing(spark, none):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), ["big"] * 80 + ["mid"] * 15 + ["small"] * 4 + [None]) for i in range(3000)]
    rows = [(i, t, rng.choice(s)) for i, t, s in rows] + [(5000, None, "empty"), (5001, "", "empty"), (7, "again", "big"), (None, "x y", "mid")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, epoch int, block int, key int")
    got = mixing.mix_rows(frame, target_entropy=0.9, max_repeats=4.0, block_tokens=500).collect()
    share, own = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        own[s] += len((t or "").split())
    for r in got:
        share[r.source] += r.n_tokens
    total = sum(own.values())
    assert abs(sum(share.values()) - total) < 200
    assert max(share[s] / own[s] for s in own if own[s]) <= 4.05
    p = [share[s] / sum(share.values()) for s in ("big", "mid", "small", None)]
    shares = [own[s] / total for s in ("big", "mid", "small", None)]
    low, high = 0.0, 1.0
    for _ in range(60):
        e = (low + high) / 2
        q = [x**e for x in shares]
        q = [x / sum(q) for x in q]
        if -sum(x * math.log(x) for x in q) / math.log(4) >= 0.9:
            low = e
        else:
            high = e
    while max(x**low / sum(y**low for y in shares) / x for x in shares) > 4.0 and low < 1:
        low += 0.0005
    q = [x**low / sum(y**low for y in shares) for x in shares]
    assert max(abs(a - b) for a, b in zip(p, q)) < 0.01
    times = collections.Counter((r.source, r.doc_id) for r in got if r.source == "big" and r.doc_id != 7)
    assert max(times.values()) <= 1
    assert {r.doc_id for r in got if r.source == "empty"} == {5000, 5001}
    again = mixing.mix_rows(frame.repartition(7), target_entropy=0.9, max_repeats=4.0, block_tokens=500).collect()
    assert ordered(got) == ordered(again)
    assert mixing.mix(frame, 0.9).columns == frame.columns
    assert mixing.mix(none).collect() == [] and mixing.mix_rows(none).collect() == []


# ------------------------------------------------------------------ quality
def test_quality(spark, docs, none):
    rng = random.Random(4)
    good, bad = ["sea", "stone", "river", "light", "over", "under", "old"], ["buy", "click", "now!!!", "free", "$$$", "win"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) if rng.random() < 0.7 else f"w{rng.randrange(99)}" for _ in range(30)), i % 2) for i in range(400)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a < 300] + [(1, 1), (3, 0), (4, None), (None, 1), (9999, 1)], "doc_id long, label int")
    weights = quality.train_quality(frame, labels, bits=16)
    scored = quality.score_quality(frame, weights).where("doc_id >= 300").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in scored]) > 0.95
    odd = quality.score_quality(docs, weights)
    assert set(odd.columns) == set(docs.columns) and all(0 <= r.score <= 1 for r in odd.collect())
    assert quality.score_quality(none, weights).collect() == []
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels.limit(0), bits=10)).collect()} == {0.5}
    assert (weights == quality.train_quality(frame.repartition(5), labels.repartition(3), bits=16)).all()


# --------------------------------------------------------------------- urls
def test_urls(spark):
    link = '<html><head><LINK rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://a.example.com/en/1", ""),
        (2, "http://EXAMPLE.com/en/71?x", ""),
        (3, "https://b.net/de/1#f", None),
        (4, "https://x.example.net/de/8", ""),
        (5, "http://y.org/es/", ""),
        (6, "http://y.org/other", link.format("http://y.org/es/")),
        (7, "http://z.info/a", link.format("http://y.org/other")),
        (8, "http://free.info/1", link.format("http://b.net/de/2")),
        (9, "http://free.info/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (10, None, link.format("http://y.org/es/")),
        (11, "no scheme", ""),
        (12, "http://notcom/en/", ""),
        (13, "http://alone.info/q?a=1", ""),
        (13, "http://alone.info/q?a=1", ""),
        (14, "http://m.info/1", link.format("http://b.net/de/2") + link.format("x")),
        (15, "http://m.info/2", link.format("http://y.org/es/q")),
    ]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert len(url_filter.judge_urls(frame).collect()) == len(rows)
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[3] == ("b.net", "/de/1", "net/de/", "allow")
    assert got[4] == ("x.example.net", "/de/8", "example.net/de/8", "block")
    assert got[5][3] == got[6][3] == got[7][3] == got[15][3] == "block" and got[6][2] is None
    assert got[8][3] == got[9][3] == got[14][3] == "allow"
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12] == ("notcom", "/en/", None, "allow") and got[13][3] == "allow"
    both = spark.createDataFrame([("http://z.info/a", "http://free.info/1")], "src string, dst string")
    joined = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, redirects=both).collect()}
    assert joined[7] == joined[6] == "allow" and joined[5] == "block"  # an allowed alias has precedence; a rule of one's own decides
    assert url_filter.judge_urls(frame.limit(0)).collect() == []


def test_repeats_are_removed_from_texts(docs, none):
    kept = substring_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    digests = {(i, h): n for i, _, n, h in repeats(texts(), 50)}
    for r in kept.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (r.doc_id, hashlib.sha256(" ".join(w).encode()).hexdigest()) in digests
        assert r.score is None and r.component == "c"
    assert substring_dedup.remove_repeats(none).collect() == []
