"""Phrases, codec and whitening against brute force and the library."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import bpe_codec, collocations, embedding_dedup, secret_scan, token_blocks, url_filter, whitening
from touchline.llm.catalog import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ phrases
def brute_phrases(rows, longest, least, best):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    common = {p: a for p, a in count.items() if a >= least}
    top = collections.Counter()
    for (lang, p), a in common.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                top[lang, p[i : i + m]] = max(top[lang, p[i : i + m]], a)
    found = collections.defaultdict(list)
    for (lang, p), a in common.items():
        if len(p) < 2 or 100 * top[lang, p] >= 80 * a:
            continue
        score, k = min((2000000 * a // (common[lang, p[:k]] + common[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), common[lang, p[:k]], common[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, each in found.items() for i, (s, a, p, x, y) in enumerate(sorted(each)[:best], 1))


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["the", "of", "New", "york", "city", "hall", "é", "a", "zürich", "x", "\x1c", "😀"]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            words += ["new", "york", "city"] if rng.random() < 0.9 else ["new", "york"]
            words += [rng.choice(["of", ".", "the", ",", "\n", "\t"])]
        rows.append((["en", "fr", None, "und"][i % 4], rng.choice([" ", "  ", " \t"]).join(words)))
    return [*rows, ("en", None), ("en", ""), (None, "a " * 5000), ("xx", "one two " * 40 + ", "), ("de", "." * 100)]


@pytest.mark.parametrize("block,bits", [(1 << 20, 1 << 27), (64, 1 << 27), (7, 1 << 12), (2, 64)])
def test_phrases(spark, block, bits):
    rows = phrase_rows()
    frame = spark.createDataFrame([(lang, t, 1, "a") for lang, t in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = collocations.collocations(frame, least=12, best=25, block=block, bitmap_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 12, 25)


def test_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a", " ., ")], "lang string, text string")).collect() == []


def test_long_pieces_are_cut_without_loss(monkeypatch, spark):
    monkeypatch.setattr(collocations, "STEP", 50)  # in this process: the blocks are made here, not in a worker
    import pyarrow as pa

    text = "a b c d " * 100 + "a b"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    for block in (3, 10, 1000):
        blocks = list(collocations._blocks(iter([batch]), 4, block))
        n = collections.Counter()
        for b in blocks:
            every = type("All", (), {"value": [np.full(1 << 10, 2**64 - 1, dtype=np.uint64)] * 4})
            for out in collocations._lists(iter([b]), 4, every):
                for p, k in zip(out.column("phrase").to_pylist(), out.column("n").to_pylist(), strict=True):
                    n[p] += k
        assert (n["a"], n["a b"], n["a b c d"], n["d a b"]) == (101, 101, 100, 100)
        assert n["b c d a"] == 100


@pytest.mark.parametrize("merged,clash", [(1 << 20, False), (1 << 20, True), (50, False)])
def test_a_task_sends_each_phrase_once_and_packed(monkeypatch, merged, clash):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 8 for _ in range(3000)) for _ in range(4)]
    langs = ["en", "fr", "en", "en"]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    blocks = list(collocations._blocks(iter([batch]), 4, 1000))
    want = collections.Counter()
    for lang, t in zip(langs, texts, strict=True):
        words = t.split(" ")
        want.update((lang, k, " ".join(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    every = type("All", (), {"value": [np.full(1 << 10, 2**64 - 1, dtype=np.uint64)] * 4})
    monkeypatch.setattr(collocations, "MERGED", merged, raising=False)
    if clash:  # different phrases with one hash
        monkeypatch.setattr(collocations, "folded", lambda words, phrases: np.zeros(len(phrases), dtype=np.uint64))
    got, rows = collections.Counter(), 0
    for out in collocations._lists(iter(blocks), 4, every):
        for r in out.to_pylist():
            got[r["lang"], r["size"], r["phrase"]] += r["n"]
            rows += 1
    assert got == want
    if merged > 50 and not clash:
        assert rows == len(want)
        assert sum(out.nbytes for out in collocations._packed(iter(blocks), 4, 3, every)) < 4 * len(want)


def test_each_bitmap_is_sent_once(monkeypatch, spark):
    sent, send = [], type(spark.sparkContext).broadcast

    def recorded(self, value):
        sent.append(send(self, value))
        sizes.append(os.path.getsize(sent[-1]._path))
        return sent[-1]

    sizes: list[int] = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", recorded)
    rng = random.Random(6)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(2000))) for _ in range(70)]
    bits = 1 << (140_000).bit_length() - 1
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=12)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 12, 2000)
    assert sum(sizes) < 4 * bits // 8 + 4096  # of 1, 2, 3 and 4 words
    assert not any(os.path.exists(x._path) for x in sent)


def test_a_task_sends_each_bucket_once(monkeypatch):
    import pyarrow as pa

    words = [f"w{i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 9), pa.array([" . ".join(words)] * 9)], names=["lang", "text"])
    blocks = list(collocations._blocks(iter([batch.slice(i, 1) for i in range(9)]), 4, 40))
    assert len(blocks) == 9
    none = type("None", (), {"value": []})
    monkeypatch.setattr(collocations, "TALLIED", 100)
    rows = [r for out in collocations._tallies(iter(blocks), 1, none, 27) for r in out.to_pylist()]
    n = [k for r in rows for k in collocations._numbers(collocations._unzipped(r["n"])).tolist()]
    assert n == [9] * 40


# ------------------------------------------------------------------ codec
def test_codec_equals_the_library(spark):
    rng = random.Random(4)
    library = Tokenizer.from_file(PATH)
    vocabulary = [t.removesuffix("</w>") for t in library.get_vocab()]
    letters = "aaabbehnrstinoélüß'. \n<|>endoftext|́\x85​﻿ŒŁ漢字🙂İΣς"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))) for _ in range(800)]
    texts += [None, "", " 　\t", "a" * 3000, "ab" * 700, "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "word " * 3000, "l'été can't we'll"]
    frame = spark.createDataFrame([(f"d-{i}", t, 1, "ids", None) for i, t in enumerate(texts)], "doc_id string, text string, n_tokens long, ids string, decoded int").repartition(3)
    coded = bpe_codec.encode(frame, PATH)
    got = {r.doc_id: r for r in bpe_codec.decode(coded, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        r = got[f"d-{i}"]
        assert np.frombuffer(r.ids, "<u4").tolist() == want, t
        assert (r.n_tokens, r.decoded) == (len(want), library.decode(want, skip_special_tokens=False))
    both = {r.doc_id: r for r in bpe_codec.encode(frame, PATH, back=True).collect()}
    assert all((both[i].ids, both[i].decoded) == (r.ids, r.decoded) for i, r in got.items())
    assert bpe_codec.encode(frame.limit(0), PATH).collect() == []
    with pytest.raises(ValueError, match="no byte-pair vocabulary"):
        bpe_codec.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_white_space_is_the_librarys():
    library = Tokenizer.from_file(PATH)
    for c in (chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000):
        assert bool(bpe_codec.RUN.fullmatch(c)) == bool(library.encode(c, add_special_tokens=False).ids), hex(ord(c))


def test_codec_query(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op12_bpe_codec"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


# ------------------------------------------------------------------ whitening
def check_whitening(rows, vectors):
    ids = sorted(vectors)
    x = np.floor(1024 * np.array([vectors[i] for i in ids])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    wide = min(8, x.shape[1])
    got = {(r.vec_id, r.component): r for r in rows}
    assert sorted(got) == [(i, k) for i in ids for k in range(1, wide + 1)] and len(rows) == len(got)
    y = np.array([[got[i, k].whitened for k in range(1, wide + 1)] for i in ids])
    want = (x - sums / n) @ axes[:, :wide] / np.sqrt(values[:wide])
    sign = np.sign((y * want).sum(0))
    assert np.abs(y * sign - want).max() < 1e-6
    for a, i in enumerate(ids):
        r = got[i, 1]
        assert r.n == n and r.deviation == sum(int(v) ** 2 for v in n * x[a] - sums)
        assert r.identity_error < 1e-9
        assert all(abs(got[i, k].explained / (values[k - 1] / values.sum()) - 1) < 1e-9 for k in range(1, wide + 1))


def test_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(QUERIES["op13_whitening"](spark, sf_dir).collect(), {r.vec_id: [float(np.float32(v)) for v in r.embedding] for r in rows})


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(3, 3)) * [1.0, 0.1, 1e-2]
    good = {i: (rng.normal(size=3) @ mixed).tolist() for i in range(200)}
    good[200], good[201] = good[7], [0.0, -0.5, 3.25]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, math.nan, 2.0]), (904, [math.inf, 1.0, 2.0]), (905, [1.0, 2.0]), (906, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, "n") for i, v in [*good.items(), *bad]], "vec_id long, embedding array<double>, n long, component string").repartition(5)
    check_whitening(whitening.whiten(frame).collect(), good)
    assert whitening.whiten(frame.where("vec_id >= 900 and vec_id < 905")).collect() == []
    named = spark.createDataFrame([(f"v{i}", [1.0, 2.0]) for i in range(4)], "vec_id string, embedding array<float>")
    rows = whitening.whiten(named).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in rows} == {(0.0, 0.0, 0, 1.0)} and len(rows) == 8
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    scale = np.array([1e6, 1.0, 1e-4, 1e-9])
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    values, axes = whitening.cyclic_jacobi((q * scale) @ q.T)
    assert np.abs(values[:2] / scale[:2] - 1).max() < 1e-9  # the matrix itself is rounded at 1e-10
    graded = np.outer(np.sqrt(scale), np.sqrt(scale)) * (np.eye(4) + 0.1)
    values, axes = whitening.cyclic_jacobi(graded)
    d = np.sqrt(np.diag(graded))
    assert np.abs(np.prod(values) / (np.prod(d**2) * np.linalg.det(graded / np.outer(d, d))) - 1) < 1e-10
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


# ------------------------------------------------------------------ ids, repeated ids, hostile source
def test_vectors_that_share_an_id(spark):
    def unit(angle):
        return [math.cos(angle), math.sin(angle)]

    rows = [("a", unit(0.0)), ("b", unit(0.05)), ("a", unit(2.0)), ("c", unit(2.05)), ("d", unit(1.95)), ("e", unit(4.0)), ("e", unit(4.0)), (None, unit(0.0)), ("f", None)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id string, embedding array<double>, label string").repartition(3)
    got = sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in embedding_dedup.embedding_duplicates(frame).collect())
    want = [("", 0, "", False), ("a", 1, "a", True), ("a", 2, "a", True), ("b", 1, "a", False), ("c", 2, "a", False), ("d", 2, "a", False), ("e", 1, "e", True), ("e", 1, "e", True), ("f", 0, "f", True)]
    assert got == want


def test_ids_that_are_no_numbers(spark):
    frame = spark.createDataFrame([("doc-1", 'password = "Zx8fQ2pL9v7Kd3"')], "doc_id string, text string")
    assert [(r.doc_id, r.n_assign) for r in secret_scan.secret_spans(frame).collect()] == [("doc-1", 1)]
    with pytest.raises(TypeError, match="doc_id must hold whole numbers"):
        token_blocks.token_blocks(frame, PATH)


V = "Zx8fQ2pL9v7Kd3"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"db:\n  password: |\n    {V}\n  user: bobby.tables\n  host: h1", [V]),
        (f"db:\n  password: >-\n    {V}\n    more7Zx\n\n  user: bobby.tables", [f"{V}\n    more7Zx"]),
        (f"- db_password: |\n     {V}\n  user: b\n", [V]),
        (f'I am sad :(\npassword = "{V}"\nname = "bobby.tables9"', [V]),
        (f'call(user="bob", password=["{V}", "b"], t=1)', [V]),
    ],
)
def test_blocks_and_brackets(text, want):
    assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == want


HOSTILE = ["I am so sad today :(\n", "a: [ ", "  key: |\n", "a=", "token=~", "a=(", "password =\n\n\n", "token='", "f{a=b;", "token ? a : ", '<a key="b" value="', "token = 'a' +\n"]


@pytest.mark.parametrize("part", HOSTILE)
def test_time_grows_with_the_text(part):
    import time

    def seconds(size):
        text = part * (size // len(part)) + "password"
        began = time.process_time()
        secret_scan.spans(text)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(200_000) < 3.2 * seconds(100_000) + 0.2


def test_deep_brackets():
    text = "a=(" * 20_000 + f'password="{V}"' + ")" * 20_000
    assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == [V]


# ------------------------------------------------------------------ links of pages
def test_links_of_odd_pages(spark):
    link = '<LINK rel="canonical" href="{}">'
    pages = {
        "http://h.com/d/a": link.format("&#47;x&#x2F;y?a=1&amp;b=2"),
        "http://h.com/d/b": '<base href="http://g.com/k/">' + link.format("z/../w"),
        "http://h.com/d/c": '<base target="_top"><base href="../e/">' + link.format("f"),
        "http://h.com/d/d": "<!-- " + link.format("http://no.com/") + " -->" + "<script>var t = '" + link.format("http://no.com/") + "';</script><style>" + link.format("/no") + "</style>",
        "http://h.com/d/e": "<!-- never ends " + link.format("http://no.com/"),
        "http://h.com/d/f": '<meta http-equiv=refresh content="0; url=&#104;ttp://i.com/&#233;&#128512;&#55296;">',
        "http://h.com/d/g": link.format("#top") + link.format("?q"),
        "no url": link.format("http://no.com/"),
        "http://h.com/d/h": "",
    }
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages.items())] + [(-1, None, link.format("http://no.com/")), (-2, "http://h.com/d/i", None)], "page_id long, url string, html string")
    got = {(r.a, r.b) for r in url_filter.link_edges(frame).collect()}
    assert got == {
        ("http://h.com/d/a", "http://h.com/x/y?a=1&b=2"),
        ("http://h.com/d/b", "http://g.com/k/w"),
        ("http://h.com/d/c", "http://h.com/e/f"),
        ("http://h.com/d/f", "http://i.com/\u00e9\U0001f600\ufffd"),
        ("http://h.com/d/g", "http://h.com/d/g?q"),
    }
    verdicts = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, [("block", "g.com", "/k/")]).collect()}
    assert verdicts == {i: "block" if i == 1 else "allow" for i in [*range(9), -1, -2]}
