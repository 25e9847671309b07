"""Operators without SQL against plain loops, and embeddings, tables and counts at the edges of their blocks."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_small import components, docs, ordered, texts  # noqa: F401
from tokenizers import Tokenizer

from touchline.llm import common, embedding_dedup, mixing, prefix_counts, quality

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ quality
def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """Follow the regularised leader, a number at a time; rows: ({feature: value}, label)."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def vector(text, bits):
    ids = list(quality.features([text.encode()], bits))[0].tolist()
    return {i: c / math.sqrt(max(len(ids), 1)) for i, c in collections.Counter(ids).items()} | {1 << bits: 1.0}


def test_training_and_scores_equal_a_plain_loop(spark):
    rng = random.Random(6)
    words = [["sea", "stone", "river", "light", "old,"], ["buy", "now!!!", "free", "$$$"]]
    rows = [(i, " ".join(rng.choice(words[i % 2]) if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 40))), i % 2) for i in range(250)]
    rates = {"epochs": 3, "alpha": 0.7, "beta": 1.0, "l1": 0.02, "l2": 0.1}
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    weights = quality.train_quality(frame, spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, label int"), bits=14, **rates)
    order = sorted(rows[:200], key=lambda r: int(common.mix64(np.array([r[0]], dtype=np.uint64))[0]))
    want = plain_ftrl([(vector(t, 14), y) for _, t, y in order], **rates)
    got = {i: float(weights[i]) for i in want}
    assert max(abs(got[i] - w) for i, w in want.items()) < 1e-5
    assert set(np.flatnonzero(weights).tolist()) == {i for i, w in want.items() if abs(w) > 1e-12}
    score = {r.doc_id: r.score for r in quality.score_quality(frame, weights).collect()}
    for i, t, _ in rows:
        assert abs(score[i] - 1 / (1 + math.exp(-sum(float(weights[f]) * x for f, x in vector(t, 14).items())))) < 1e-6


def test_features_are_runs_and_pairs():
    """Equal runs and pairs have one number, different ones differ, repeated pairs share one."""
    a, b = (list(quality.features([t], 20))[0].tolist() for t in (b"sea stone sea", b"stone! sea sea"))
    assert len(a) == 5 and len(b) == 7
    assert a[0] == a[2] == b[2] == b[3] and a[1] == b[0]
    c = list(quality.features([b"x x y y"], 20))[0].tolist()
    assert c[4] == c[6] == b[6] and c[5] not in c[:5]


# ------------------------------------------------------------------- mixing
@pytest.mark.parametrize("block_tokens,max_blocks,budget,broadcast", [(500, 4096, None, 100_000), (100, 7, 30_000, 100_000), (1000, 1, 3_000, 0)])
def test_rows_taken_equal_a_plain_loop(spark, monkeypatch, block_tokens, max_blocks, budget, broadcast):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", broadcast)
    rng = random.Random(10)
    rows = [(i % 1400, "w " * rng.randint(0, 20), rng.choice(["big"] * 12 + ["mid"] * 3 + ["small", None])) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_rows(frame, 0.9, 4.0, budget, seed=3, block_tokens=block_tokens, max_blocks=max_blocks)
    own = collections.Counter()
    for _, t, s in rows:
        own[s] += len(t.split())
    total = sum(own.values())
    shares = spark.createDataFrame([(n / total,) for n in own.values()], "share double")
    exponent = mixing.find_exponent(shares, 0.9, 4.0, (budget or total) / total)
    norm = sum((n / total) ** exponent for n in own.values())
    epochs = spark.range(1400).select("id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("e"))
    place = {(r.id, r.e): r.h for r in epochs.select("id", "e", mixing.draw(F.col("id"), F.col("e"), 3).alias("h")).collect()}
    want = []
    for source, n in own.items():
        mine = [(i, len(t.split())) for i, t, s in rows if s == source]
        quota = math.floor((n / total) ** exponent / norm * (budget or total) + 0.5)
        whole, rest = divmod(quota, n)
        blocks = max(1, min(max_blocks, -(-n // block_tokens)))
        for e in range(whole):
            want += [(i, source, k, e, place[i, e] % blocks) for i, k in mine]
        by_block = collections.defaultdict(list)
        for i, k in mine:
            by_block[place[i, whole] % blocks].append((place[i, whole], i, k))
        for b in sorted(by_block):
            size = sum(k for _, _, k in by_block[b])
            if size <= rest:
                want += [(i, source, k, whole, b) for _, i, k in by_block[b]]
                rest -= size
                continue
            for h in sorted({h for h, _, _ in by_block[b]}):
                same = [(i, k) for g, i, k in by_block[b] if g == h]
                if sum(k for _, k in same) > rest:
                    break
                want += [(i, source, k, whole, b) for i, k in same]
                rest -= sum(k for _, k in same)
            break
    assert ordered(got.collect()) == ordered(want) and len(want) > 100


def test_a_repetition_limit_that_cannot_be_met(spark):
    shares = spark.createDataFrame([(0.9,), (0.1,)], "share double")
    assert mixing.find_exponent(shares, 1.0, 4.0, 5.0) == 1.0
    assert mixing.find_exponent(shares, 1.0, None, 5.0) < 1e-6


# --------------------------------------------------------------- embeddings
def links_of(rows, threshold):
    """Links of (vec_id, vector, label), by the plain product of unit vectors."""
    out = []
    for label in {r[2] for r in rows}:
        for d in {len(r[1]) for r in rows}:
            some = [r for r in rows if r[2] == label and len(r[1]) == d]
            if some:
                x = np.array([r[1] for r in some])
                x /= np.linalg.norm(x, axis=1)[:, None]
                i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                out += [(some[a][0], some[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return out


def clusters(rng, many, d, size, spread):
    return [c + spread * rng.standard_normal(d) for c in rng.standard_normal((many, d)) for _ in range(size)]


@pytest.mark.parametrize("block,searchers", [(256, 4096), (5, 7)])
def test_large_cells_and_two_lengths(spark, monkeypatch, block, searchers):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SEARCHERS", searchers)
    rng = np.random.default_rng(7)
    vectors = clusters(rng, 30, 16, 12, 0.08) + clusters(rng, 20, 9, 8, 0.07)
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    links = links_of(rows, 0.98)
    many = collections.Counter(x for pair in links for x in pair)
    root = components([r[0] for r in rows], links)
    got = embedding_dedup.embedding_duplicates(frame, per_cell=40).collect()
    assert ordered(got) == ordered([(i, many[i], root[i], root[i] == i) for i, _, _ in rows]) and len(links) > 300


@pytest.mark.parametrize("target", [0.95, 0.9])
def test_recall_of_a_lower_target(spark, target):
    """Fewer cells are visited, and the share of links found is what was asked for."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    move = rng.standard_normal(base.shape)
    move -= (move * base).sum(1)[:, None] * base
    move /= np.linalg.norm(move, axis=1)[:, None]
    cos = rng.uniform(0.98, 0.999, 700)[:, None]
    vectors = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * move])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = embedding_dedup.embedding_duplicates(frame, target_recall=target, per_cell=8).agg(F.sum("n_links")).head()[0] // 2
    links = links_of(rows, 0.98)
    assert target <= found / len(links) <= 1.0
    whole, less = (embedding_dedup.Codebooks(vectors, 13, 0.04, t).visit(vectors)[1] for t in (1.0, target))
    assert sum(map(len, less)) < 0.9 * sum(map(len, whole))


def test_cells_come_in_order():
    rng = np.random.default_rng(9)
    a, b = np.sort(rng.random(30)), np.sort(rng.random(20))
    got = embedding_dedup.multi_sequence(a, b, 0.6)
    want = sorted(((a[i] + b[j], i, j) for i in range(30) for j in range(20) if a[i] + b[j] <= 0.6))
    assert got == [(i, j) for _, i, j in want] and len(got) > 20


# ------------------------------------------------------------- token counts
@pytest.fixture(scope="module")
def tables():
    return prefix_counts.PrefixTables(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)


def test_counts_of_whole_texts(docs, tables):  # noqa: F811
    """Every text of the fixture, the very long ones too; prefixes at random places."""
    rng = random.Random(11)
    got = collections.defaultdict(list)
    for r in prefix_counts.prefix_counts(docs, BYTE_BPE, store=True).collect():
        got[r.doc_id].append(r)
    for i, t in texts():
        t = t or ""
        same = [r for r in got[i] if r.n_bytes == len(t.encode()) and r.n_tokens == len(tables[1].encode(t, add_special_tokens=False).ids)]
        assert same
        for p in rng.sample(range(len(t) + 1), min(5, len(t))):
            assert any(prefix_counts.count_at(r.prefix_table, p) == len(tables[1].encode(t[:p], add_special_tokens=False).ids) for r in same), (i, p)


@pytest.mark.parametrize("low,high", [(0x4E00, 0x9FA5), (0x61, 0x7A), (0x21, 0x7E), (0x1F300, 0x1F5FF), (0x20, 0x250)])
def test_long_texts_without_blanks(tables, low, high):
    rng = random.Random(low)
    text = "".join(chr(rng.randrange(low, high + 1)) for _ in range(20_000))
    runs, total = tables[0].document(text)
    assert total[-1] == len(tables[1].encode(text, add_special_tokens=False).ids)
    counts = prefix_counts.unpack_steps(tables[0].steps(runs))
    for p in [*rng.sample(range(len(text)), 12), 1, 2, 3]:
        assert counts[p] == len(tables[1].encode(text[:p], add_special_tokens=False).ids)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(prefix_counts, "ROOM", 20_000)
    own, library = prefix_counts.PrefixTables(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(12)
    some = [" ".join("".join(rng.choice("abcdeéß'中") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", "!?"]) for _ in range(200)) for _ in range(20)] + ["字" * 3000, "a" * 3000 + " b"]
    for (_, total), text in zip(own.documents(some), some, strict=True):
        assert total[-1] == len(library.encode(text, add_special_tokens=False).ids)
    assert max(own.held.values()) <= 20_000 and max(len(own.words), len(own.totals), len(own.follows)) < 200


# --------------------------------------------------------------- components
@pytest.mark.parametrize("shape", ["path", "shuffled path", "star", "backward star", "random", "text"])
def test_components(spark, shape):
    from touchline.llm.components import connected_components

    rng = random.Random(13)
    n = list(range(300))
    if shape == "shuffled path":
        rng.shuffle(n)
    edges = {
        "star": [(0, i) for i in n[1:]],
        "backward star": [(i, 999) for i in n],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1, 1), (None, 2), (3, None)],
        "text": [(f"n{i}", f"n{i * 7 % 60}") for i in range(150)],
    }.get(shape, list(zip(n, n[1:], strict=False)))
    kind = "string" if shape == "text" else "long"
    frame = spark.createDataFrame(edges * 2, f"a {kind}, b {kind}").repartition(3)
    clean = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = components({x for e in clean for x in e}, clean)
    assert {r.node: r.component for r in connected_components(frame).collect()} == want
    assert connected_components(frame.limit(0)).collect() == []
