"""The registered queries against their SQL, and what no SQL gives against brute force, on the smallest tables."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import catalog, mixing, quality


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name]) > 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_quality_on_held_out_labels(spark, sf_dir):
    got = {r.doc_id: r for r in catalog.QUERIES["op6_quality"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r.score, labels[i]) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > 0.8


def test_pipeline(spark, sf_dir):
    from test_llm_small import contamination, jaccard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, sf_dir)
        rows = [tuple(r) for r in before.collect()]
        out = [tuple(r) for r in kept.collect()]
        at = {c: i for i, c in enumerate(before.columns)}
        pairs = [(r[at["doc_id"]], r[at["text"]]) for r in rows]
        if name != "token_blocks":
            assert kept.columns == columns
            assert set(out) <= set(rows)
        if name == "near_copies":
            roots = {i: c for i, _, c in jaccard(pairs, 5, 8, 10)}
            assert sorted(r[at["doc_id"]] for r in out) == sorted(i for i, _ in pairs if roots[i] == i)
        elif name == "decontaminate":
            assert sorted(r[at["doc_id"]] for r in out) == sorted(c[0] for c in contamination(pairs, items) if not c[5])
        elif name == "mixture":
            assert collections.Counter(r[at["doc_id"]] for r in out) == collections.Counter(r.doc_id for r in mixing.mix_rows(before).collect())
        elif name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id"))).selectExpr("doc_id", "quality AS label")
            weights = quality.train_quality(before, labels)
            bits, good = (len(weights) - 1).bit_length() - 1, set()
            for i, text in pairs:
                f = next(iter(quality.features([(text or "").encode()], bits)))
                good |= {i} if 1 / (1 + math.exp(-(float(weights[-1]) + sum(float(weights[k]) for k in f) / math.sqrt(max(len(f), 1))))) >= 0.7 else set()
            assert sorted(r[at["doc_id"]] for r in out) == sorted(good)
        elif name == "token_blocks":
            library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
            for r, (i, text) in zip(kept.orderBy("start").collect(), sorted(pairs), strict=True):
                ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
                assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)
    assert kept.count() > 0
