"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, decontaminate, embedding_dedup, jaccard_join, mixing, prefix_counts, quality, secret_scan, substring_dedup, token_blocks, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"))
    labels = _table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.train_quality(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), k=3, similarity="0.9")


def near_copy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(_table(spark, sf_dir, "documents"), k=3, similarity="0.9")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = prefix_counts.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_chars_in_budget")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    said = bpe_codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, back=True)
    return said.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_blocks, op2_decontaminate, op3_secret_scan, op4_mix_sources, op5_embedding_dedup, op6_quality, op7_jaccard_join, op8_token_counts, op9_substring_dedup, op10_url_filter, op11_collocations, op12_bpe_codec, op13_whitening, pipeline, near_copy_links)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """,
reach AS (SELECT a AS node, a AS seen FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""

SQL: dict[str, str] = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
nodes AS (SELECT vec_id AS a FROM v){_REACH},
many AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT node AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id, node = component AS kept FROM least LEFT JOIN many ON node = a""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (m + n - shared)),
nodes AS (SELECT doc_id AS a FROM s){_REACH}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component AS component_id FROM s JOIN least ON doc_id = node""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS x FROM p JOIN f USING (s) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_url_filter": r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (SELECT url, list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b'))[1] AS l,
         list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1] AS m FROM pages),
ends AS (SELECT url, regexp_extract(l, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM tags UNION ALL SELECT url, regexp_extract(m, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags),
full_ends AS (SELECT url, CASE WHEN t LIKE '/%' AND t NOT LIKE '//%' THEN concat(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), replace(t, '&amp;', '&')) ELSE replace(t, '&amp;', '&') END AS t FROM ends WHERE t <> ''),
urls AS (SELECT url AS u FROM pages UNION SELECT t FROM full_ends),
split AS (SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
          concat(translate(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1)) AS node FROM urls WHERE u IS NOT NULL),
ruled AS (SELECT u, host, path, node, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
          FROM split LEFT JOIN rules ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p) GROUP BY ALL),
links AS (SELECT x.node AS a, y.node AS b FROM full_ends e JOIN split x ON x.u = e.url JOIN split y ON y.u = e.t WHERE x.node <> y.node AND x.host <> '' AND y.host <> ''),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
votes AS (SELECT reach.node, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks FROM reach JOIN ruled ON ruled.node = reach.seen GROUP BY reach.node)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, CASE WHEN blocks AND NOT coalesce(allows, false) THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN ruled ON u = url LEFT JOIN votes USING (node)""",
}

SQL["op11_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
held AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS top FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE top IS NULL OR 100 * top < 80 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
each AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * cuts.a) // (CAST(l.a AS HUGEINT) + r.a) AS score
         FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM each),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM least WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

#: The pairs of op7, counted.
SQL["near_copy_links"] = (
    SQL["op7_jaccard_join"].split(",\nnodes AS")[0]
    + """,
many AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM s LEFT JOIN many ON doc_id = a"""
)
