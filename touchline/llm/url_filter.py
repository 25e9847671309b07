"""URL filters with redirect equivalence (operator 10).

Rules name a host and a path: a rule fits its host and all subdomains where the
url's path starts with the rule's, and the longest fitting rule decides.  A url that
no rule fits inherits from its aliases: urls joined by redirects and canonical links
are one component, found by distributed connected components.  A component that has
an explicitly allowed member is allowed, else one with a blocked member is blocked,
else its members are allowed.  A rule that fits a url itself always decides.

Edges are read from the pages (all canonical links and refresh redirects outside comments,
scripts and styles, resolved against the page's url or its first ``base`` tag) and from an
optional table of redirects.  Fragments do not part urls; character references that end in a
semicolon are decoded in targets.

Rules are a table of any size.  A url meets them by two joins: its host's endings, as many as
rules have labels, with the rules' hosts, which say how long their paths are; then host and path
beginnings of these lengths with the rules.  So a url makes a row for each ending that has
rules and each length of these, however many rules there are.

Defined results: null urls, or urls without ``://``, have empty host and path, fit no
rule and have no aliases; rules without a host, a path or a known action are ignored; null html has no links; repeated rows are judged alike; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: (action, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """action, rule_host and rule_path, one row of each host and path; an allowing one of two."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    known = table.where("action in ('allow', 'block') and host is not null and path is not null")
    return known.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("action").alias("action"))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and action of the distinct hosts and paths of ``urls`` that a rule of ``rule_table`` fits: its longest."""
    labels = F.size(F.split("rule_host", r"\."))
    hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    most = rules.agg(F.coalesce(F.max(labels), F.lit(0)).alias("most"))  # one row
    part = F.split("host", r"\.")
    ends = F.when(F.least(F.size(part), F.col("most")) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(part), F.col("most"))), lambda n: F.array_join(F.slice(part, -n, n), ".")))
    own = urls.select("host", "path").where("host <> ''").distinct().crossJoin(F.broadcast(most))
    met = own.select("host", "path", F.explode(ends).alias("rule_host")).join(hosts, "rule_host")
    tried = met.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    fits = tried.withColumn("rule_path", F.col("path").substr(F.lit(1), F.col("n"))).join(rules, ["rule_host", "rule_path"])
    size = F.length("rule_host") + F.length("rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), (F.col("action") == "allow").alias("allow"), "rule_host", "rule_path", "action")).alias("x"))
    return best.select("host", "path", F.concat("x.rule_host", "x.rule_path").alias("rule"), "x.action")


def node_of(url: Column) -> Column:
    """A url as a node: without its fragment, scheme and host in lower case; null if it has no host."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(F.translate(head, _UPPER, _LOWER), rest))


REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


def _decoded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: REFERENCE.sub(lambda m: html.unescape(m[0]), t) if t and "&" in t else t)


def decoded(x: Column) -> Column:
    """A text with the character references that end in a semicolon as the characters they stand for."""
    return F.pandas_udf(_decoded, "string")(x)


def _targets(tags: Column, kind: str, value: str) -> Column:
    """The references of all ``tags`` of a kind."""
    return F.transform(F.filter(tags, lambda t: t.rlike(kind)), lambda t: F.regexp_extract(t, value, 1))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` steps."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(F.concat(walked, F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/"))


def resolved(url: Column, to: Column) -> Column:
    """The url that a page at ``url`` means by ``to``."""
    head, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    own, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(head, _without_dots(own), rest))
        .when(to.startswith("?"), F.concat(head, path, to))
        .when(own != "", F.concat(head, _without_dots(F.concat(folder, own)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): pages and the urls they redirect to or name as canonical, by all their tags."""
    some = pages.where(F.col("html").rlike("(?i)canonical|http-equiv"))
    said = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", ""), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", "")
    some = some.select("url", said.alias("html"))
    base = F.regexp_extract(F.regexp_extract("html", r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    links = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    metas = F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    canonical = _targets(links, r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _targets(metas, r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    to = some.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("to")).where("to <> ''")
    to = to.select("url", decoded(F.col("base")).alias("base"), decoded(F.col("to")).alias("to"))
    to = to.withColumn("from", F.when(F.col("base") != "", F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))).otherwise(F.col("url")))
    return to.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("from"), F.col("to"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    rules: (action, host, path).  ``redirects`` (src, dst) adds edges.  Pages are read twice, once
    for their links; html never takes part in a shuffle.
    """
    table = rule_table(pages.sparkSession, rules)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    linked = connected_components(edges)
    nodes = linked.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    votes = nodes.join(fitting(nodes, table), ["host", "path"]).groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allow"))
    groups = materialize(votes.where("allow = 0").select("component"), "blocked-groups")
    blocked = linked.join(groups, "component").select("node", F.lit("block").alias("inherited"))
    url = F.col("url")
    own = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    hosted, bare = own.where("node is not null"), own.where("node is null")  # what has no host meets nothing, so it goes through no join
    hosted = hosted.join(fitting(hosted, table), ["host", "path"], "left").join(blocked, "node", "left")
    judged = hosted.select("page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict"))
    return judged.union(bare.select("page_id", "host", "path", F.lit(None).cast("string"), F.lit("allow")))
