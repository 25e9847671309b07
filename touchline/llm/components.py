"""Connected components by DataFrame operations alone.

First the graph is contracted: each node hooks to its least neighbour and then to that one's, and
edges are taken between what nodes hooked to, each once.  The many edges of a large group become
few, and mostly none.  What is left goes round: nodes, and the parents they have, hook to the
smallest grandparent seen across an edge and are then shortcut (the FastSV scheme), so rounds grow
with the logarithm of a component's diameter.  A node's neighbours are only ever reduced by a
partial aggregate, and joins are between exchanged tables whose right side has one row a node, so a
hub's rows can be split by adaptive execution.  Labels are a table in the shared folder after each
round, and the one before is deleted; nothing is collected but whether a row has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _hooked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of each edge, once, and each node with its least neighbour or itself, whichever is less."""
    one = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(one.union(one.select("b", "a")).distinct(), "edges")
    return both, materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")), "labels")


def _rounds(edges: DataFrame) -> DataFrame:
    both, labels = _hooked(edges)
    while labels.head(1):
        top = labels.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        nodes = labels.join(top, "up").select("node", "up", "upper")
        seen = both.join(nodes.select(F.col("node").alias("b"), "upper"), "b").groupBy(F.col("a").alias("node")).agg(F.min("upper").alias("seen"))
        own = nodes.join(seen, "node")
        hooks = own.groupBy(F.col("up").alias("node")).agg(F.min("seen").alias("hook"))
        new = own.join(hooks, "node", "left").select("node", F.least("up", "upper", "seen", "hook").alias("up"), F.col("up").alias("was"))
        new = materialize(new, "labels")
        discard(labels)
        labels = new.select("node", "up")
        if not new.where("up <> was").head(1):
            break
    discard(both)
    return labels.select("node", F.col("up").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b), as a table; component is its least node.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    both, ups = _hooked(edges)
    tops = materialize(ups.join(ups.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), "tops")
    discard(ups)
    ends = both.where("a < b").join(tops.select(F.col("node").alias("a"), F.col("top").alias("x")), "a").join(tops.select(F.col("node").alias("b"), F.col("top").alias("y")), "b")
    linked = _rounds(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    discard(both)
    out = materialize(tops.join(linked.withColumnRenamed("node", "top"), "top", "left").select("node", F.coalesce("component", "top").alias("component")), "components")
    for table in (tops, linked):
        discard(table)
    return out
