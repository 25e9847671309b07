"""Drawing n of n rows with replacement, exactly, without row numbers.

Rows fall into 2**b buckets by a digest of their key.  How many of the n draws fall into each half of the
buckets is binomial, and so on down a tree of counts: every node's split is drawn once, from a generator
seeded by the node, so all buckets below it agree without a word between them.  In a bucket, what is left
is dealt to its rows by a multinomial draw.  Replicates therefore have exactly n draws each, the same
whatever the partitioning, and no task sees more than a bucket and the b nodes above it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows that a bucket holds about.
BUCKET = 4096


def resampled(rows: DataFrame, key: str, replicates: int, seed: int = 42, by: Sequence[str] = (), attempt: int = 0, bucket_rows: int = BUCKET) -> DataFrame:
    """by..., ``key`` and copies (array<int>, one for each replicate) of each row; copies of a group sum to its size.

    Rows that share a key within a group are refused, since they could not be told apart.
    """
    keys = list(by)
    slim = rows.select(*keys, F.col(key).alias("_key"))
    n = slim.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / bucket_rows)))))
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(1 << bits)))
    sizes = slim.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")
    nodes = sizes.select(*keys, "_bucket", "n", levels).select(*keys, "level", F.expr(f"_bucket >> cast({bits} - level as int)").alias("node"), "n")
    nodes = nodes.groupBy(*keys, "level", "node").agg(F.sum("n").alias("n"))
    # of each node on a bucket's way: its size, and that of its left half
    left = nodes.where("level > 0 and node % 2 = 0").select(*keys, (F.col("level") - 1).alias("level"), F.expr("node div 2").alias("node"), F.col("n").alias("left"))
    halves = nodes.join(left, [*keys, "level", "node"], "left").na.fill(0, ["left"])
    ways = sizes.select(*keys, "_bucket", levels).withColumn("node", F.expr(f"_bucket >> cast({bits} - level as int)"))
    ways = ways.join(halves, [*keys, "level", "node"]).groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list(F.struct("level", "n", "left"))).alias("way"))

    def draw(group: tuple, own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        *names, bucket = group
        tag = zlib.crc32(repr(names).encode())
        path = way.way.iloc[0] if len(way) else []
        left_over, node = np.full(replicates, path[0]["n"] if len(path) else 0, dtype=np.int64), 0
        for level in range(bits):
            split = np.random.default_rng([seed, attempt, tag, level, node]).binomial(left_over, path[level]["left"] / path[level]["n"])
            right = (int(bucket) >> (bits - 1 - level)) & 1
            left_over, node = left_over - split if right else split, 2 * node + right
        own = own.sort_values("_key")
        if own["_key"].duplicated().any():
            raise ValueError(f"rows that share a {key} cannot be drawn apart")
        copies = np.random.default_rng([seed, attempt, tag, bits, int(bucket), 1]).multinomial(left_over, np.full(len(own), 1 / len(own)))
        out = own[[*keys, "_key"]].copy()
        out["copies"] = list(copies.T.astype(np.int32))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"_key {kinds['_key']}", "copies array<int>"])
    ways = ways.select(*[F.col(c).alias(c) for c in ways.columns])  # columns of its own
    drawn = slim.groupBy(*keys, "_bucket").cogroup(ways.groupBy(*keys, "_bucket")).applyInPandas(draw, schema)
    return drawn.withColumnRenamed("_key", key)


def with_attempts(run: Callable[[int, DataFrame | None], DataFrame], failed: Column, keys: Sequence[str], attempts: int = 3) -> DataFrame:
    """What ``run`` gives, with the keys that failed run again, up to ``attempts`` times in all; what still fails then is an error.

    ``run`` takes the attempt's number and the keys it is for (None: all).
    """
    done, missing = None, None
    for attempt in range(attempts):
        out = written(run(attempt, missing))
        good = out.where(~failed)
        done = good if done is None else done.unionByName(good)
        missing = out.where(failed).select(*keys).distinct()
        if not missing.head(1):
            return done
    some = [tuple(r) for r in missing.limit(5).collect()]
    raise RuntimeError(f"{attempts} attempts failed for {', '.join(keys)}: {some}")
