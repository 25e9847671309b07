"""Mixing sources to target weights by temperature (operator 4), DataFrame operations only.

A source's weight is its share of the tokens raised to an exponent, normalised: 1 keeps
the corpus as it is, 0 gives every source the same weight.  The exponent is bisected so
that the weights' entropy reaches ``target_entropy`` (a share of the largest possible), and
raised again as far as needed for no source to be repeated more than ``max_repeats``
times.  Each step of the search aggregates the sources' table at 15 exponents at once,
four bisections in a pass, so any number of sources is fine and nothing but those sums is
collected.

Weights become budgets of ``budget_tokens`` in all, and budgets become *block
permutations*: in each epoch a source's documents fall into blocks by hash, and lie in a
block in order of their hash.  Whole epochs are taken while the budget lasts, then whole
blocks, then a prefix of one block, all decided by one row a source: the number of whole
epochs, of whole blocks, and the last hash taken.  No source is ever sorted in one task;
block sums are aggregated first, and only a source's last block is ordered.  A block has about
``block_tokens``, or 1/``max_blocks`` of its source if that is more.

Defined results: a null source is a source of its own; null and empty texts have no tokens
and cost nothing, and a source without tokens is kept once; rows that share a source and
doc_id are taken or left together; with no tokens at all every row is kept once; an empty
table gives none; a repetition limit that no exponent up to 1 meets gives exponent 1, which
repeats least.  ``mix`` keeps all columns; a result's name replaces a column of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_ids

#: Sources (of about 100 bytes each) that may be broadcast; more are joined by source.
MAX_BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Words parted by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def draw(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in its source's permutation of an epoch."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id.cast("long"))


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float, passes: int = 8) -> float:
    """The exponent in [0, 1] for ``sources`` (share); ``budget_share``: budget over all tokens."""
    n = sources.count()
    if n < 2:
        return 1.0

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy as a share of the largest, and the most repetitions, at each exponent."""
        x, p = F.explode(F.array(*map(F.lit, exponents))).alias("x"), F.col("share")
        power = F.pow(p, F.col("x"))
        sums = sources.select("share", x).groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.col("x") * F.log(p)).alias("s"), F.max(F.pow(p, F.col("x") - 1)).alias("m"))
        found = {r.x: ((math.log(r.z) - r.s / r.z) / math.log(n), budget_share * r.m / r.z) for r in sums.collect()}
        return [found[e] for e in exponents]

    def bisect(low: float, good) -> float:
        """The largest exponent for which ``good`` holds if it holds at ``low`` and then no more."""
        high = 1.0
        for _ in range(passes):
            inner = [low + (high - low) * i / 16 for i in range(1, 16)]
            ok = [good(f) for f in at(inner)]
            k = ok.index(False) if False in ok else 15
            low, high = (inner[k - 1] if k else low), (inner[k] if k < 15 else high)
        return low

    ends = at([0.0, 1.0])
    exponent = 1.0
    if target_entropy is not None and ends[1][0] < target_entropy:
        exponent = bisect(0.0, lambda f: f[0] >= target_entropy)
    if max_repeats is not None and ends[1][1] > max_repeats:
        return 1.0
    if max_repeats is not None and at([exponent])[0][1] > max_repeats:
        # repetitions fall as the exponent grows: the smallest that meets the limit
        low = exponent
        high = 1.0
        for _ in range(passes):
            inner = [low + (high - low) * i / 16 for i in range(1, 16)]
            ok = [f[1] <= max_repeats for f in at(inner)]
            k = ok.index(True) if True in ok else 15
            low, high = (inner[k - 1] if k else low), (inner[k] if k < 15 else high)
        exponent = high
    return exponent


def plan_mix(slim: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_tokens: int | None, seed: int, block_tokens: int, max_blocks: int) -> DataFrame:
    """One row a source of ``slim`` (key, doc_id, n_tokens): what of it is taken."""
    tokens = slim.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
    tokens = materialize(tokens, "source-tokens")
    total = tokens.agg(F.sum("tokens")).head()[0] or 0
    budget = total if budget_tokens is None else budget_tokens
    shares = tokens.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = find_exponent(shares, target_entropy, max_repeats, budget / max(total, 1)) if total else 1.0
    norm = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).head()[0] or 1.0

    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)) / F.lit(norm)).otherwise(0.0)
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    planned = tokens.withColumn("weight", weight).withColumn("quota", quota)
    some = F.col("tokens") > 0
    planned = planned.withColumn("epochs", F.when(some, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int"))
    planned = planned.withColumn("rest", F.when(some, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(-1))
    blocks = F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("tokens") / F.lit(block_tokens)))).cast("int")
    planned = materialize(planned.withColumn("blocks", blocks), "source-plan")

    # the last, partial epoch: whole blocks that fit, then a prefix of the next by hash
    place = draw(F.col("doc_id"), F.col("epochs"), seed)
    last = with_plan(slim, planned.select("key", "epochs", "rest", "blocks")).withColumn("hash", place)
    last = last.withColumn("block", F.pmod("hash", "blocks").cast("int"))
    sums = last.groupBy("key", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("block"))
    sums = materialize(sums.withColumn("upto", upto), "source-blocks")
    whole = sums.groupBy("key").agg(F.sum((F.col("upto") <= F.col("rest")).cast("int")).alias("fit"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("block", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")))).alias("next"))
    whole = whole.select("key", F.coalesce("next.block", F.lit(max_blocks)).alias("edge"), F.coalesce("next.room", F.lit(0)).alias("room"))
    inside = last.join(whole if whole.count() > MAX_BROADCAST_SOURCES else F.broadcast(whole), "key").where("block = edge")
    taken = F.sum("n_tokens").over(Window.partitionBy("key").orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("taken", taken).where("taken <= room").groupBy("key").agg(F.max("hash").alias("cut"))
    return materialize(planned.join(whole.select("key", "edge"), "key", "left").join(cut, "key", "left"), "mix-plan")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the sources' table: broadcast only if it is small."""
    return rows.join(F.broadcast(plan) if plan.count() <= MAX_BROADCAST_SOURCES else plan, "key")


def take(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (key, doc_id, ...) as often as the plan says: adds epoch and block."""
    every = with_plan(rows, plan.select("key", "epochs", "blocks", "edge", "cut"))
    every = every.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    every = every.withColumn("_hash", draw(F.col("doc_id"), F.col("epoch"), seed))
    every = every.withColumn("block", F.pmod("_hash", "blocks").cast("int"))
    part = (F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("_hash") <= F.col("cut")))
    return every.where((F.col("epoch") < F.col("epochs")) | ((F.col("epochs") >= 0) & F.coalesce(part, F.lit(False)))).drop("epochs", "blocks", "edge", "cut", "_hash")


def mix_rows(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget_tokens: int | None = None, seed: int = 17, block_tokens: int = 1_000_000, max_blocks: int = 4096) -> DataFrame:
    """What is taken of ``docs`` (doc_id, source, text): doc_id, source, n_tokens, epoch, block.

    ``budget_tokens`` defaults to the corpus' own.  An epoch's blocks, in order, hold its
    documents; training reads epochs in turn and blocks of all sources side by side.
    """
    slim = docs.select(whole_ids(docs).alias("doc_id"), F.col("source"), source_key(F.col("source")).alias("key"), token_count(F.col("text")).alias("n_tokens"))
    slim = materialize(slim, "doc-tokens")
    plan = plan_mix(slim.select("key", "doc_id", "n_tokens"), target_entropy, max_repeats, budget_tokens, seed, block_tokens, max_blocks)
    weights = plan.select("key", "epochs", "blocks", "edge", "cut")
    return take(slim, weights, seed).select("doc_id", "source", "n_tokens", "epoch", "block")


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget_tokens: int | None = None, seed: int = 17, block_tokens: int = 1_000_000, max_blocks: int = 4096) -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, repeated or left out as planned.

    Texts are not shuffled unless there are too many sources to broadcast their plan.
    """
    slim = docs.select(whole_ids(docs).alias("doc_id"), source_key(F.col("source")).alias("key"), token_count(F.col("text")).alias("n_tokens"))
    plan = plan_mix(materialize(slim, "doc-tokens"), target_entropy, max_repeats, budget_tokens, seed, block_tokens, max_blocks)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), source_key(F.col("source")).alias("key"), whole_ids(docs).alias("doc_id"))
    return take(rows, plan, seed).select("row.*")
