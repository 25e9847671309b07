"""Sequential team ratings: predict a match from the ratings before it, then update them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written

#: Fixed values.
START, STEP, HOME_ADVANTAGE, DRAW_FALLBACK = 1500.0, 20.0, 60.0, 0.25
#: Matches of a pool that one task streams; larger pools go in levels, and there are not many of those.
CHAIN, MOST_LARGE = 1 << 20, 1000


def expected(home_rating, away_rating, home_advantage: float = HOME_ADVANTAGE):
    """The home side's expected score; for columns and for numbers."""
    gap = (home_rating + home_advantage - away_rating) / -400.0
    power = F.pow(F.lit(10.0), gap) if isinstance(gap, Column) else 10.0**gap
    return 1.0 / (1.0 + power)


def rate(matches: DataFrame, by: str | None = None, step: float = STEP, home_advantage: float = HOME_ADVANTAGE, chain: int = CHAIN) -> DataFrame:
    """``matches`` with home_before, away_before, home_after and away_after.

    Ratings of a pool of clubs (``by``; one pool without it) are one order of updates, by (kickoff, match_id).
    Pools of up to ``chain`` matches run side by side, each streamed through a task that holds one number a club.
    Larger ones go level by level, see ``rate_in_levels``; both give the same.  Unplayed matches change nothing.
    """
    pool = F.col(by).cast("string") if by else F.lit("all")
    slim = matches.select(pool.alias("_pool"), "match_id", "kickoff", "home_team", "away_team", F.col("home_goals").cast("double").alias("home_goals"), F.col("away_goals").cast("double").alias("away_goals"))
    large = [r._pool for r in slim.groupBy("_pool").count().where(F.col("count") > chain).limit(MOST_LARGE + 1).collect()]
    if len(large) > MOST_LARGE:
        raise ValueError(f"more than {MOST_LARGE} pools of over {chain} matches each")
    named = F.coalesce(F.col("_pool"), F.lit("\0"))  # null is a pool too
    small = slim.where(~named.isin([p if p is not None else "\0" for p in large])) if large else slim
    out = _chained(small, step, home_advantage)
    for p in large:
        out = out.unionByName(rate_in_levels(slim.where(F.col("_pool").eqNullSafe(F.lit(p))).drop("_pool"), step, home_advantage, chain))
    return matches.join(out, "match_id")


def _chained(slim: DataFrame, step: float, home_advantage: float) -> DataFrame:
    fields = "match_id long, home_before double, away_before double, home_after double, away_after double"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ratings = None, {}
        for batch in batches:
            out = []
            for p, m, h, a, hg, ag in zip(batch._pool, batch.match_id, batch.home_team, batch.away_team, batch.home_goals, batch.away_goals):
                if p != current:
                    current, ratings = p, {}
                x, y = ratings.get(h, START), ratings.get(a, START)
                change = 0.0
                if hg == hg and ag == ag:  # not a missing value
                    margin = abs(hg - ag)
                    weight = 1.0 if margin <= 1 else 1.5 if margin == 2 else (11.0 + margin) / 8.0
                    change = step * weight * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - expected(x, y, home_advantage))
                ratings[h], ratings[a] = x + change, y - change
                out.append((m, x, y, x + change, y - change))
            yield pd.DataFrame(out, columns=["match_id", "home_before", "away_before", "home_after", "away_after"])

    return slim.repartition("_pool").sortWithinPartitions("_pool", "kickoff", "match_id").drop("kickoff").mapInPandas(fold, fields)


def levels(slim: DataFrame, slice_matches: int) -> DataFrame:
    """``slim`` with _step: matches of one step have no club in common, and a club's matches have ascending steps.

    Matches are cut by time into slices of about ``slice_matches``.  In a slice, a match's level is one more than
    the highest of its clubs' matches before it; all slices find their levels side by side, a task a slice.
    """
    n = slim.count()
    slices = max(1, -(-n // slice_matches))
    at = F.unix_micros(F.col("kickoff").cast("timestamp"))
    edges = slim.select(F.percentile_approx(at, [(i + 1) / slices for i in range(slices - 1)], max(10_000, 20 * slices))).head()[0] if slices > 1 else []
    cut = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>")
    placed = slim.withColumn("_slice", F.size(F.filter(cut, lambda e: e < at)))

    def climb(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kickoff", "match_id"])
        reached: dict = {}
        level = []
        for h, a in zip(group.home_team, group.away_team):
            k = max(reached.get(h, -1), reached.get(a, -1)) + 1
            reached[h] = reached[a] = k
            level.append(k)
        return group[["_slice", "match_id"]].assign(_level=level)

    found = placed.select("_slice", "match_id", "kickoff", "home_team", "away_team").groupBy("_slice").applyInPandas(climb, "_slice int, match_id long, _level int")
    numbered = written(found)
    steps = numbered.groupBy(F.col("_slice").alias("_s"), F.col("_level").alias("_l")).agg(F.count("*").alias("_n"))
    steps = steps.withColumn("_step", F.row_number().over(Window.orderBy("_s", "_l")) - 1)  # a row a level
    numbered = numbered.join(steps, (F.col("_slice") == F.col("_s")) & (F.col("_level") == F.col("_l"))).select("match_id", "_step")
    return placed.drop("_slice").join(numbered, "match_id")


def rate_in_levels(slim: DataFrame, step: float = STEP, home_advantage: float = HOME_ADVANTAGE, slice_matches: int = CHAIN) -> DataFrame:
    """match_id and the four ratings of the matches of one pool, a step of ``levels`` at a time.

    Ratings are a table of one row a club; a step joins its matches with it and writes it anew.  No task
    reads more than a slice of the pool, and steps are as parallel as clubs are many.
    """
    spark = slim.sparkSession
    folder = f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    levels(slim, slice_matches).write.partitionBy("_step").parquet(f"{folder}/steps")
    matches = spark.read.parquet(f"{folder}/steps")
    last = matches.agg(F.max("_step")).head()[0]
    club = slim.schema["home_team"].dataType.simpleString()
    known = spark.createDataFrame([], f"team {club}, rating double")
    out = None
    for i in range(0 if last is None else last + 1):
        now = matches.where(F.col("_step") == i).drop("_step")
        for side in ("home", "away"):
            now = now.join(known.select(F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"{side}_before")), f"{side}_team", "left").na.fill(START, [f"{side}_before"])
        margin = F.abs(F.col("home_goals") - F.col("away_goals"))
        weight = F.when(margin <= 1, 1.0).when(margin == 2, 1.5).otherwise((margin + 11.0) / 8.0)
        got = F.when(F.col("home_goals") > F.col("away_goals"), 1.0).when(F.col("home_goals") == F.col("away_goals"), 0.5).otherwise(0.0)
        change = F.coalesce(step * weight * (got - expected(F.col("home_before"), F.col("away_before"), home_advantage)), F.lit(0.0))
        now = now.withColumn("_change", change).select("match_id", "home_team", "away_team", "home_before", "away_before", (F.col("home_before") + F.col("_change")).alias("home_after"), (F.col("away_before") - F.col("_change")).alias("away_after"))
        now.write.parquet(f"{folder}/rated/step={i}")
        done = spark.read.schema(now.schema).parquet(f"{folder}/rated/step={i}")
        new = done.select(F.explode(F.array(F.struct(F.col("home_team").alias("team"), F.col("home_after").alias("rating")), F.struct(F.col("away_team").alias("team"), F.col("away_after").alias("rating")))).alias("x")).select("x.*")
        known = written(known.join(new.select("team"), "team", "left_anti").unionByName(new))
        out = done.schema
    fields = ["match_id", "home_before", "away_before", "home_after", "away_after"]
    if out is None:
        return spark.createDataFrame([], "match_id long, home_before double, away_before double, home_after double, away_after double")
    return spark.read.schema(out).parquet(*[f"{folder}/rated/step={i}" for i in range(last + 1)]).select(*fields)


def final_ratings(rated: DataFrame) -> DataFrame:
    """Each club's rating after its last match."""
    both = F.explode(F.array(F.struct(F.col("home_team").alias("team"), F.col("home_after").alias("rating")), F.struct(F.col("away_team").alias("team"), F.col("away_after").alias("rating")))).alias("x")
    return rated.select("kickoff", "match_id", both).groupBy("x.team").agg(F.max_by("x.rating", F.struct("kickoff", "match_id")).alias("rating"))


def forecasts(rated: DataFrame, draw_rate: Column) -> DataFrame:
    """Three-way probabilities before each match: the draw rate, and the rest by expected score."""
    e = expected(F.col("home_before"), F.col("away_before"))
    return rated.withColumns({"p_home": (1 - draw_rate) * e, "p_draw": draw_rate, "p_away": (1 - draw_rate) * (1 - e)})


def difference(rated: DataFrame) -> DataFrame:
    return rated.select("match_id", (F.col("home_before") - F.col("away_before")).alias("elo_diff"))


def base_rates(matches: DataFrame, by: list[str]) -> DataFrame:
    """p_home, p_draw and p_away of each group: how often each outcome happened."""
    h, a = F.col("home_goals"), F.col("away_goals")
    share = lambda c: F.avg(c.cast("double"))
    return matches.where("home_goals is not null").groupBy(*by).agg(share(h > a).alias("p_home"), share(h == a).alias("p_draw"), share(h < a).alias("p_away"))


def expanding(matches: DataFrame, folds: DataFrame) -> DataFrame:
    """Matches as training rows of each fold (fold, start) that starts after them.

    Folds' starts, a row each, are sorted into one row that every match is given; a match is
    multiplied by the folds it belongs to, without a range join.
    """
    starts = folds.agg(F.array_sort(F.collect_list(F.struct("start", "fold"))).alias("_folds"))  # one row
    later = F.filter("_folds", lambda f: f["start"] > F.col("kickoff"))
    return matches.crossJoin(F.broadcast(starts)).withColumn("_f", F.explode(later)).withColumn("fold", F.col("_f.fold")).drop("_f", "_folds")


def latest(rows: DataFrame, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("kickoff").desc(), F.col("match_id").desc()))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p")
