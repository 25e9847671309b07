"""Ratings of a pool in levels against the chain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings as rt
from touchline.sources.tables import matches


def values(frame):
    return {r.match_id: np.array([r.home_before, r.away_before, r.home_after, r.away_after]) for r in frame.collect()}


def agree(a, b):
    assert a.keys() == b.keys() and a
    assert max(np.abs(a[k] - b[k]).max() for k in a) < 1e-9


def test_many_clubs(spark):
    clubs = 100_000
    m = spark.range(120_000).select(
        F.col("id").alias("match_id"),
        F.timestamp_seconds(1_000_000 + F.col("id") * 60).alias("kickoff"),
        (F.col("id") % clubs).cast("int").alias("home_team"),
        ((F.col("id") * 7 + 1) % clubs).cast("int").alias("away_team"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 5).cast("int").alias("home_goals"),
        (F.col("id") % 3).cast("int").alias("away_goals"),
    ).where("home_team <> away_team")
    steps = rt.levels(m, 60_000).cache()
    assert steps.select("_step", F.explode(F.array("home_team", "away_team")).alias("team")).groupBy("_step", "team").count().where("count > 1").count() == 0
    assert steps.groupBy("_step").count().agg(F.max("count")).head()[0] < m.count()
    agree(values(rt.rate(m)), values(rt.rate(m, chain=60_000)))


def test_a_league(spark, sf_dir):
    m = matches(spark, sf_dir).where("season = 1999 and home_team < 8 and away_team < 8")
    agree(values(rt.rate(m)), values(rt.rate(m, chain=20)))


def test_pools_of_both_sizes(spark):
    rows = [(i, i, ["a", None, "b"][i % 3 if i < 9 else 2], i % 4, 4 + i % 3, i % 3 if i % 5 else None, 1) for i in range(30)]
    m = spark.createDataFrame(rows, "match_id long, at long, pool string, home_team int, away_team int, home_goals int, away_goals int").withColumn("kickoff", F.timestamp_seconds("at"))
    agree(values(rt.rate(m, by="pool")), values(rt.rate(m, by="pool", chain=5)))
    assert rt.rate(m.limit(0), by="pool").collect() == []
    with pytest.raises(ValueError, match="more than 1000 pools"):
        rt.rate(spark.range(1001).selectExpr("id AS match_id", "timestamp_seconds(id) AS kickoff", "id AS pool", "1 AS home_team", "2 AS away_team", "1 AS home_goals", "0 AS away_goals"), by="pool", chain=0)
