"""Scans that are kept, and simulations that are stored and read back."""

from pyspark.sql import functions as F

from touchline.operators import simulation as sim
from touchline.sources import sinks
from touchline.sources.cache import ScanCache


def test_a_changed_file_is_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(path)
    write(5)
    cache = ScanCache(spark, most=2)
    scan = lambda: spark.read.parquet(path).where("id > 1")
    one = cache.get(scan)
    assert one.count() == 3 and one.storageLevel.useMemory
    assert cache.get(scan) is one and len(cache.held) == 1
    assert "InMemoryRelation" in cache.get(scan)._jdf.queryExecution().withCachedData().toString()
    write(9)
    two = cache.get(scan)
    assert two is not one and two.count() == 7
    assert cache.get(scan, refresh=True) is not two
    for n in range(3):  # memory is bounded by the number of scans
        cache.get(lambda n=n: spark.read.parquet(path).where(F.col("id") > n + 2)).count()
    assert len(cache.held) == 2
    cache.clear()
    assert not cache.held


def test_runs_are_stored_and_read_back(spark, tmp_path):
    path = str(tmp_path / "runs")
    table = lambda p: spark.createDataFrame([(1, p), (2, 1 - p)], "team int, p_champion double")
    forced = spark.createDataFrame([(5, 2, 0), (4, 1, 1)], "match_id long, home_goals int, away_goals int")
    at = lambda t: F.timestamp_seconds(F.lit(t))
    for i, (p, f) in enumerate([(0.25, None), (0.5, None), (0.75, forced)]):
        sinks.append(sim.stored(table(p), "v1", 100, 7, at(i), f), path)
    log = spark.read.parquet(path)
    assert sorted((r.computed_at.second, r.runs, r.seed, r.forced) for r in log.collect()) == [(0, 100, 7, None), (1, 100, 7, None), (2, 100, 7, '[{"match_id":4,"home_goals":1,"away_goals":1},{"match_id":5,"home_goals":2,"away_goals":0}]')]
    assert sorted(map(tuple, sim.latest_stored(log, "v1").collect())) == [(1, 0.5), (2, 0.5)]
    assert sim.latest_stored(log, "v2").collect() == []
