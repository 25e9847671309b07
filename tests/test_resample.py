"""Exact resamples: sizes, independence of partitioning, chances, attempts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import goals_model as gm
from touchline.operators.resample import resampled, with_attempts
from touchline.sources.tables import matches


def copies_of(frame):
    return {(r.g, r.id): list(r.copies) for r in frame.collect()}


def test_every_resample_has_n_draws(spark):
    rows = spark.range(900).select("id", (F.col("id") % 7 == 0).alias("g"))
    one = copies_of(resampled(rows.repartition(2), "id", 40, by=["g"], bucket_rows=50))
    assert one == copies_of(resampled(rows.repartition(9), "id", 40, by=["g"], bucket_rows=50))
    for g in (True, False):
        counts = np.array([v for (k, _), v in one.items() if k == g])
        assert (counts.sum(0) == len(counts)).all() and counts.shape[1] == 40
        assert len({tuple(c) for c in counts.T}) == 40
    assert one != copies_of(resampled(rows, "id", 40, by=["g"], attempt=1, bucket_rows=50))
    assert one != copies_of(resampled(rows, "id", 40, seed=7, by=["g"], bucket_rows=50))


def test_chances_of_counts(spark):
    """How often a row is drawn 0, 1, 2, 3 or more times, and how often rows of two halves are: chi-square."""
    n, reps = 256, 400
    got = {r.id: np.array(r.copies) for r in resampled(spark.range(n), "id", reps, bucket_rows=16).collect()}
    counts = np.array([got[i] for i in range(n)])
    assert (counts.sum(0) == n).all()
    p, each = 1 / n, [(1 - 1 / n) ** n]
    for k in range(1, 3):
        each.append(each[-1] * (n - k + 1) / k * p / (1 - p))
    each.append(1 - sum(each))
    seen = [np.sum(counts == k) for k in range(3)] + [np.sum(counts >= 3)]
    chi = sum((s - e * n * reps) ** 2 / (e * n * reps) for s, e in zip(seen, each, strict=True))
    assert chi < 16.3  # three degrees of freedom, one in a thousand
    half = counts[: n // 2].sum(0)
    assert abs((half - n / 2).mean()) < 4 * np.sqrt(n / 4 / reps) and 0.75 < half.var() / (n / 4) < 1.3


def test_odd_tables(spark):
    assert resampled(spark.range(0), "id", 3).collect() == []
    assert [list(r.copies) for r in resampled(spark.range(1), "id", 3).collect()] == [[1, 1, 1]]
    with pytest.raises(Exception, match="cannot be drawn apart"):
        resampled(spark.range(4).select((F.col("id") % 2).alias("id")), "id", 2).collect()


def test_what_fails_is_run_again(spark):
    asked = []

    def run(attempt, only):
        keys = list(range(5)) if only is None else sorted(r.k for r in only.collect())
        asked.append(keys)
        return spark.createDataFrame([(k, attempt if k <= 2 + attempt else None) for k in keys], "k int, v int")

    assert sorted(map(tuple, with_attempts(run, F.col("v").isNull(), ["k"]).collect())) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]
    assert asked == [[0, 1, 2, 3, 4], [3, 4], [4]]
    with pytest.raises(RuntimeError, match="2 attempts failed for k"):
        with_attempts(run, F.col("v").isNull(), ["k"], attempts=2)


def test_bootstrap_fits_equal_fits_of_the_copies(spark, sf_dir):
    m = matches(spark, sf_dir).where("season = 1999 and home_goals is not null").cache()
    got = {(r.replicate, r.team): r.attack for r in gm.bootstrap(m, 3).collect()}
    copies = {r.match_id: r.copies for r in resampled(m, "match_id", 3).collect()}
    plain = {r.team: r.attack for r in gm.fit(m).collect()}
    assert all(got[0, t] == pytest.approx(a, abs=1e-6) for t, a in plain.items())
    again = spark.createDataFrame([(i, int(c[1])) for i, c in copies.items() if c[1]], "match_id long, times int")
    rows = m.join(again, "match_id").withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    second = {r.team: r.attack for r in gm.fit(rows).collect()}
    assert all(got[2, t] == pytest.approx(a, abs=1e-5) for t, a in second.items())
