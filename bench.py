"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

#: Runs of the simulation, as in the published figure that it is held against.
RUNS = 10_000
QUERIES = (
    "standings_full",
    "standings_batch_rank",
    "form_dataset",
    "feature_vector",
    "join_point_in_time",
    "latest_prediction",
    "check_conservation",
    "score_by_season",
    "rating_history",
    "goals_pair_sums",
    "goals_fit",
    "goals_forecasts",
    "simulate_summary",
    "change_upsert",
    "merge_matches",
    "leagues_standings",
    "leagues_form",
    "leagues_ratings",
)


def main() -> None:
    from touchline import get_session
    from touchline.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="spark-bench-")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.local.dir": f"{home}/local",
            "spark.sql.warehouse.dir": f"{home}/warehouse",
            "spark.checkpoint.dir": f"file://{home}/shared",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def season_simulation(spark, sf_dir):
        from touchline.operators import simulation as sim
        from touchline.plans.simulation import SEED, ensemble, season

        return sim.summary(sim.final_tables(season(spark, sf_dir), ensemble(spark), RUNS, SEED))

    def bootstrap_fits(spark, sf_dir):
        from touchline.operators import goals_model as gm
        from touchline.sources.tables import matches

        return gm.bootstrap(matches(spark, sf_dir), 100)

    def published_season(spark, sf_dir):
        """As the published figure has it: 69 played fixtures, 311 open ones, 100 fitted vectors; those are made before."""
        from touchline.operators import simulation as sim

        return sim.summary(sim.final_tables(*published(spark, sf_dir), RUNS, 42))

    held = {}

    def published(spark, sf_dir):
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        from touchline.operators import goals_model as gm
        from touchline.sources.tables import matches

        if not held:
            m = matches(spark, sf_dir)
            place = F.row_number().over(Window.orderBy("kickoff", "match_id"))
            one = m.where("season = 2000").withColumn("place", place)
            one = one.withColumns({c: F.when(F.col("place") <= 69, F.col(c)) for c in ("home_goals", "away_goals")}).drop("place").cache()
            vectors = gm.bootstrap(m.where("season < 2000"), 99).withColumnRenamed("replicate", "vector").cache()
            assert one.where("home_goals is null").count() == one.count() - 69 and vectors.select("vector").distinct().count() == 100
            held["made"] = (one, vectors)
        return held["made"]

    published(spark, sf_dir)
    jobs = {n: catalog.QUERIES[n] for n in QUERIES} | {f"simulate_{RUNS}_seasons": season_simulation, f"published_{RUNS}_seasons_100_vectors": published_season, "bootstrap_100_fits": bootstrap_fits}
    seconds = {}
    for name, job in jobs.items():
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
