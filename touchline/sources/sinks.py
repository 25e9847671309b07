"""Writers: whole tables, snapshots by season, logs and model artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def replace_seasons(table: DataFrame, path: str) -> None:
    """Overwrite the seasons that ``table`` holds and leave all others as they are."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    """Write a table that may be read from ``path`` itself: to a new version first, then named as current.

    Readers take the last version that was written whole.  Of what a killed writer left, only the number is used up.
    """
    last = max((int(name[1:]) for name, _ in _folders(spark, path)), default=0)
    table.write.parquet(f"{path}/v{last + 1:06d}")
    return current(spark, path)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names of versions, and whether they were written whole, as any file system Spark knows lists them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    return sorted((p.getName(), fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table, oldest first."""
    return [f"{path}/{name}" for name, whole in _folders(spark, path) if whole]


def current(spark: SparkSession, path: str) -> DataFrame:
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(found[-1])


def write_artifact(spark: SparkSession, artifact: dict, path: str) -> None:
    """A model's values as one JSON document, keys in order."""
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).head()[0])
