"""Files and payloads fetched over HTTP into a keyed table of cached bytes.

Requests are rows; tasks fetch them side by side, each with a bounded number of tries and a growing pause
between them.  What comes whole is kept as bytes with its digest under its address, so decoding can change
later and a second run asks for nothing; with ``refresh`` all is asked for again and only bytes that differ
are committed.  Every request, failed ones too, is a row of a log with its time, tries, status and quota.

Defined results: an address is asked for once however often it is named, null ones never; an answer that is
cut short, shorter than ``least_bytes`` or no 200 is a failed try; an address that fails keeps the bytes
that it had, if any.
"""

from __future__ import annotations

import csv
import hashlib
import http.client
import io
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .keyed import KeyedTable

GOT = "url string, requested_at timestamp, tries int, status int, seconds double, quota int, error string, content binary, digest string"
#: The second feed's numbers of the divisions that result files name.
LEAGUES = {"SP1": 140, "SP2": 141, "E0": 39, "E1": 40, "E2": 41, "E3": 42, "D1": 78, "D2": 79, "I1": 135, "I2": 136, "F1": 61, "F2": 62, "N1": 88, "P1": 94, "T1": 203, "B1": 144, "G1": 197, "SC0": 179, "SC1": 180}
QUOTA = "x-ratelimit-requests-remaining"


def _one(url: str, headers: dict[str, str], tries: int, pause: float, timeout: float, least_bytes: int) -> tuple:
    at, began, status, quota, error = pd.Timestamp.now(tz="UTC").tz_localize(None), time.monotonic(), None, None, None
    for n in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                status, left = answer.status, answer.headers.get(QUOTA)
                quota = int(left) if left and left.isdigit() else quota
                content = answer.read()  # IncompleteRead if it ends early
            if status == 200 and len(content) >= least_bytes:
                return url, at, n, status, time.monotonic() - began, quota, None, content, hashlib.sha256(content).hexdigest()
            error = f"{status} with {len(content)} bytes"
        except urllib.error.HTTPError as e:
            status, error = e.code, f"{e.code} {e.reason}"
        except (OSError, http.client.HTTPException) as e:
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            time.sleep(pause * n)
    return url, at, tries, status, time.monotonic() - began, quota, error, None, None


def _get(batches: Iterator[pd.DataFrame], **how: object) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in GOT.split(", ")]
    for batch in batches:
        for url in batch.url:  # a file a batch, so a task holds one
            out = pd.DataFrame([_one(url, **how)], columns=names)
            yield out.astype({"tries": "Int32", "status": "Int32", "quota": "Int32"})


def cache(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/files", ["url"])


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """url, requested_at, tries, status, seconds, quota, error and bytes of all requests that were made."""
    return spark.read.parquet(f"{path}/requests")


def fetch(requests: DataFrame, path: str, refresh: bool = False, headers: dict[str, str] | None = None, tries: int = 3, pause: float = 1.5, timeout: float = 20.0, least_bytes: int = 200, at_once: int = 8) -> DataFrame:
    """The cached files (url, content, digest, fetched_at) of ``requests`` (url), fetched where they are not there yet or ``refresh`` is set."""
    spark = requests.sparkSession
    table = cache(spark, path)
    wanted = requests.select("url").where("url is not null").distinct()
    held = table.read() if table.log() else None
    asked = wanted if refresh or held is None else wanted.join(held.select("url"), "url", "left_anti")
    how = {"headers": headers or {}, "tries": tries, "pause": pause, "timeout": timeout, "least_bytes": least_bytes}
    got = asked.repartition(at_once).mapInPandas(partial(_get, **how), GOT).persist()
    try:
        size = F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")
        got.select("url", "requested_at", "tries", "status", "seconds", "quota", "error", size).coalesce(1).write.mode("append").parquet(f"{path}/requests")
        good = got.where("content is not null").select("url", "content", "digest", F.col("requested_at").alias("fetched_at"))
        if good.head(1) or held is None:
            table.commit(lambda old: good if old is None else good.join(old.select("url", F.col("digest").alias("_old")), "url", "left").where("_old is null or _old <> digest").drop("_old"))
    finally:
        got.unpersist()
    return table.read().join(wanted, "url", "left_semi")


# ---------------------------------------------------------------- what is asked for
def season_requests(seasons: DataFrame, base: str, divisions: Sequence[str]) -> DataFrame:
    """url, start_year and division of the result files of ``seasons`` (start_year): base/2425/E0.csv."""
    each = seasons.select("start_year", F.explode(F.array(*[F.lit(d) for d in divisions])).alias("division"))
    return each.select(F.concat_ws("/", F.lit(base), text.season_code(F.col("start_year")), F.concat("division", F.lit(".csv"))).alias("url"), "start_year", "division")


def feed_requests(wanted: DataFrame, base: str, endpoint: str, **parameters: str | Column) -> DataFrame:
    """``wanted`` with url: the feed's endpoint with parameters, which are columns by name or expressions."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode((F.col(v) if isinstance(v, str) else v).cast("string"))) for k, v in parameters.items()]
    url = F.concat(F.lit(f"{base}/{endpoint.strip('/')}"), F.concat(F.lit("?"), F.concat_ws("&", *pairs)) if pairs else F.lit(""))
    return wanted.withColumn("url", url)


def league_number(division: Column) -> Column:
    """The second feed's number of a division; null for one that it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LEAGUES.items() for x in pair]), division)


# ---------------------------------------------------------------- what came
def _cells(batches: Iterator[pd.DataFrame], encoding: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for url, content in zip(batch.url, batch.content):
            if encoding == "cascade":
                said = text.decoded(content)
            else:  # one encoding, what it cannot say replaced
                said = content.decode(encoding, "replace")
            rows = []
            for n, row in enumerate(csv.DictReader(io.StringIO(said.lstrip("\ufeff"), newline="")), 1):
                cells = {k.strip(): v.strip() for k, v in row.items() if k and isinstance(v, str) and v.strip()}
                if cells:
                    rows.append((url, n, cells))
            yield pd.DataFrame(rows, columns=["url", "line", "cells"])


def result_cells(files: DataFrame, columns: Sequence[str], encoding: str = "cascade") -> DataFrame:
    """url, line and ``columns`` as text of fetched CSV files, by header name; blank lines and cells, a byte-order mark and unknown columns go.

    ``encoding``: ``cascade`` tries several, any other is taken with what it cannot decode replaced.
    """
    cells = files.select("url", "content").mapInPandas(partial(_cells, encoding=encoding), "url string, line int, cells map<string, string>")
    return cells.select("url", "line", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


EVENT = "struct<time: struct<elapsed: int, extra: int>, team: struct<id: long>, player: struct<id: long>, assist: struct<id: long>, type: string, detail: string>"
STATUS = "struct<requests: struct<current: int, limit_day: int>, subscription: struct<plan: string, active: boolean>>"


def payload(files: DataFrame, response: str) -> DataFrame:
    """``files`` with r, what their JSON holds under ``response``; null where it is no JSON or not of that type."""
    return files.withColumn("r", F.from_json(F.decode("content", "utf-8"), f"response {response}")["response"])


def feed_events(files: DataFrame) -> DataFrame:
    """Events of fixtures: url, place, minute, extra, team, player, assist, type and detail."""
    e = payload(files, f"array<{EVENT}>").select("url", F.posexplode("r").alias("place", "e"))
    return e.select("url", "place", F.col("e.time.elapsed").alias("minute"), F.coalesce("e.time.extra", F.lit(0)).alias("extra"), F.col("e.team.id").alias("team"), F.col("e.player.id").alias("player"), F.col("e.assist.id").alias("assist"), F.lower("e.type").alias("type"), F.col("e.detail").alias("detail"))


def feed_status(files: DataFrame) -> DataFrame:
    """The quota that is left: url, used, daily and left."""
    s = payload(files, STATUS)
    return s.select("url", F.col("r.requests.current").alias("used"), F.col("r.requests.limit_day").alias("daily"), (F.col("r.requests.limit_day") - F.col("r.requests.current")).alias("left"))
