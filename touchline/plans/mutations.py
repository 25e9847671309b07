"""Queries that change tables: the state after each change, made from the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as en
from ..operators import feeds as fe
from ..operators import mutations as mu
from ..session import shared_folder
from ..sources.keyed import KeyedTable
from ..sources.tables import matches, table
from .registry import query
from .validation import DIRTY, dirty

K = F.col
KEY = ["season", "home_team", "away_team"]


@query(
    """, n AS (SELECT season, home_team, away_team, 7 AS home_goals, 7 AS away_goals FROM m WHERE home_team = 2 UNION ALL SELECT 2002, home_team, away_team, 1, 0 FROM m WHERE season = 2000 AND home_team < 3)
SELECT coalesce(n.season, m.season) AS season, coalesce(n.home_team, m.home_team) AS home_team, coalesce(n.away_team, m.away_team) AS away_team, CASE WHEN n.season IS NULL THEN m.home_goals ELSE n.home_goals END AS home_goals, CASE WHEN n.season IS NULL THEN m.away_goals ELSE n.away_goals END AS away_goals
FROM m FULL JOIN n ON m.season = n.season AND m.home_team = n.home_team AND m.away_team = n.away_team""",
    corpus=True,
)
def change_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).select(*KEY, "home_goals", "away_goals")
    over = m.where("home_team = 2").select(*KEY, F.lit(7).alias("home_goals"), F.lit(7).alias("away_goals"))
    new = m.where("season = 2000 and home_team < 3").select(F.lit(2002).alias("season"), "home_team", "away_team", F.lit(1).alias("home_goals"), F.lit(0).alias("away_goals"))
    return mu.upsert(m, over.union(new), KEY)


@query(
    """WITH s AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey, min((o_orderkey, o_totalprice)) AS r FROM orders WHERE o_orderkey % 4 = 0 GROUP BY o_custkey)
SELECT o_custkey, r[1] AS o_orderkey, r[2] AS o_totalprice FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = n.o_custkey)"""
)
def change_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return mu.insert_absent(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 = 0"), ["o_custkey"])


@query(
    """, n AS (SELECT match_id, CASE WHEN match_id % 5 = 0 THEN home_sot + 1 WHEN match_id % 7 = 0 THEN NULL ELSE home_sot END AS a, CASE WHEN match_id % 3 = 0 THEN 4 END AS b FROM m WHERE season > 1997)
SELECT m.match_id, coalesce(a, home_sot) AS home_sot, coalesce(b, away_sot) AS away_sot, CAST(a IS NOT NULL AND a IS DISTINCT FROM home_sot AS INT) + CAST(b IS NOT NULL AND b IS DISTINCT FROM away_sot AS INT) AS changed_cells FROM m LEFT JOIN n USING (match_id)""",
    corpus=True,
)
def change_fill_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).select("match_id", "season", "home_sot", "away_sot")
    k = K("match_id")
    home = F.when(k % 5 == 0, K("home_sot") + 1).when(k % 7 == 0, None).otherwise(K("home_sot"))
    new = m.where("season > 1997").select("match_id", home.alias("home_sot"), F.when(k % 3 == 0, 4).alias("away_sot"))
    return mu.fill_cells(m.drop("season"), new, ["match_id"], ["home_sot", "away_sot"])


@query(
    f"""{DIRTY}, r2 AS (SELECT season, home_team, away_team, 2 AS hg, 1 AS ag FROM x WHERE status <> 'FT' AND home_team % 2 = 0)
SELECT match_id, CASE WHEN hg IS NOT NULL THEN hg ELSE home_goals END AS home_goals, CASE WHEN hg IS NOT NULL THEN ag ELSE away_goals END AS away_goals, CASE WHEN hg IS NOT NULL THEN 'FT' ELSE status END AS status FROM x LEFT JOIN r2 USING (season, home_team, away_team)""",
    corpus=True,
)
def change_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dirty(spark, sf_dir)
    results = x.where("status <> 'FT' and home_team % 2 = 0").select(*KEY, F.lit(2).alias("home_goals"), F.lit(1).alias("away_goals"), F.lit(1).alias("home_goals_ht"), F.lit(0).alias("away_goals_ht"))
    return mu.apply_results(x, results, KEY).select("match_id", "home_goals", "away_goals", "status")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def change_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.latest_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], K("ts").desc(), K("event_id").desc()).select("user_id", "event_type", "event_id")


@query("SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) ELSE p_size > 45 END AS is_production FROM part")
def change_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(K("p_brand").alias("name"), K("p_partkey").cast("string").alias("version"), (K("p_size") > 45).alias("is_production"), "p_partkey")
    first = p.orderBy("name", "p_partkey").head()
    return mu.promote(p.drop("p_partkey"), first.name, first.version)


@query(
    """WITH l AS (SELECT event_type AS source, ts AS moment, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS error FROM events)
SELECT source, max(moment) FILTER (error IS NULL) AS last_success, max(moment) AS last_attempt FROM l GROUP BY source"""
)
def change_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(K("event_type").alias("source"), K("ts").alias("at"), F.when(K("event_id") % 3 == 0, F.concat(F.lit("e"), K("event_id"))).alias("error"))
    return mu.freshness(log).select("source", "last_success", "last_attempt")


@query(" SELECT match_id FROM m WHERE odds_home > 3 OR season < 1998", corpus=True)
def change_delete_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return mu.keep_known(m, m.where("odds_home > 3 or season < 1998"), KEY).select("match_id")


@query(
    f"""{DIRTY} SELECT match_id, CASE WHEN home_goals IS NOT NULL AND away_goals IS NOT NULL AND coalesce(home_goals_ht > home_goals, false) THEN 0 ELSE home_goals_ht END AS home_goals_ht FROM x""",
    corpus=True,
)
def change_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dirty(spark, sf_dir)
    wrong = K("home_goals").isNotNull() & K("away_goals").isNotNull() & (K("home_goals_ht") > K("home_goals"))
    fixed, _ = mu.repair(x, x.select(*KEY, F.lit(0).alias("home_goals_ht")), KEY, ["home_goals_ht"], wrong)
    return fixed.select("match_id", "home_goals_ht")


# -------------------------------------------------------------------- feeds
@query(
    """WITH s AS (SELECT s_suppkey AS feed_id, s_name AS canonical_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'v' || s_nationkey END AS venue_name FROM supplier WHERE s_suppkey % 3 <> 0),
n AS (SELECT s_suppkey AS feed_id, 'new ' || s_name AS canonical_name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'w' || s_nationkey END AS venue_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(s.feed_id, n.feed_id) AS feed_id, CASE WHEN s.feed_id IS NULL THEN n.canonical_name ELSE s.canonical_name END AS canonical_name, CASE WHEN s.feed_id IS NULL THEN n.venue_name ELSE coalesce(n.venue_name, s.venue_name) END AS venue_name FROM s FULL JOIN n ON s.feed_id = n.feed_id"""
)
def change_feed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier")
    venue = lambda letter, gap: F.when(K("s_suppkey") % gap != 0, F.concat(F.lit(letter), K("s_nationkey"))).alias("venue_name")
    none = F.lit(None).cast("string").alias("logo_url")
    stored = t.where("s_suppkey % 3 <> 0").select(K("s_suppkey").alias("feed_id"), K("s_name").alias("canonical_name"), venue("v", 4), none)
    feed = t.where("s_suppkey % 2 = 0").select(K("s_suppkey").alias("feed_id"), F.concat(F.lit("new "), "s_name").alias("canonical_name"), venue("w", 5), none)
    return fe.teams(stored, feed).drop("logo_url")


@query(
    """WITH s AS (SELECT DISTINCT CAST(o_custkey % 11 AS BIGINT) AS league_id, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT CAST(o_custkey % 11 AS BIGINT) AS league_id, CAST(year(o_orderdate) AS INT) AS y, max(CAST(o_orderdate AS DATE)) AS ends FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL)
SELECT coalesce(s.league_id, n.league_id) AS league_id, coalesce(s.y, n.y) AS start_year, CASE WHEN s.y IS NULL THEN n.y || '/' || (n.y - 1999) ELSE 'old' END AS label, CASE WHEN s.y IS NULL THEN make_date(n.y, 1, 1) ELSE make_date(s.y, 8, 1) END AS start_date, coalesce(n.ends, make_date(s.y, 6, 1)) AS end_date, coalesce(n.y = 1997, false) AS is_current
FROM s FULL JOIN n ON s.league_id = n.league_id AND s.y = n.y"""
)
def change_feed_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((K("o_custkey") % 11).alias("league_id"), F.year("o_orderdate").alias("start_year"), K("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_custkey")
    year = K("start_year")
    stored = o.where("o_orderkey % 3 = 0").select("league_id", "start_year").distinct().select("league_id", "start_year", F.lit("old").alias("label"), F.make_date(year, F.lit(8), F.lit(1)).alias("start_date"), F.make_date(year, F.lit(6), F.lit(1)).alias("end_date"), F.lit(False).alias("is_current"))
    feed = o.where("o_custkey % 2 = 0").groupBy("league_id", "start_year").agg(F.max("day").alias("end_date"))
    return fe.seasons(stored, feed.withColumns({"start_date": F.lit(None).cast("date"), "is_current": year == 1997}))


@query("WITH l AS (SELECT event_type AS source, event_id AS id, ts AS at, user_id AS calls FROM events) SELECT source, count(*) AS n, sum(calls) AS calls FROM (SELECT * FROM l WHERE id % 2 = 0 UNION ALL SELECT * FROM l WHERE id % 2 = 1) GROUP BY source")
def change_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log after rows were appended: snapshots, runs and requests are kept in this way."""
    log = table(spark, sf_dir, "events").select(K("event_type").alias("source"), K("event_id").alias("id"), K("user_id").alias("calls"), K("ts").alias("computed_at"))
    more = mu.snapshot(log.where("id % 2 = 1").drop("computed_at"), F.lit("2024-01-01").cast("timestamp"))
    return log.where("id % 2 = 0").unionByName(more).groupBy("source").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"))


# ----------------------------------------------------------------- entities
@query(
    """, tm AS (SELECT team, count(*) AS n, 'club' || (team % 7) AS name FROM t GROUP BY team), w AS (SELECT team, first_value(team) OVER (PARTITION BY name ORDER BY n DESC, team) AS win FROM tm)
SELECT team AS loser_id, win AS winner_id FROM w WHERE team <> win""",
    sides=True,
)
def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.survivors(_teams(spark, sf_dir))


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).select(F.explode(F.array("home_team", "away_team")).alias("team_id"))
    return m.groupBy("team_id").agg(F.count("*").alias("matches")).withColumn("name", F.concat(F.lit("Club "), (K("team_id") % 7).cast("string")))


@query(
    """, tm AS (SELECT team, count(*) AS n, 'club' || (team % 7) AS name FROM t GROUP BY team), w AS (SELECT team, first_value(team) OVER (PARTITION BY name ORDER BY n DESC, team) AS win FROM tm),
mv AS (SELECT match_id, season, h.win AS home_team, a.win AS away_team, home_goals, h.team = h.win AND a.team = a.win AS own FROM m JOIN w h ON h.team = home_team JOIN w a ON a.team = away_team WHERE h.win <> a.win)
SELECT match_id, season, home_team, away_team FROM (SELECT *, row_number() OVER (PARTITION BY season, home_team, away_team ORDER BY home_goals IS NULL, NOT own, match_id) AS rn FROM mv) WHERE rn = 1""",
    sides=True,
)
def merge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.merge_teams(matches(spark, sf_dir), en.survivors(_teams(spark, sf_dir))).select("match_id", "season", "home_team", "away_team")


@query(
    """WITH x AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey % 6 END AS k, s_suppkey % 5 AS team FROM supplier)
SELECT id, k, team FROM (SELECT id, k, CASE WHEN team = 3 THEN 1 ELSE team END AS team, row_number() OVER (PARTITION BY CASE WHEN team = 3 THEN 1 ELSE team END, k ORDER BY team = 3, id) AS rn FROM x) WHERE rn = 1"""
)
def merge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier").select(K("s_suppkey").alias("id"), F.when(K("s_suppkey") % 4 != 0, K("s_nationkey") % 6).alias("k"), (K("s_suppkey") % 5).alias("team"))
    losers = spark.createDataFrame([(3, 1)], "loser_id long, winner_id long")
    return en.repoint(x, losers, "team", ["k"])


@query("SELECT 99 + row_number() OVER (ORDER BY name) AS team_id, name FROM (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part WHERE NOT p_type || ' ' || p_brand IN (SELECT p_type || ' ' || p_brand FROM part WHERE p_size < 5))")
def merge_new_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), "p_size")
    return en.new_teams(p, p.where("p_size < 5").select("name"), 100)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS raw_name, CASE WHEN n_nationkey % 3 = 0 THEN 'db ' || n_name WHEN n_nationkey % 5 = 0 THEN 'fixed' WHEN n_name = 'KENYA' THEN 'Kenya' ELSE n_name END AS canonical FROM nation")
def merge_alias_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a database before those of a file, after renames and single overrides."""
    n = table(spark, sf_dir, "nation").select(K("n_nationkey").cast("string").alias("raw_name"), K("n_name").alias("canonical"))
    file = en.renamed(n, spark.createDataFrame([("KENYA", "Kenya")], "old string, new string"), n.where("cast(raw_name as int) % 5 = 0").select("raw_name", F.lit("fixed").alias("canonical")))
    db = n.where("cast(raw_name as int) % 3 = 0").select("raw_name", F.concat(F.lit("db "), "canonical").alias("canonical"))
    return en.merged_aliases(db, file)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 21 = 0 THEN 'C' WHEN o_orderkey % 7 = 0 THEN 'B' WHEN o_orderkey % 3 = 0 THEN 'A' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS o_totalprice
FROM orders UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 5 = 0"""
)
def change_keyed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then changes of a third, a seventh and of what both touch, and new rows, each a commit, one of them sent twice, and half of it compacted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = KeyedTable(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", ["o_orderkey"])
    k = K("o_orderkey")
    t.commit(lambda _: o)
    t.commit(lambda now: now.where(k % 3 == 0).withColumn("o_orderstatus", F.lit("A")))
    for _ in range(2):
        t.commit(lambda now: now.where(k % 7 == 0).select("o_orderkey", F.when(K("o_orderstatus") == "A", "C").otherwise("B").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice")), "sevenths")
    t.compact()
    t.commit(lambda _: o.where(k % 5 == 0).select((-1 - k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice"))
    return t.read()


@query("SELECT match_id, 'v' || (match_id % 3) AS version, date_trunc('hour', kickoff) AS as_of, CASE WHEN match_id % 2 = 0 THEN 2 ELSE 1 END AS said FROM m", corpus=True)
def change_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by (match, version, hour): said again within the hour, the later one stays."""
    m = matches(spark, sf_dir).select("match_id", F.concat(F.lit("v"), K("match_id") % 3).alias("version"), F.date_trunc("hour", "kickoff").alias("as_of"), F.lit(1).alias("said"))
    again = m.where("match_id % 2 = 0").withColumn("said", F.lit(2))
    return mu.upsert(m, again, ["match_id", "version", "as_of"])
