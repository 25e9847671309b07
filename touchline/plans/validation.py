"""Queries that look for faults in the match corpus, into which a rule plants some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import standings as st
from ..operators import validation as v
from ..sources.tables import matches, sides, table
from .registry import query

K = F.col
#: The corpus with faults: lost and absurd scores, wrong statuses, half-time scores above the final.
DIRTY = """, x AS (SELECT match_id, season, home_team % 3 AS competition, home_team, away_team, kickoff, CASE WHEN match_id % 97 = 0 THEN NULL WHEN match_id % 89 = 0 THEN 25 ELSE home_goals END AS home_goals, away_goals,
  CASE WHEN match_id % 83 = 0 THEN 'NS' ELSE status END AS status, CASE WHEN match_id % 53 = 0 THEN home_goals + 1 WHEN match_id % 2 = 0 THEN home_goals // 2 END AS home_goals_ht, CASE WHEN match_id % 2 = 0 THEN away_goals // 2 END AS away_goals_ht FROM m)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("match_id")
    return matches(spark, sf_dir).select(
        "match_id",
        "season",
        (K("home_team") % 3).alias("competition"),
        "home_team",
        "away_team",
        "kickoff",
        F.when(k % 97 == 0, None).when(k % 89 == 0, 25).otherwise(K("home_goals")).alias("home_goals"),
        "away_goals",
        F.when(k % 83 == 0, "NS").otherwise(K("status")).alias("status"),
        F.when(k % 53 == 0, K("home_goals") + 1).when(k % 2 == 0, F.floor(K("home_goals") / 2).cast("int")).alias("home_goals_ht"),
        F.when(k % 2 == 0, F.floor(K("away_goals") / 2).cast("int")).alias("away_goals_ht"),
    )


@query(
    f"""{DIRTY}, rg(competition, low, high) AS (VALUES (0, 100, 130), (1, 130, 140), (2, 100, 160)), s AS (SELECT c.competition, season, season = 2001 AS is_live FROM (SELECT DISTINCT season FROM x UNION SELECT 1990) CROSS JOIN (SELECT DISTINCT competition FROM x) c),
k AS (SELECT competition, season, count(*) AS n FROM x WHERE NOT (season = 1996 AND home_team > 5) GROUP BY ALL), n AS (SELECT s.*, coalesce(n, 0) AS n FROM s LEFT JOIN k USING (competition, season)),
md AS (SELECT competition, list_sort(list(n))[len(list(n)) // 2 + 1] AS median FROM n WHERE n > 0 GROUP BY competition)
SELECT competition, season, n, median, CASE WHEN n = 0 THEN 'empty' WHEN NOT n BETWEEN CASE WHEN is_live THEN floor(low * 0.55) ELSE low END AND high THEN 'range' WHEN NOT is_live AND n < median * 0.6 THEN 'low' ELSE 'ok' END AS verdict
FROM n LEFT JOIN rg USING (competition) LEFT JOIN md USING (competition)""",
    corpus=True,
)
def check_season_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dirty(spark, sf_dir)
    ranges = spark.createDataFrame([(0, 100, 130), (1, 130, 140), (2, 100, 160)], "competition int, low int, high int")
    years = x.select("season").distinct().union(spark.range(1).select(F.lit(1990)))
    seasons = years.select("season", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("competition"), (K("season") == 2001).alias("is_live"))
    return v.season_counts(seasons, x.where("not (season = 1996 and home_team > 5)"), ranges)


@query(
    """, b AS (SELECT season, team, count(*) FILTER (venue = 'H') AS home, count(*) FILTER (venue = 'A') AS away FROM t WHERE NOT (team % 6 = 1 AND venue = 'A' AND opponent < 8) GROUP BY ALL)
SELECT season, team, home, away, abs(home - away) > greatest(2, CAST(round_even((home + away) * CAST(0.15 AS DOUBLE), 0) AS INT)) AS unbalanced FROM b""",
    sides=True,
)
def check_home_away_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.balance(sides(matches(spark, sf_dir)).where("not (team % 6 = 1 and venue = 'A' and opponent < 8)"))


@query(
    f"""{DIRTY} SELECT count(*) FILTER (status = 'FT' AND (home_goals IS NULL OR away_goals IS NULL)) AS finished_without_score, count(*) FILTER (status = 'NS' AND home_goals IS NOT NULL AND away_goals IS NOT NULL) AS open_with_score,
  count(*) FILTER ((home_goals_ht IS NOT NULL OR away_goals_ht IS NOT NULL) AND (home_goals IS NULL OR away_goals IS NULL)) AS half_time_without_full_time,
  count(*) FILTER (home_goals IS NOT NULL AND away_goals IS NOT NULL AND (home_goals_ht > home_goals OR away_goals_ht > away_goals)) AS half_time_above_full_time FROM x""",
    corpus=True,
)
def check_status_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.status_faults(dirty(spark, sf_dir))


@query(f"{DIRTY} SELECT count(*) FILTER (home_goals < 0 OR home_goals > 20) AS home, count(*) FILTER (away_goals < 0 OR away_goals > 20) AS away FROM x", corpus=True)
def check_goal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.goal_range(dirty(spark, sf_dir))


@query(f"{DIRTY} SELECT competition, home_team, away_team, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1", corpus=True)
def check_duplicate_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.repeated(dirty(spark, sf_dir), ["competition", "home_team", "away_team"])


@query(
    """SELECT 'l_suppkey' AS reference, count(*) AS orphans FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) UNION ALL
SELECT 'l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) UNION ALL SELECT 'l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def check_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, o = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0"), table(spark, sf_dir, "part").where("p_size < 40"), table(spark, sf_dir, "orders")
    return v.orphans(table(spark, sf_dir, "lineitem"), [("l_suppkey", s, "s_suppkey"), ("l_partkey", p, "p_partkey"), ("l_orderkey", o, "o_orderkey")])


@query(
    """, g AS (SELECT * FROM t WHERE gf IS NOT NULL), made AS (SELECT season, count(*) AS n, count(*) FILTER (home_goals = away_goals) AS draws FROM m WHERE home_goals IS NOT NULL GROUP BY season),
s AS (SELECT season, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, count(*) AS played FROM g GROUP BY season)
SELECT season, n, draws, points, gf, ga, played, points = 3 * n - draws AND gf = ga AND played = 2 * n AS kept FROM made JOIN s USING (season)""",
    sides=True,
)
def check_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.conservation(matches(spark, sf_dir))


@query(
    """, own AS (SELECT season, team, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS points, count(gf) AS played FROM t GROUP BY ALL),
stored AS (SELECT season, CASE WHEN team = 19 THEN 99 ELSE team END AS team, points + CASE WHEN team % 7 = 3 THEN 1 ELSE 0 END AS points, CASE WHEN team % 5 = 0 THEN NULL WHEN team % 9 = 4 THEN played - 1 ELSE played END AS played FROM own)
SELECT * FROM (SELECT s.season, s.team, CASE WHEN o.points IS NULL THEN 'no matches' WHEN o.points <> s.points THEN 'points' WHEN s.played IS NOT NULL AND o.played <> s.played THEN 'played' END AS reason FROM stored s LEFT JOIN own o USING (season, team)) WHERE reason IS NOT NULL""",
    sides=True,
)
def check_stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = st.totals(matches(spark, sf_dir))
    team = F.when(K("team") == 19, 99).otherwise(K("team"))
    played = F.when(K("team") % 5 == 0, None).when(K("team") % 9 == 4, K("played") - 1).otherwise(K("played"))
    stored = own.select("season", team.alias("team"), (K("points") + (K("team") % 7 == 3).cast("int")).alias("points"), played.alias("played"))
    return v.against_snapshot(own, stored)


@query("SELECT name_key, count(*) AS n FROM (SELECT regexp_replace(strip_accents(lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type || ' é.' END || p_size)), '[^a-z0-9]+', '', 'g') AS name_key FROM part) GROUP BY name_key HAVING count(*) > 1")
def check_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(K("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(K("p_type"), F.lit(" é."))), K("p_size"))
    return v.same_names(table(spark, sf_dir, "part").select(name.alias("name")))


@query(f"{DIRTY} SELECT match_id, h.n_name AS home, a.n_name AS away FROM x LEFT JOIN nation h ON h.n_nationkey = home_team LEFT JOIN nation a ON a.n_nationkey = away_team WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL AND (home_goals_ht > home_goals OR away_goals_ht > away_goals)", corpus=True)
def check_half_time_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    home, away = (n.select(K("n_nationkey").alias(f"{s}_team"), K("n_name").alias(s)) for s in ("home", "away"))
    return v.half_time_repairs(dirty(spark, sf_dir)).join(home, "home_team", "left").join(away, "away_team", "left").select("match_id", "home", "away")


@query(
    """, raw AS (SELECT 'club ' || home_team AS raw_name, season FROM m UNION ALL SELECT 'club ' || away_team, season FROM m), al AS (SELECT 'club ' || n_nationkey AS raw_name, n_name AS canonical FROM nation WHERE n_nationkey % 5 <> 2),
x AS (SELECT raw_name, season, CASE WHEN canonical IS NULL THEN 'no alias' WHEN NOT EXISTS (SELECT 1 FROM nation WHERE n_name = canonical AND n_nationkey % 4 <> 1) THEN 'no team' END AS kind FROM raw LEFT JOIN al USING (raw_name))
SELECT raw_name, kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT season))[1:4], ',') AS seasons FROM x WHERE kind IS NOT NULL GROUP BY ALL""",
    corpus=True,
)
def check_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    raw = sides(matches(spark, sf_dir)).select(F.concat(F.lit("club "), K("team")).alias("raw_name"), "season")
    aliases = n.where("n_nationkey % 5 <> 2").select(F.concat(F.lit("club "), K("n_nationkey")).alias("raw_name"), K("n_name").alias("canonical"))
    return v.alias_report(raw, aliases, n.where("n_nationkey % 4 <> 1").select(K("n_name").alias("canonical")))


_PART = "CAST(sum(CAST(CAST('0x' || substr(h, {0}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query(f"SELECT count(*) AS n, {_PART.format(1)} AS digest_0, {_PART.format(9)} AS digest_1 FROM (SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) AS h FROM orders)")
def check_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT event_type AS source, CAST(floor((epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(ts))) / 1000000) AS BIGINT) AS age_seconds FROM events GROUP BY event_type")
def check_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").groupBy(K("event_type").alias("source")).agg(F.max("ts").alias("last_success"))
    return v.freshness(log, F.lit("2030-01-01").cast("timestamp"))


@query(
    """, cal AS (SELECT season, home_team, away_team, kickoff + to_days(CAST(CASE WHEN home_team % 4 = 0 THEN 1 ELSE 0 END AS INT)) AS kickoff, away_team % 6 = 0 AS time_tbc FROM m WHERE season >= 2000), st AS (SELECT * FROM m WHERE away_team <> 5)
SELECT cal.season, count(st.kickoff) AS existing, count(*) FILTER (st.kickoff IS NULL) AS new, count(*) FILTER (CAST(st.kickoff AS DATE) <> CAST(cal.kickoff AS DATE)) AS other_date, count(*) FILTER (time_tbc) AS to_be_confirmed
FROM cal LEFT JOIN st ON cal.season = st.season AND cal.home_team = st.home_team AND cal.away_team = st.away_team GROUP BY cal.season""",
    corpus=True,
)
def check_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    moved = F.when(K("home_team") % 4 == 0, K("kickoff") + F.expr("interval 1 day")).otherwise(K("kickoff"))
    calendar = m.where("season >= 2000").select("season", "home_team", "away_team", moved.alias("kickoff"), (K("away_team") % 6 == 0).alias("time_tbc"))
    return v.calendar_differences(calendar, m.where("away_team <> 5"))


@query(f"{DIRTY} SELECT competition, count(DISTINCT match_id) AS matches, count(DISTINCT season) AS seasons, count(DISTINCT team) AS teams FROM (SELECT competition, match_id, season, home_team AS team FROM x UNION ALL SELECT competition, match_id, season, away_team FROM x) GROUP BY competition", corpus=True)
def check_data_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.data_state(dirty(spark, sf_dir))


@query(
    f"""{DIRTY}, src AS (SELECT season, home_team, away_team, CASE WHEN match_id % 61 = 0 THEN 9 ELSE home_goals END AS hg, away_goals AS ag, home_goals_ht AS hh, CASE WHEN match_id % 67 = 0 THEN NULL ELSE away_goals_ht END AS ah FROM x)
SELECT match_id, concat_ws('-', coalesce(home_goals, -1), coalesce(away_goals, -1)) AS old, concat_ws('-', coalesce(hg, -1), coalesce(ag, -1)) AS new FROM x JOIN src USING (season, home_team, away_team)
WHERE status = 'FT' AND (home_goals IS DISTINCT FROM hg OR away_goals IS DISTINCT FROM ag OR home_goals_ht IS DISTINCT FROM hh OR away_goals_ht IS DISTINCT FROM ah)""",
    corpus=True,
)
def check_score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dirty(spark, sf_dir)
    source = x.withColumns({"home_goals": F.when(K("match_id") % 61 == 0, 9).otherwise(K("home_goals")), "away_goals_ht": F.when(K("match_id") % 67 != 0, K("away_goals_ht"))})
    found = v.score_changes(x, source, ["match_id"])
    show = lambda c: F.concat_ws("-", F.coalesce(f"{c}.home_goals", F.lit(-1)), F.coalesce(f"{c}.away_goals", F.lit(-1)))
    return found.select("match_id", show("old").alias("old"), show("new").alias("new"))


@query()
def check_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expected tables the session's catalogue lacks; two are put into it first, since a new session has none."""
    for name in ("region", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return v.expected_tables(spark, ["region", "nation", "standings"]).where("name in ('region', 'nation', 'standings')")
