"""Queries on filters, joins, set operations, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.tables import matches, sides, table
from .registry import query

_T = "TIMESTAMP"


# ------------------------------------------------------------------ filters
@query(" SELECT match_id, kickoff, status FROM m WHERE season = 2000 AND (home_team = 3 OR away_team = 3) AND status = 'FT' ORDER BY kickoff DESC, match_id DESC LIMIT 25", corpus=True)
def filter_match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.list_matches(matches(spark, sf_dir), season=2000, team=3, status="FT", limit=25).select("match_id", "kickoff", "status")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def filter_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(" SELECT match_id, home_goals, away_goals FROM m WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL AND kickoff < TIMESTAMP '1998-06-01'", corpus=True)
def filter_completed_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.completed(matches(spark, sf_dir), F.lit("1998-06-01").cast("timestamp")).select("match_id", "home_goals", "away_goals")


@query(" SELECT match_id, kickoff FROM m WHERE home_goals IS NULL AND kickoff <= TIMESTAMP '2001-07-01'", corpus=True)
def filter_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.upcoming(matches(spark, sf_dir), F.lit("2001-07-01").cast("timestamp")).select("match_id", "kickoff")


@query(" SELECT match_id FROM m WHERE kickoff BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31 23:59:59'", corpus=True)
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = (F.lit(x).cast("timestamp") for x in ("1997-01-01", "1997-03-31 23:59:59"))
    return rel.between(matches(spark, sf_dir), first, last).select("match_id")


@query(" SELECT season, count(*) AS n FROM m WHERE kickoff < TIMESTAMP '1999-02-03' GROUP BY season", corpus=True)
def filter_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.visible(matches(spark, sf_dir), F.lit("1999-02-03").cast("timestamp")).groupBy("season").agg(F.count("*").alias("n"))


_RAW = """raw AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS home,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'MACHINERY' END AS away, c_nationkey AS n FROM customer)"""


@query(
    f"""WITH {_RAW}, x AS (SELECT id, CASE WHEN coalesce(home, '') = '' AND coalesce(away, '') = '' THEN 'blank' WHEN coalesce(home, '') = '' OR coalesce(away, '') = '' THEN 'missing team'
  WHEN NOT n < 20 THEN 'unmapped' WHEN home = away THEN 'self-play' WHEN n % 6 = 0 THEN 'bad date' END AS reason FROM raw)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY ALL"""
)
def filter_skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    home = F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment"))
    away = F.when(k % 7 == 0, None).when(k % 5 == 0, F.col("c_mktsegment")).otherwise("MACHINERY")
    date = F.when(F.col("c_nationkey") % 6 != 0, F.lit("2020-01-01").cast("date"))
    return c.select(F.coalesce(rel.reject_reason(home, away, F.col("c_nationkey") < 20, date), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(" SELECT CASE WHEN home_goals IS NULL THEN 'unplayed' ELSE 'played' END AS state, count(*) AS n FROM m GROUP BY ALL", corpus=True)
def filter_played_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select(rel.played_or_none(F.col("home_goals"), F.col("away_goals")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9, 14)")
def filter_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(rel.id_list("1, 5,9 ,14"))).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'null' ELSE props END IS NULL OR CASE WHEN event_id % 3 = 1 THEN 'null' ELSE props END = 'null'")
def filter_baseline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value and a JSON null both mean a baseline."""
    forced = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, "null").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").withColumn("forced", forced).where("forced is null or forced = 'null'").select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_status_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a1%'")
def filter_name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%a1%")).select("p_partkey", "p_name")


@query(" SELECT match_id, CAST(CAST(1 / odds_home AS DECIMAL(6, 5)) AS DOUBLE) AS p_home, CASE WHEN home_goals IS NOT NULL THEN home_goals || '-' || away_goals END AS score FROM m WHERE season = 2001", corpus=True)
def project_public_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals become doubles; internal columns go."""
    p = (1 / F.col("odds_home")).cast("decimal(6,5)").cast("double")
    score = F.when(F.col("home_goals").isNotNull(), F.concat_ws("-", "home_goals", "away_goals"))
    return matches(spark, sf_dir).where("season = 2001").select("match_id", p.alias("p_home"), score.alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def project_drop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large arrays are dropped from a result before it is stored."""
    whole = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.col("value")).alias("raw"))
    return table(spark, sf_dir, "events").select("event_id", whole.dropFields("raw").alias("s")).select("event_id", "s.k")


@query(" SELECT match_id, home_team, away_team, kickoff, home_goals, away_goals, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS outcome FROM m WHERE home_goals IS NOT NULL", corpus=True)
def project_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), 0).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(2)
    return rel.completed(matches(spark, sf_dir)).select("match_id", "home_team", "away_team", "kickoff", "home_goals", "away_goals", outcome.alias("outcome"))


@query(
    """, asked AS (SELECT match_id, CAST(match_id % 25 AS INT) AS fh, CAST(match_id % 3 AS INT) AS fa FROM m WHERE season >= 2000 AND home_team < 6
  UNION ALL SELECT match_id, 1, 1 FROM m WHERE season = 2001 AND home_team = 2 UNION ALL SELECT -5, 1, 1),
n AS (SELECT *, count(*) OVER (PARTITION BY match_id) AS times FROM asked)
SELECT n.match_id, fh AS f_home, fa AS f_away, CASE WHEN times > 1 THEN 'duplicate' WHEN m.season IS NULL THEN 'unknown match' WHEN season <> 2001 THEN 'wrong season' WHEN status <> 'NS' THEN 'already played'
  WHEN NOT (fh BETWEEN 0 AND 20 AND fa BETWEEN 0 AND 20) THEN 'bad goals' END AS fault FROM n LEFT JOIN m USING (match_id)""",
    corpus=True,
)
def filter_forced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    one = m.where("season >= 2000 and home_team < 6").select("match_id", (F.col("match_id") % 25).cast("int").alias("home_goals"), (F.col("match_id") % 3).cast("int").alias("away_goals"))
    two = m.where("season = 2001 and home_team = 2").select("match_id", F.lit(1).alias("home_goals"), F.lit(1).alias("away_goals"))
    odd = spark.range(1).select(F.lit(-5).cast("long").alias("match_id"), F.lit(1).alias("home_goals"), F.lit(1).alias("away_goals"))
    return rel.forced_result_fault(one.union(two).union(odd), m, season=2001)


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a1%' OR lower(p_name) LIKE '%b2%' OR lower(p_name) LIKE '%7%'")
def filter_any_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike("a1|b2|7")).select("p_partkey")


# -------------------------------------------------------------------- joins
@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def join_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.where("o_totalprice > 200000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query(" SELECT match_id, CAST(season AS VARCHAR) || '/' || CAST(season + 1 - 2000 AS VARCHAR) AS label FROM m WHERE home_goals IS NOT NULL", corpus=True)
def join_season_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rel.completed(matches(spark, sf_dir))
    label = F.concat_ws("/", F.col("season").cast("string"), (F.col("season") + 1 - 2000).cast("string"))
    seasons = m.select("season").distinct().withColumn("label", label)
    return m.join(seasons, "season").select("match_id", "label")


@query(" SELECT match_id, h.s_name AS home_name, a.s_name AS away_name FROM m JOIN supplier h ON h.s_suppkey = home_team JOIN supplier a ON a.s_suppkey = away_team", corpus=True)
def join_same_dimension_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = matches(spark, sf_dir), table(spark, sf_dir, "supplier")
    home, away = s.select(F.col("s_suppkey").alias("home_team"), F.col("s_name").alias("home_name")), s.select(F.col("s_suppkey").alias("away_team"), F.col("s_name").alias("away_name"))
    return m.join(home, "home_team").join(away, "away_team").select("match_id", "home_name", "away_name")


@query("SELECT n_nationkey, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey")
def join_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"))


@query(" SELECT s_suppkey AS team, count(*) AS games FROM supplier JOIN m ON s_suppkey IN (home_team, away_team) GROUP BY s_suppkey", corpus=True)
def join_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunctive join as an unpivot and an equi-join."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"))
    return sides(matches(spark, sf_dir)).join(s, "team").groupBy(F.col("team").cast("long").alias("team")).agg(F.count("*").alias("games"))


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(" SELECT a.season, a.home_team, a.away_team FROM m a LEFT JOIN (SELECT * FROM m WHERE odds_home > 3) b USING (season, home_team, away_team) WHERE b.match_id IS NULL", corpus=True)
def join_pairs_not_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    key = ["season", "home_team", "away_team"]
    return m.join(m.where("odds_home > 3").select(*key), key, "left_anti").select(*key)


@query("SELECT c_custkey, CAST(n_nationkey AS BIGINT) AS team_id FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def join_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("raw_name"), F.col("n_nationkey").cast("long").alias("team_id"))
    return rel.resolve(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("raw")), "raw", alias).select("c_custkey", "team_id")


@query(
    """SELECT s_suppkey, coalesce(a.n_name, b.r_name, 'canonical') AS team FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) a ON a.n_nationkey = s_nationkey
LEFT JOIN region b ON b.r_regionkey = s_suppkey % 9"""
)
def join_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("r", (F.col("s_suppkey") % 9).cast("int"))
    first = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    second = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    found = rel.resolve_by_priority(s, [("s_nationkey", first), ("r", second)], "team")
    return found.select("s_suppkey", F.coalesce("team", F.lit("canonical")).alias("team"))


@query(
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS k FROM events), y AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k FROM customer WHERE c_custkey % 5 = 0)
SELECT event_id FROM x WHERE EXISTS (SELECT 1 FROM y WHERE x.k IS NOT DISTINCT FROM y.k)"""
)
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("k"))
    y = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("j")).distinct()
    return x.join(y, F.col("k").eqNullSafe(F.col("j")), "left_semi").select("event_id")


@query(" SELECT a.season, a.home_team, a.away_team, count(*) AS n FROM m a JOIN (SELECT home_team, away_team FROM m WHERE season IN (1999, 2000)) b USING (home_team, away_team) WHERE a.season = 1998 GROUP BY ALL HAVING count(*) > 1", corpus=True)
def join_composite_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results matched to fixtures by (home, away), and fixtures that match more than once."""
    m = matches(spark, sf_dir)
    other = m.where("season in (1999, 2000)").select("home_team", "away_team")
    return m.where("season = 1998").join(other, ["home_team", "away_team"]).groupBy("season", "home_team", "away_team").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT user_id, event_id, ts FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY date_trunc('month', ts) DESC) AS r FROM events) WHERE r = 1")
def join_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each key's latest snapshot; a window, so no self-join."""
    month = F.date_trunc("month", "ts")
    return rel.ties_at_top(table(spark, sf_dir, "events"), ["user_id"], month.desc()).select("user_id", "event_id", "ts")


_PREDICTIONS = """p AS (SELECT event_id AS id, user_id AS match_id, event_id % 4 AS model_version, date_trunc('day', ts) AS as_of, date_trunc('hour', ts) AS predicted_at, value FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log read out of the event stream; many rows tie on both times."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), (F.col("event_id") % 4).alias("model_version"), F.date_trunc("day", "ts").alias("as_of"), F.date_trunc("hour", "ts").alias("predicted_at"), "value")


@query(f"WITH {_PREDICTIONS} SELECT match_id, id, value FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY as_of DESC, predicted_at DESC, id DESC) AS rn FROM p) WHERE rn = 1")
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c).desc() for c in ("as_of", "predicted_at", "id")]
    return rel.latest(predictions(spark, sf_dir), ["match_id"], *order).select("match_id", "id", "value")


@query(f"WITH {_PREDICTIONS} SELECT id, c_name, r_name FROM p JOIN customer ON match_id = c_custkey JOIN region ON r_regionkey = model_version WHERE value > 40")
def join_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, r = predictions(spark, sf_dir).where("value > 40"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    return p.join(c, F.col("match_id") == F.col("c_custkey")).join(r, F.col("r_regionkey") == F.col("model_version")).select("id", "c_name", "r_name")


@query(
    """, x AS (SELECT f.match_id, f.team, g.gf, g.ga, row_number() OVER (PARTITION BY f.match_id, f.team ORDER BY g.kickoff DESC, g.match_id DESC) AS age
  FROM t f JOIN t g ON f.team = g.team AND g.kickoff < f.kickoff WHERE g.gf IS NOT NULL)
SELECT match_id, team, count(*) AS n, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga FROM x WHERE age <= 10 GROUP BY ALL""",
    sides=True,
)
def join_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sides(matches(spark, sf_dir))
    fixtures = t.select("match_id", "team", F.col("kickoff").alias("as_of"))
    past = rel.history(fixtures, t.where("gf is not null"), last=10)
    return past.groupBy("match_id", "team").agg(F.count("*").alias("n"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))


@query(", k AS (SELECT DISTINCT team FROM t) SELECT a.team AS home_team, b.team AS away_team FROM k a JOIN k b ON a.team <> b.team", sides=True)
def join_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.ordered_pairs(sides(matches(spark, sf_dir)).select("team").distinct())


@query(
    """, a AS (SELECT team, avg(CAST(gf AS DOUBLE)) AS gf FROM t WHERE season = 1999 GROUP BY team), b AS (SELECT team, avg(CAST(gf AS DOUBLE)) AS gf FROM t WHERE season = 2000 GROUP BY team)
SELECT team, round(b.gf - a.gf, 9) AS gf_delta FROM a JOIN b USING (team)""",
    sides=True,
)
def join_paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sides(matches(spark, sf_dir))
    one, two = (t.where(F.col("season") == s).groupBy("team").agg(F.avg("gf").alias("gf")) for s in (1999, 2000))
    return rel.paired_delta(one, two, "team", ["gf"]).select("team", F.round("gf_delta", 9).alias("gf_delta"))


@query(
    """, lv AS (SELECT season, points, team FROM (SELECT season, team, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS points FROM t GROUP BY ALL))
SELECT a.season, a.team, b.team AS opponent FROM lv a JOIN lv b ON a.season = b.season AND a.points = b.points AND a.team <> b.team""",
    sides=True,
)
def join_level_on_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    table_ = sides(matches(spark, sf_dir)).groupBy("season", "team").agg(F.sum(pts).alias("points"))
    return table_.join(table_.withColumnRenamed("team", "opponent"), ["season", "points"]).where("team <> opponent").select("season", "team", "opponent")


_TIER = "CASE WHEN (team + season) % 5 = 0 THEN 2 ELSE 1 END"


@query(f""", ts AS (SELECT DISTINCT team, season, {_TIER} AS tier FROM t)
SELECT a.team, a.season, a.tier, CASE WHEN b.tier > a.tier THEN 1 ELSE 0 END AS promoted FROM ts a LEFT JOIN ts b ON a.team = b.team AND b.season = a.season - 1""", sides=True)
def join_previous_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when((F.col("team") + F.col("season")) % 5 == 0, 2).otherwise(1)
    return rel.promoted(sides(matches(spark, sf_dir)).select("team", "season", tier.alias("tier")).distinct())


# ----------------------------------------------------------- set operations
@query(" SELECT DISTINCT team FROM (SELECT home_team AS team FROM m WHERE season = 2000 UNION SELECT away_team FROM m WHERE season = 2000)", corpus=True)
def union_distinct_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).where("season = 2000")
    return m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query(", k AS (SELECT DISTINCT home_team AS x FROM m UNION SELECT away_team FROM m) SELECT a.x AS home_team, b.x AS away_team FROM k a JOIN k b ON a.x <> b.x EXCEPT SELECT home_team, away_team FROM m WHERE season = 2001 AND home_goals IS NOT NULL", corpus=True)
def except_missing_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    played = rel.completed(m.where("season = 2001"))
    teams = m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return rel.ordered_pairs(teams).join(played.select("home_team", "away_team"), ["home_team", "away_team"], "left_anti")


@query("SELECT 'missing' AS side, k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 40) UNION ALL SELECT 'unexpected', k FROM (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 40 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 2)")
def except_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_suppkey < 40").select(F.col("s_nationkey").alias("k"))
    return n.subtract(s).select(F.lit("missing").alias("side"), "k").union(s.subtract(n.where("k > 2")).select(F.lit("unexpected"), "k"))


@query(" SELECT match_id, 'played' AS part FROM m WHERE season = 2001 AND home_goals IS NOT NULL UNION ALL SELECT match_id, 'remaining' FROM m WHERE season = 2001 AND home_goals IS NULL", corpus=True)
def union_played_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).where("season = 2001")
    return m.where("home_goals is not null").select("match_id", F.lit("played").alias("part")).unionByName(m.where("home_goals is null").select("match_id", F.lit("remaining").alias("part")))


@query(" SELECT match_id FROM m WHERE season = 2000 AND home_team = 1 AND match_id NOT IN (SELECT match_id FROM m WHERE season = 2000 AND away_team < 10)", corpus=True)
def except_unknown_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).where("season = 2000")
    return m.where("home_team = 1").select("match_id").join(m.where("away_team < 10").select("match_id"), "match_id", "left_anti")


@query("SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT source FROM documents")
def distinct_raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("name")).distinct()


# --------------------------------------------------------------- aggregates
@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT n_name, coalesce(n, 0) AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def agg_zero_filled_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


@query("SELECT team, count(*) FILTER (venue = 'H') AS home_games, count(*) FILTER (venue = 'A') AS away_games FROM t GROUP BY team", sides=True)
def agg_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(matches(spark, sf_dir)).groupBy("team").agg(F.count_if(F.col("venue") == "H").alias("home_games"), F.count_if(F.col("venue") == "A").alias("away_games"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment")
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(" SELECT count(*) AS n, min(kickoff) AS first, max(kickoff) AS last, count(home_goals) AS scored FROM m", corpus=True)
def agg_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).agg(F.count("*").alias("n"), F.min("kickoff").alias("first"), F.max("kickoff").alias("last"), F.count("home_goals").alias("scored"))


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS upper_median FROM orders GROUP BY o_orderpriority")
def agg_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the two middle values, by rank rather than by collecting a group."""
    by = Window.partitionBy("o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", F.row_number().over(by.orderBy("o_totalprice")).alias("i"), F.count("*").over(by).alias("n"))
    return o.where("i = n div 2 + 1").select("o_orderpriority", F.col("o_totalprice").alias("upper_median"))


@query(" SELECT status, count(*) AS n FROM m GROUP BY status ORDER BY status", corpus=True)
def agg_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


@query("SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
def agg_correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").na.fill(0)


@query("SELECT p_brand, p_type, p_partkey AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def agg_pick_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each key, by an aggregate of structs."""
    best = F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey")))
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(best.alias("survivor"))


@query("SELECT date_trunc('hour', ts) AS cut, count(*) AS n FROM events GROUP BY 1")
def agg_hour_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("cut")).agg(F.count("*").alias("n"))


_OUT = "CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END"


@query(f" SELECT season, round(avg(CASE WHEN {_OUT} = 0 THEN 1.0 ELSE 0.0 END), 9) AS p_home, round(avg(CASE WHEN {_OUT} = 1 THEN 1.0 ELSE 0.0 END), 9) AS p_draw, round(avg(CASE WHEN {_OUT} = 2 THEN 1.0 ELSE 0.0 END), 9) AS p_away FROM m WHERE home_goals IS NOT NULL GROUP BY season", corpus=True)
def agg_base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, a = F.col("home_goals"), F.col("away_goals")
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return rel.completed(matches(spark, sf_dir)).groupBy("season").agg(rate(h > a).alias("p_home"), rate(h == a).alias("p_draw"), rate(h < a).alias("p_away"))


@query(" SELECT home_team, round(coalesce(avg(CASE WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END) FILTER (season < 1996), 0.25), 9) AS draw_rate FROM m WHERE home_goals IS NOT NULL GROUP BY home_team", corpus=True)
def agg_draw_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.when(F.col("season") < 1996, (F.col("home_goals") == F.col("away_goals")).cast("double"))
    return rel.completed(matches(spark, sf_dir)).groupBy("home_team").agg(F.round(F.coalesce(F.avg(draw), F.lit(0.25)), 9).alias("draw_rate"))


@query("SELECT s_nationkey, round(stddev_pop(s_acctbal), 6) AS spread FROM supplier GROUP BY s_nationkey")
def agg_population_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.stddev_pop("s_acctbal"), 6).alias("spread"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY o_orderpriority")
def agg_interval_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.975)))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(q.alias("q")).select("o_orderpriority", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("SELECT l_returnflag, l_linenumber, n, round(n / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE), 9) AS share FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)")
def agg_position_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 9))


@query("SELECT o_orderstatus, o_orderkey // 1000 AS part, md5(string_agg(md5(o_orderkey || '|' || o_custkey), '' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY ALL")
def agg_row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ordered rows, a thousand keys at a time, so that no list grows with the table."""
    o = table(spark, sf_dir, "orders").withColumn("part", F.floor(F.col("o_orderkey") / 1000))
    row = F.struct("o_orderkey", F.md5(F.concat_ws("|", "o_orderkey", "o_custkey")).alias("d"))
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"]), ""))
    return o.groupBy("o_orderstatus", "part").agg(whole.alias("digest"), F.count("*").alias("n"))


@query(
    """SELECT o_orderstatus, md5(concat_ws('|', sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)), count(*))) AS digest, count(*) AS n
FROM (SELECT o_orderstatus, md5(concat_ws('|', o_orderkey, o_custkey)) AS h FROM orders) GROUP BY o_orderstatus"""
)
def agg_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all rows of each status, by sums of their hashes: partial sums, no lists, whatever the order of rows."""
    h = F.md5(F.concat_ws("|", "o_orderkey", "o_custkey").cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    whole = F.md5(F.concat_ws("|", part(1), part(16), F.count("*").cast("string")).cast("binary"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(whole.alias("digest"), F.count("*").alias("n"))


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def agg_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "orders", "lineitem"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_type, round(avg(m), 9) AS mean FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def agg_mean_over_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.round(F.avg("m"), 9).alias("mean"))


@query(" SELECT home_team, array_to_string(list_sort(list(DISTINCT season))[1:4], ',') AS seasons FROM m GROUP BY home_team", corpus=True)
def agg_seasons_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.slice(F.sort_array(F.collect_set("season")), 1, 4)
    return matches(spark, sf_dir).groupBy("home_team").agg(F.array_join(seen, ",").alias("seasons"))


@query(", x AS (SELECT team, kickoff, row_number() OVER (PARTITION BY team ORDER BY kickoff, match_id) AS i, count(*) OVER (PARTITION BY team) AS n FROM t WHERE season = 1999) SELECT team, n AS appearances, kickoff AS twentieth FROM x WHERE i = 20", sides=True)
def agg_nth_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("team")
    t = sides(matches(spark, sf_dir)).where("season = 1999")
    return t.select("team", "kickoff", F.row_number().over(by.orderBy("kickoff", "match_id")).alias("i"), F.count("*").over(by).alias("appearances")).where("i = 20").select("team", "appearances", F.col("kickoff").alias("twentieth"))


# -------------------------------------------------------------------- top-k
@query("SELECT n_nationkey, n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def sort_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_regionkey", "n_name")


@query(" SELECT DISTINCT season FROM m ORDER BY season DESC", corpus=True)
def sort_seasons_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("season").distinct().orderBy(F.col("season").desc())


@query(" SELECT * FROM (SELECT match_id, kickoff FROM m WHERE home_goals IS NOT NULL ORDER BY kickoff DESC, match_id DESC LIMIT 50) ORDER BY kickoff, match_id", corpus=True)
def topk_recent_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = rel.completed(matches(spark, sf_dir)).select("match_id", "kickoff").orderBy(F.col("kickoff").desc(), F.col("match_id").desc()).limit(50)
    return recent.orderBy("kickoff", "match_id")


@query(" SELECT match_id, kickoff FROM m WHERE season = 1997 ORDER BY kickoff, match_id", corpus=True)
def sort_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where("season = 1997").select("match_id", "kickoff").orderBy("kickoff", "match_id")


@query(" SELECT match_id, kickoff FROM m WHERE status = 'NS' ORDER BY kickoff, match_id LIMIT 10", corpus=True)
def topk_next_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where("status = 'NS'").select("match_id", "kickoff").orderBy("kickoff", "match_id").limit(10)


@query("SELECT event_type FROM (SELECT event_type, avg(value) AS loss FROM events GROUP BY 1) ORDER BY loss, event_type LIMIT 1")
def topk_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("loss")).orderBy("loss", "event_type").limit(1).select("event_type")


@query("SELECT k, arg_min(event_type, loss) AS winner FROM (SELECT user_id % 7 AS k, event_type, avg(value) AS loss FROM events GROUP BY ALL) GROUP BY k")
def topk_season_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("k"), "event_type").agg(F.avg("value").alias("loss"))
    return e.groupBy("k").agg(F.min_by("event_type", "loss").alias("winner"))


@query("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("rn", place).where("rn <= 5").select("p_type", "p_partkey")


@query("SELECT s_nationkey, s_suppkey AS survivor FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name, s_suppkey) AS rn FROM supplier) WHERE rn = 1")
def topk_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.latest(table(spark, sf_dir, "supplier"), ["s_nationkey"], F.col("s_acctbal").desc(), F.col("s_name"), F.col("s_suppkey")).select("s_nationkey", F.col("s_suppkey").alias("survivor"))


@query("WITH p AS (SELECT event_id AS id, user_id AS match_id, date_trunc('day', ts) AS as_of FROM events) SELECT id, match_id, as_of FROM p ORDER BY as_of, id LIMIT 200")
def topk_paged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("id", "match_id", "as_of").orderBy("as_of", "id").limit(200)


@query("SELECT event_id % 4 AS model_version FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def topk_most_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = predictions(spark, sf_dir).groupBy("model_version").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("model_version", F.struct("n", -F.col("model_version"))).alias("model_version"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_name")
def sort_players_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name").orderBy("c_name")
