"""Queries on scalar functions: text, dates, numbers, odds, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..sources.tables import matches, table
from .registry import query

K = F.col


@query("SELECT c_custkey, regexp_replace(strip_accents(lower(CASE WHEN c_custkey % 3 = 0 THEN 'Atlético ' ELSE 'Córdoba C.F. ' END || c_name)), '[^a-z0-9]+', '', 'g') AS name_key FROM customer")
def text_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(K("c_custkey") % 3 == 0, "Atlético ").otherwise("Córdoba C.F. "), K("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_key(name).alias("name_key"))


_BLANK = "CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN '' WHEN 2 THEN ' ' || c_mktsegment || ' ' END"


@query(f"SELECT c_custkey, nullif(trim({_BLANK}), '') AS cleaned FROM customer")
def text_blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("c_custkey") % 4
    raw = F.when(k == 0, "  ").when(k == 1, "").when(k == 2, F.concat(F.lit(" "), K("c_mktsegment"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.cleaned(raw).alias("cleaned"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 38 AS INT) END AS matchday FROM orders")
def text_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(K("o_orderkey") % 3 == 0, "Relegation Round").otherwise(F.concat(F.lit("Regular Season - "), (K("o_orderkey") % 38).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.last_number(raw).alias("matchday"))


@query(
    """SELECT y, CAST(y AS VARCHAR) || '/' || CAST(y - 1999 AS VARCHAR) AS label, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS code,
  CAST(substr(lpad(CAST(y % 100 AS VARCHAR), 2, '0'), 1, 2) AS INT) + 2000 AS back FROM (SELECT DISTINCT CAST(2000 + o_orderkey % 26 AS INT) AS y FROM orders)"""
)
def text_season_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").select((F.lit(2000) + K("o_orderkey") % 26).cast("int").alias("y")).distinct()
    code = text.season_code(K("y"))
    return y.select("y", text.season_label(K("y")).alias("label"), code.alias("code"), text.code_year(code).alias("back"))


@query(" SELECT match_id, home_team || ' vs ' || away_team AS fixture, CAST(home_team AS VARCHAR) AS home, CAST(away_team AS VARCHAR) AS away, CAST(match_id % 7 AS INT) AS hg, CAST(match_id % 4 AS INT) AS ag FROM m", corpus=True)
def text_fixture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture's key, and a forced result written out and parsed again."""
    written = F.concat(K("home_team"), F.lit(":"), K("away_team"), F.lit(":"), K("match_id") % 7, F.lit("-"), K("match_id") % 4)
    m = matches(spark, sf_dir).select("match_id", text.fixture_key(K("home_team"), K("away_team")).alias("fixture"), text.forced_result(written).alias("f"))
    return m.select("match_id", "fixture", "f.home", "f.away", K("f.home_goals").alias("hg"), K("f.away_goals").alias("ag"))


@query("SELECT p_partkey, substr(upper(replace(p_type || ' ' || p_name, ' ', '_')), 1, 50) AS code FROM part")
def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.code_of(F.concat_ws(" ", "p_type", "p_name")).alias("code"))


@query("SELECT event_id, substr(sha1('{\"a\":' || event_id || ',\"b\":' || user_id || '}'), 1, 16) AS feature_hash, sha256(props) AS tag FROM events")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of named values whatever their order, and a tag of a body."""
    values = F.create_map(F.lit("b"), K("user_id"), F.lit("a"), K("event_id"))
    return table(spark, sf_dir, "events").select("event_id", text.feature_hash(values).alias("feature_hash"), text.body_tag(K("props")).alias("tag"))


_DATES = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%d/%m/%y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') || ' 18:30' WHEN 4 THEN 'soon' END"""


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN CAST(o_orderdate AS DATE) END AS d
FROM orders"""
)
def date_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = K("o_orderkey") % 6, K("o_orderdate")
    later = d + F.expr("interval 10 years")
    raw = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 1, F.date_format(later, "dd/MM/yy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 3, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 18:30")))
        .when(k == 4, "soon")
    )
    # two digits mean this century
    return table(spark, sf_dir, "orders").withColumn("raw", raw).select("o_orderkey", dates.any_date(K("raw")).alias("d"))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_seconds(CASE o_orderkey % 4 WHEN 0 THEN 9 * 3600 + 300 WHEN 1 THEN 21 * 3600 ELSE 20 * 3600 END) AS kickoff FROM orders"""
)
def date_kickoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K("o_orderkey") % 4
    time = F.when(k == 0, "9:05").when(k == 1, "21:00:00").when(k == 2, "late")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.kickoff(F.date_format("o_orderdate", "dd/MM/yyyy"), time).alias("kickoff"))


@query("SELECT event_id, date_trunc('second', ts) - to_seconds((event_id % 3) * 3600) AS utc FROM events")
def date_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(K("event_id") % 3 == 0, "Z").when(K("event_id") % 3 == 1, "+01:00").otherwise("+02:00")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", dates.zoned(raw).alias("utc"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', ts) END AS kickoff FROM events")
def date_epoch_or_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = K("ts").cast("timestamp")
    raw = F.when(K("event_id") % 3 == 0, F.unix_timestamp(ts).cast("string")).when(K("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", dates.epoch_or_iso(raw, F.timestamp_seconds(F.lit(0))).alias("kickoff"))


@query(" SELECT match_id, round(exp(-0.00128 * (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(kickoff)) / CAST(86400000000 AS DOUBLE)), 9) AS weight, kickoff + INTERVAL 14 DAY AS horizon, kickoff + INTERVAL 1 microsecond AS after FROM m", corpus=True)
def date_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = dates.age_days(F.lit("2002-01-01").cast("timestamp"), K("kickoff"))
    return matches(spark, sf_dir).select("match_id", F.round(dates.decay(0.00128, age), 9).alias("weight"), (K("kickoff") + F.expr("interval 14 days")).alias("horizon"), (K("kickoff") + F.expr("interval 1 microsecond")).alias("after"))


_CELL = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || '.0' WHEN 3 THEN p_size || '.9' WHEN 4 THEN 'n/a' END"


def _cell():
    k, n = K("p_partkey") % 6, K("p_size").cast("string")
    return F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.concat(n, F.lit(".9"))).when(k == 4, "n/a")


@query(f"SELECT p_partkey, CAST(trunc(TRY_CAST(nullif(trim({_CELL}), '') AS DOUBLE)) AS INT) AS n, TRY_CAST(nullif(trim({_CELL}), '') AS DOUBLE) AS x FROM part")
def number_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.lenient_int(_cell()).alias("n"), numbers.lenient_float(_cell()).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 4 END AS d FROM part")
def number_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(K("p_partkey") % 2 == 0, K("p_size").cast("string")).otherwise(" ")
    decimal = F.when(K("p_partkey") % 3 == 0, "-1.5").otherwise((K("p_size") / 4).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.strict_int(whole).alias("n"), numbers.positive_decimal(decimal).cast("double").alias("d"))


_BOOKS = """b AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN NULL ELSE odds_home END AS h1, odds_draw AS d1, odds_away AS a1,
  odds_home + 0.25 AS h2, odds_draw + 0.25 AS d2, CASE WHEN match_id % 5 = 0 THEN NULL ELSE odds_away + 0.5 END AS a2, 0.75 + (match_id % 4) * 0.5 AS h3, odds_draw AS d3, odds_away AS a3 FROM m),
i AS (SELECT *, h1 + d1 + a1 AS t1, h2 + d2 + a2 AS t2, h3 + d3 + a3 AS t3 FROM b)"""


def _books(spark: SparkSession, sf_dir: str):
    k = K("match_id")
    m = matches(spark, sf_dir).select(
        "match_id", F.when(k % 3 != 0, K("odds_home")).alias("h1"), K("odds_draw").alias("d1"), K("odds_away").alias("a1"), (K("odds_home") + 0.25).alias("h2"), (K("odds_draw") + 0.25).alias("d2"),
        F.when(k % 5 != 0, K("odds_away") + 0.5).alias("a2"), (F.lit(0.75) + (k % 4) * 0.5).alias("h3"), K("odds_draw").alias("d3"), K("odds_away").alias("a3"),
    )
    return m, [tuple(K(f"{c}{i}") for c in "hda") for i in (1, 2, 3)]


def _share(i: int, n: int) -> str:
    over = f"(1.0 / h{i} + 1.0 / d{i} + 1.0 / a{i})"
    return ", ".join(f"round_even(CAST(1.0 / {c}{i} / {over} AS DOUBLE), {n})" for c in "hda")


def _pick(cases: list[tuple[str, int]], n: int) -> str:
    out = []
    for at, name in enumerate(("home", "draw", "away")):
        out.append("CASE " + " ".join(f"WHEN {when} THEN {_share(i, n).split(', ')[2 * at]}, {_share(i, n).split(', ')[2 * at + 1]}" for when, i in cases) + f" END AS {name}")
    return ", ".join(out)


_LONGEST = [("coalesce(t1, -1) >= coalesce(t2, -1) AND coalesce(t1, -1) >= t3", 1), ("coalesce(t2, -1) >= t3", 2), ("true", 3)]


@query(f", {_BOOKS} SELECT match_id, {_pick(_LONGEST, 5)} FROM i", corpus=True)
def market_longest_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books = _books(spark, sf_dir)
    return m.select("match_id", numbers.market_longest(books).alias("p")).select("match_id", "p.*")


@query(f", {_BOOKS} SELECT match_id, {_pick([('t1 IS NOT NULL', 1), ('t2 IS NOT NULL', 2), ('true', 3)], 4)} FROM i", corpus=True)
def market_first_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books = _books(spark, sf_dir)
    return m.select("match_id", numbers.market_first(books).alias("p")).select("match_id", "p.*")


@query(f", {_BOOKS} SELECT match_id, {_pick([('h3 > 1', 3), ('t1 IS NOT NULL', 1)], 4)} FROM i", corpus=True)
def market_first_above_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, books = _books(spark, sf_dir)
    return m.select("match_id", numbers.market_first([books[2], books[0]], above=1.0).alias("p")).select("match_id", "p.*")


_P3 = "q AS (SELECT match_id, 0.1 + (match_id % 31) / 50.0 AS a, CASE WHEN match_id % 9 = 0 THEN NULL ELSE 0.1 + (match_id % 17) / 50.0 END AS b, 0.1 + (match_id % 23) / 50.0 AS c FROM m)"


def _p3(spark: SparkSession, sf_dir: str):
    k = K("match_id")
    m = matches(spark, sf_dir).select("match_id", (F.lit(0.1) + (k % 31) / 50).alias("a"), F.when(k % 9 != 0, F.lit(0.1) + (k % 17) / 50).alias("b"), (F.lit(0.1) + (k % 23) / 50).alias("c"))
    return m, tuple(K(c) for c in "abc")


@query(f", {_P3} SELECT match_id, round(CAST(a / (a + b + c) AS DOUBLE), 9) AS home, round(CAST(b / (a + b + c) AS DOUBLE), 9) AS draw, round(CAST(c / (a + b + c) AS DOUBLE), 9) AS away FROM q", corpus=True)
def market_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = _p3(spark, sf_dir)
    return m.select("match_id", numbers.market_renormalised(p).alias("p")).select("match_id", *[F.round(f"p.{c}", 9).alias(c) for c in ("home", "draw", "away")])


_R5 = "round_even(CAST({0} AS DOUBLE) / CAST(a + b + c AS DOUBLE), 5)"


@query(
    f""", {_P3}, rd AS (SELECT match_id, {_R5.format('a')} AS h, {_R5.format('b')} AS d, {_R5.format('c')} AS w FROM q WHERE b IS NOT NULL), s AS (SELECT *, round_even(1.0 - (h + d + w), 5) AS rest, CASE WHEN h >= d AND h >= w THEN 0 WHEN d >= w THEN 1 ELSE 2 END AS top FROM rd)
SELECT match_id, round(CASE WHEN top = 0 THEN h + rest ELSE h END, 6) AS home, round(CASE WHEN top = 1 THEN d + rest ELSE d END, 6) AS draw, round(CASE WHEN top = 2 THEN w + rest ELSE w END, 6) AS away FROM s""",
    corpus=True,
)
def probabilities_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = _p3(spark, sf_dir)
    some = m.where("b is not null").select("match_id", numbers.rebalanced(tuple(x / (p[0] + p[1] + p[2]) for x in p)).alias("p"))
    return some.select("match_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("home", "draw", "away")])


@query(" SELECT match_id, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 WHEN home_goals < away_goals THEN 2 END AS outcome, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 WHEN home_goals IS NOT NULL THEN 0 END AS home_points, 7 IN (home_team, away_team) AS involves_seven FROM m", corpus=True)
def number_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = numbers.outcome(K("home_goals"), K("away_goals"))
    return matches(spark, sf_dir).select("match_id", o.alias("outcome"), F.when(o == 0, 3).when(o == 1, 1).when(o == 2, 0).alias("home_points"), F.array_contains(F.array("home_team", "away_team"), 7).alias("involves_seven"))


@query(
    """ SELECT match_id, round(CASE WHEN home_goals = 0 AND away_goals = 0 THEN 1 - 1.4 * 1.1 * -0.05 WHEN home_goals = 0 AND away_goals = 1 THEN 1 + 1.4 * -0.05 WHEN home_goals = 1 AND away_goals = 0 THEN 1 + 1.1 * -0.05
  WHEN home_goals = 1 AND away_goals = 1 THEN 1 + 0.05 ELSE 1 END, 9) AS factor, round(ln(factorial(home_goals)), 9) AS log_fact FROM m WHERE home_goals IS NOT NULL""",
    corpus=True,
)
def number_low_score_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, mu, rho = F.lit(1.4), F.lit(1.1), F.lit(-0.05)
    m = matches(spark, sf_dir).where("home_goals is not null")
    return m.select("match_id", F.round(numbers.low_score_factor(K("home_goals"), K("away_goals"), lam, mu, rho), 9).alias("factor"), F.round(numbers.log_factorial(K("home_goals")), 9).alias("log_fact"))


_FEED = "(['FT', 'AET', 'PEN', 'AWD', 'WO', 'NS', '1H', 'PST', 'BT', 'P', 'TBD'])"


@query(f"WITH s AS (SELECT event_id, {_FEED}[event_id % 11 + 1] AS raw FROM events) SELECT event_id, CASE WHEN raw IN ('FT', 'AET', 'PEN', 'AWD', 'WO') THEN 'FT' WHEN raw IN ('1H', 'PST', 'TBD') THEN raw ELSE 'NS' END AS status FROM s")
def number_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = F.array(*[F.lit(s) for s in ("FT", "AET", "PEN", "AWD", "WO", "NS", "1H", "PST", "BT", "P", "TBD")])
    return table(spark, sf_dir, "events").select("event_id", numbers.status_of(F.element_at(feed, (K("event_id") % 11 + 1).cast("int"))).alias("status"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_sum(e), 6) AS total, list_position(e, list_max(e)) AS top, round(list_sum(e[1:4]), 6) AS cum4 FROM v")
def array_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, first largest place and a running sum over an array, without exploding it."""
    e = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return v.select("vec_id", F.round(total(K("e")), 6).alias("total"), F.array_position("e", F.array_max("e")).cast("int").alias("top"), F.round(total(F.slice("e", 1, 4)), 6).alias("cum4"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing.deep') AS VARCHAR), 'none') AS deep FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields with a default where any step is missing."""
    parsed = F.from_json("props", "k long, missing struct<deep: string>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("j")).select("event_id", "j.k", F.coalesce("j.missing.deep", F.lit("none")).alias("deep"))


def feed_rows(orders: DataFrame) -> DataFrame:
    """A feed's lists of lists of rows, flattened; built from orders and parsed again."""
    k = K("o_orderkey")
    item = lambda i: F.named_struct(F.lit("rank"), F.lit(i + 1), F.lit("team"), F.named_struct(F.lit("id"), (k + i) % 20))
    feed = F.to_json(F.struct(F.array(F.array(item(0), item(1)), F.array(item(2))).alias("standings")))
    schema = "standings array<array<struct<rank: int, team: struct<id: int>>>>"
    rows = orders.select("o_orderkey", F.explode(F.flatten(F.from_json(feed, schema)["standings"])).alias("r"))
    return rows.select("o_orderkey", K("r.rank").cast("long").alias("position"), K("r.team.id").alias("team"))


@query("SELECT o_orderkey, 1 + i AS position, CAST((o_orderkey + i) % 20 AS INT) AS team FROM orders, range(3) x(i)")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_rows(table(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, 1 + i AS position, CAST((o_orderkey + i) % 20 AS INT) AS team FROM orders, range(3) x(i)")
def json_flatten_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by the name that it had when the other query read a tenth only."""
    return feed_rows(table(spark, sf_dir, "orders"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'db' WHEN c_custkey % 3 = 0 THEN 'file' ELSE 'none' END AS origin FROM customer")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups merged so that the first has the say, and a default."""
    db = F.when(K("c_custkey") % 5 == 0, F.create_map(F.lit("origin"), F.lit("db"))).otherwise(F.create_map().cast("map<string,string>"))
    file = F.when(K("c_custkey") % 3 == 0, F.create_map(F.lit("origin"), F.lit("file"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(db, F.map_filter(file, lambda k, _: ~F.map_contains_key(db, k)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.try_element_at(merged, F.lit("origin")), F.lit("none")).alias("origin"))


@query()
def text_name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names to canonical ones: the exact name, else the likest above the cut."""
    from ..operators.entities import propose_names

    nations = table(spark, sf_dir, "nation").select(K("n_name").alias("canonical"))
    raw = table(spark, sf_dir, "nation").select(F.concat(F.lower(K("n_name")), F.when(K("n_nationkey") % 2 == 0, " fc").otherwise("")).alias("raw"))
    return propose_names(raw, nations)
