"""Queries on rolling form, cuts and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..sources.tables import matches, sides, table
from .registry import SQL, query


def played_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(matches(spark, sf_dir).where("home_goals is not null"))


PTS = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
DAYS = "(epoch_us(kickoff) - epoch_us(lag(kickoff) OVER o)) / CAST(86400000000 AS DOUBLE)"
PLAYED = f""",
g AS (SELECT *, {PTS} AS pts FROM t WHERE gf IS NOT NULL),
f AS (SELECT *, count(*) OVER w AS n, coalesce(avg(CAST(pts AS DOUBLE)) OVER w, 1.35) AS ppg, coalesce(avg(CAST(gf AS DOUBLE)) OVER w, 1.35) AS goals_for, coalesce(avg(CAST(ga AS DOUBLE)) OVER w, 1.35) AS goals_against,
  coalesce(CAST(sum(sot) OVER w AS DOUBLE), 0) AS s1, coalesce(CAST(sum(sot_against) OVER w AS DOUBLE), 0) AS s2,
  coalesce(avg(CASE WHEN pts = 3 THEN 1.0 ELSE 0.0 END) OVER w, 0.35) AS win_rate, CASE WHEN {DAYS} IS NULL THEN 7.0 ELSE least(greatest({DAYS}, 0.0), 14.0) END AS rest_days
  FROM g WINDOW w AS (PARTITION BY team ORDER BY kickoff, match_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY team ORDER BY kickoff, match_id)),
form AS (SELECT *, CASE WHEN s1 + s2 > 0 THEN s1 / (s1 + s2) ELSE 0.5 END AS sot_share FROM f)"""


def _round(names: list[str]):
    return [F.round(c, 9).alias(c) for c in names]


@query(f"{PLAYED} SELECT match_id, team, round(ppg, 9) AS ppg, round(goals_for, 9) AS goals_for, round(goals_against, 9) AS goals_against, round(sot_share, 9) AS sot_share, round(win_rate, 9) AS win_rate, round(rest_days, 9) AS rest_days, CAST(n AS DOUBLE) AS matches_played FROM form", sides=True)
def form_last_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.team_form(played_sides(spark, sf_dir)).select("match_id", "team", *_round(ft.FORM))


_COLS = ["ppg", "goals_for", "goals_against", "sot_share", "win_rate", "rest_days"]


@query(
    f"{PLAYED} SELECT h.match_id, h.season, h.kickoff, CASE WHEN h.gf > h.ga THEN 0 WHEN h.gf = h.ga THEN 1 ELSE 2 END AS outcome, "
    + ", ".join(f"round({p}.{c}, 9) AS {n}_{c}" for p, n in (("h", "home"), ("a", "away")) for c in _COLS)
    + ", CAST(h.n AS DOUBLE) AS home_matches_played, CAST(a.n AS DOUBLE) AS away_matches_played FROM form h JOIN form a ON h.match_id = a.match_id AND h.venue = 'H' AND a.venue = 'A'",
    sides=True,
)
def form_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_dataset(played_sides(spark, sf_dir))


def rounded_dataset(team_games: DataFrame) -> DataFrame:
    d = ft.form_dataset(team_games)
    return d.select("match_id", "season", "kickoff", "outcome", *_round([c for c in d.columns if c.startswith(("home_", "away_"))]))


@query(f"SELECT * FROM ({SQL['form_last_six']}) WHERE match_id // 1000000 = 2001")
def form_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last season's form from the windows as they stood before it."""
    games = played_sides(spark, sf_dir)
    new = ft.continued_form(ft.rolling_state(games.where("season < 2001")), games.where("season = 2001"))
    return new.select("match_id", "team", *_round(ft.FORM))


VENUE = f""",
g AS (SELECT *, {PTS} AS pts FROM t WHERE gf IS NOT NULL),
v AS (SELECT match_id, team, venue, kickoff, coalesce(avg(CAST(pts AS DOUBLE)) OVER w, 1.35) AS ppg_l10, coalesce(avg(CAST(gf AS DOUBLE)) OVER w, CASE WHEN venue = 'H' THEN 1.5 ELSE 1.14 END) AS goals_for_l10,
  coalesce(avg(CAST(ga AS DOUBLE)) OVER w, CASE WHEN venue = 'H' THEN 1.14 ELSE 1.5 END) AS goals_against_l10, coalesce(avg(CAST(sot AS DOUBLE)) OVER w, CASE WHEN venue = 'H' THEN 4.65 ELSE 3.63 END) AS sot_for_l10,
  coalesce(avg(CAST(sot_against AS DOUBLE)) OVER w, CASE WHEN venue = 'H' THEN 3.63 ELSE 4.65 END) AS sot_against_l10
  FROM g WINDOW w AS (PARTITION BY team, venue ORDER BY kickoff, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
rest AS (SELECT match_id, round(max(CASE WHEN venue = 'H' THEN r END) - max(CASE WHEN venue = 'A' THEN r END), 9) AS rest_days_diff
  FROM (SELECT match_id, venue, CASE WHEN {DAYS} IS NULL THEN 30.0 ELSE least(greatest({DAYS}, 0.0), 30.0) END AS r FROM g WINDOW o AS (PARTITION BY team ORDER BY kickoff, match_id)) GROUP BY match_id),
day AS (SELECT match_id, matchday FROM (SELECT match_id, venue, 1 + count(*) OVER (PARTITION BY team, season ORDER BY kickoff, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS matchday FROM g) WHERE venue = 'H')"""
_V = ["ppg_l10", "goals_for_l10", "goals_against_l10", "sot_for_l10", "sot_against_l10"]


@query(f"{VENUE} SELECT match_id, team, venue, " + ", ".join(f"round({c}, 9) AS {c}" for c in _V) + " FROM v", sides=True)
def form_by_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.venue_form(played_sides(spark, sf_dir)).select("match_id", "team", "venue", *_round(_V))


@query(f"{VENUE} SELECT match_id, rest_days_diff FROM rest", sides=True)
def form_rest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.rest_difference(played_sides(spark, sf_dir)).select("match_id", F.round("rest_days_diff", 9).alias("rest_days_diff"))


@query(f"{VENUE} SELECT match_id, matchday FROM day", sides=True)
def form_derived_matchday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.derived_matchday(played_sides(spark, sf_dir))


def tiers(games: DataFrame) -> DataFrame:
    """Matches inside one tier, which a rule of team and season gives."""
    tier = lambda t: F.when((F.col(t) + F.col("season")) % 5 == 0, 2).otherwise(1)
    return games.withColumns({"tier": tier("home_team"), "away_tier": tier("away_team")}).where("tier = away_tier").withColumn("competition", F.col("tier"))


_TIER = """, x AS (SELECT *, CASE WHEN (home_team + season) % 5 = 0 THEN 2 ELSE 1 END AS tier FROM m WHERE ((home_team + season) % 5 = 0) = ((away_team + season) % 5 = 0)),
b AS (SELECT DISTINCT season + 1 AS season, team, tier FROM (SELECT season, home_team AS team, tier FROM x UNION SELECT season, away_team, tier FROM x)),
pro AS (SELECT x.match_id, x.tier, max(CASE WHEN p.team IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.season = x.season AND b.team = p.team AND b.tier = x.tier) AND p.tier > x.tier THEN 1 ELSE 0 END) AS promotion_flag
  FROM x LEFT JOIN b p ON p.season = x.season AND p.team IN (x.home_team, x.away_team) GROUP BY ALL)"""


@query(f"{_TIER} SELECT match_id, promotion_flag FROM pro", corpus=True)
def form_promotion_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tiers(matches(spark, sf_dir))
    return ft.promotion_flag(x, x)


_VECTOR_TIER = _TIER


@query(
    f"{VENUE}{_VECTOR_TIER} SELECT h.match_id, " + ", ".join(f"round({p}.{c}, 9) AS {n}_{c}" for p, n in (("h", "home"), ("a", "away")) for c in _V)
    + ", rest_days_diff, matchday, promotion_flag, tier AS division_tier FROM v h JOIN v a ON h.match_id = a.match_id AND h.venue = 'H' AND a.venue = 'A' JOIN rest ON rest.match_id = h.match_id JOIN day ON day.match_id = h.match_id JOIN pro ON pro.match_id = h.match_id",
    sides=True,
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point-in-time vector but for the rating difference, which SQL does not fold."""
    games = matches(spark, sf_dir).where("home_goals is not null")
    t, x = sides(games), tiers(matches(spark, sf_dir))
    none = games.select("match_id", F.lit(0.0).alias("elo_diff"))
    promotions = ft.promotion_flag(x, x).join(x.select("match_id", F.col("tier").alias("division_tier")), "match_id")
    d = ft.feature_vector(t, none, promotions).drop("elo_diff")
    return d.select("match_id", "matchday", "promotion_flag", "division_tier", *_round([c for c in d.columns if c not in ("match_id", "matchday", "promotion_flag", "division_tier")]))


@query(f", g AS (SELECT *, {PTS} AS pts, row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, match_id DESC) AS age FROM t WHERE gf IS NOT NULL) SELECT team, count(*) AS n, CAST(sum(pts) AS BIGINT) AS points, min(kickoff) AS oldest FROM g WHERE age <= 6 GROUP BY team", sides=True)
def form_state_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported windows, read back."""
    state = ft.rolling_state(played_sides(spark, sf_dir))
    return state.select("team", F.explode("window").alias("x")).groupBy("team").agg(F.count("*").alias("n"), F.sum("x.points").alias("points"), F.min("x.kickoff").alias("oldest"))


@query(", x AS (SELECT season, team, kickoff, row_number() OVER (PARTITION BY season, team ORDER BY kickoff, match_id) AS i FROM t) SELECT season, max(kickoff) AS cut FROM x WHERE i = 10 GROUP BY season", sides=True)
def cut_common_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.cutoff(sides(matches(spark, sf_dir)), 10)


@query(" SELECT season, kickoff + INTERVAL 1 microsecond AS cut FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY kickoff, match_id) AS i FROM m) WHERE i = 200", corpus=True)
def cut_nth_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.nth_fixture_cut(matches(spark, sf_dir), 200)


@query(" SELECT season, min(kickoff) AS start, CAST(coalesce(sum(count(*)) OVER (ORDER BY min(kickoff) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train FROM m GROUP BY season", corpus=True)
def cut_expanding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.training_rows(matches(spark, sf_dir))


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' AND value > 20 ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_baseline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup' and value > 20")
    return e.select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1)


_SCORED = """s AS (SELECT event_id AS id, ts AS kickoff, user_id % 5 AS version, event_id % 3 AS outcome, 0.2 + (event_id % 40) / 100.0 AS p_home, 0.1 + (event_id % 17) / 100.0 AS p_draw,
  CASE WHEN event_id % 4 <> 0 THEN 0.3 + (event_id % 30) / 100.0 END AS m_home FROM events),
q AS (SELECT *, CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE 1 - p_home - p_draw END AS p FROM s)"""


@query(
    f"""WITH {_SCORED}
SELECT id, version, round(avg(-ln(greatest(CAST(p AS DOUBLE), 1e-9))) OVER w, 9) AS log_loss, round(avg(CAST(m_home AS DOUBLE)) OVER w, 9) AS market, count(m_home) OVER w AS market_rows FROM q
WINDOW w AS (PARTITION BY version ORDER BY kickoff, id ROWS UNBOUNDED PRECEDING)"""
)
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative means over a version's log; rows without odds do not advance the market's."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    home, draw = F.lit(0.2) + (i % 40) / 100, F.lit(0.1) + (i % 17) / 100
    p = F.when(i % 3 == 0, home).when(i % 3 == 1, draw).otherwise(1 - home - draw)
    rows = e.select(i.alias("id"), F.col("ts").alias("kickoff"), (F.col("user_id") % 5).alias("version"), p.alias("p"), F.when(i % 4 != 0, F.lit(0.3) + (i % 30) / 100).alias("m_home"))
    w = Window.partitionBy("version").orderBy("kickoff", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loss = F.avg(-F.log(F.greatest(F.col("p"), F.lit(1e-9)))).over(w)
    return rows.select("id", "version", F.round(loss, 9).alias("log_loss"), F.round(F.avg("m_home").over(w), 9).alias("market"), F.count("m_home").over(w).alias("market_rows"))
