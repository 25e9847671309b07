"""Point-in-time features from window frames over each team's past.

Kick-offs are unique within a team, so a frame that ends at the row before is the
same as "strictly earlier".  Every frame is bounded or a running aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a team without any past is given.
PRIORS = {"ppg": 1.35, "gf": 1.35, "ga": 1.35, "sot_share": 0.5, "win_rate": 0.35, "rest": 7.0, "n": 0.0}
REST_CAP = 14.0
VENUE_PRIORS = {"H": {"ppg": 1.35, "gf": 1.50, "ga": 1.14, "sot": 4.65, "sot_against": 3.63}, "A": {"ppg": 1.35, "gf": 1.14, "ga": 1.50, "sot": 3.63, "sot_against": 4.65}}
VENUE_REST_CAP = 30.0


def pts(gf: Column = None, ga: Column = None) -> Column:
    gf, ga = F.col("gf") if gf is None else gf, F.col("ga") if ga is None else ga
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(8.64e10)


def clamped(gap: Column, cap: float, prior: float) -> Column:
    """A gap between 0 and ``cap``; the prior without one (greatest and least pass over nulls)."""
    return F.when(gap.isNull(), prior).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(cap)))


def past(last: int, *partition: str):
    return Window.partitionBy(*partition).orderBy("kickoff", "match_id").rowsBetween(-last, -1)


def team_form(team_games: DataFrame, last: int = 6) -> DataFrame:
    """Each team's form over its last games at either venue, before each of its games."""
    w = past(last, "team")
    order = Window.partitionBy("team").orderBy("kickoff", "match_id")
    n = F.count("*").over(w)
    shots, against = F.coalesce(F.sum("sot").over(w), F.lit(0)), F.coalesce(F.sum("sot_against").over(w), F.lit(0))
    share = F.when(shots + against > 0, shots / (shots + against)).otherwise(PRIORS["sot_share"])
    rest = clamped(days(F.col("kickoff"), F.lag("kickoff").over(order)), REST_CAP, PRIORS["rest"])
    mean = lambda c, prior: F.coalesce(F.avg(c).over(w), F.lit(prior))
    return team_games.select(
        "*",
        mean(pts(), PRIORS["ppg"]).alias("ppg"),
        mean(F.col("gf"), PRIORS["gf"]).alias("goals_for"),
        mean(F.col("ga"), PRIORS["ga"]).alias("goals_against"),
        share.alias("sot_share"),
        mean((pts() == 3).cast("double"), PRIORS["win_rate"]).alias("win_rate"),
        rest.alias("rest_days"),
        n.cast("double").alias("matches_played"),
    )


FORM = ["ppg", "goals_for", "goals_against", "sot_share", "win_rate", "rest_days", "matches_played"]


def of_side(venue: str, *columns: str) -> Column:
    """An aggregate of a match's two rows: these columns of one side, as a struct."""
    return F.first(F.when(F.col("venue") == venue, F.struct(*columns)), ignorenulls=True)


def form_dataset(team_games: DataFrame, last: int = 6) -> DataFrame:
    """The 14-number row of each match: both teams' form side by side, and the outcome."""
    outcome = F.when(F.col("gf") > F.col("ga"), 0).when(F.col("gf") == F.col("ga"), 1).otherwise(2)
    form = team_form(team_games, last).withColumn("outcome", outcome)
    both = form.groupBy("match_id").agg(of_side("H", "season", "kickoff", "outcome", *FORM).alias("h"), of_side("A", *FORM).alias("a")).where("h is not null and a is not null")
    return both.select("match_id", "h.season", "h.kickoff", "h.outcome", *[F.col(f"{v}.{c}").alias(f"{p}_{c}") for v, p in (("h", "home"), ("a", "away")) for c in FORM])


def venue_form(team_games: DataFrame, last: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """Form of each team at one venue over its last games there; games without shots keep their slot."""
    w = past(last, "team", "venue")

    def mean(c: Column, name: str) -> Column:
        prior = F.when(F.col("venue") == "H", VENUE_PRIORS["H"][name]).otherwise(VENUE_PRIORS["A"][name])
        return F.coalesce(F.avg(c).over(w), prior)

    return team_games.select(
        "match_id", "team", "venue", *keep, mean(pts(), "ppg").alias("ppg_l10"), mean(F.col("gf"), "gf").alias("goals_for_l10"), mean(F.col("ga"), "ga").alias("goals_against_l10"), mean(F.col("sot"), "sot").alias("sot_for_l10"), mean(F.col("sot_against"), "sot_against").alias("sot_against_l10")
    )


def rest_difference(team_games: DataFrame) -> DataFrame:
    """Home rest minus away rest before each match, each capped; no past counts as the cap."""
    before = F.lag("kickoff").over(Window.partitionBy("team").orderBy("kickoff", "match_id"))
    rest = clamped(days(F.col("kickoff"), before), VENUE_REST_CAP, VENUE_REST_CAP)
    return team_games.select("match_id", "venue", rest.alias("rest")).groupBy("match_id").agg((F.max(F.when(F.col("venue") == "H", F.col("rest"))) - F.max(F.when(F.col("venue") == "A", F.col("rest")))).alias("rest_days_diff"))


def derived_matchday(team_games: DataFrame) -> DataFrame:
    """Rounds by count: the home side's earlier games of the season, plus one."""
    w = Window.partitionBy("team", "season").orderBy("kickoff", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    return team_games.select("match_id", "venue", (F.count("*").over(w) + 1).alias("matchday")).where("venue = 'H'").select("match_id", "matchday")


def rolling_state(team_games: DataFrame, last: int = 6) -> DataFrame:
    """Each team's window as it stands after its last game: what a later run starts from."""
    age = F.row_number().over(Window.partitionBy("team").orderBy(F.col("kickoff").desc(), F.col("match_id").desc()))
    kept = team_games.withColumn("age", age).where(F.col("age") <= last)
    return kept.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("kickoff", pts().alias("points"), "gf", "ga", "sot", "sot_against"))).alias("window"))


def continued_form(state: DataFrame, team_games: DataFrame, last: int = 6) -> DataFrame:
    """``team_form`` of new games whose past is an exported state of at least ``last`` games a team; games must be later than it."""
    held = state.select("team", F.explode("window").alias("w")).select("team", *[F.col(f"w.{c}").alias(c) for c in ("kickoff", "gf", "ga", "sot", "sot_against")])
    every = team_games.withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return team_form(every, last).where("_new").drop("_new")


def promotion_flag(fixtures: DataFrame, past_games: DataFrame) -> DataFrame:
    """1 if a side of a fixture was in a lower tier, and not in this competition, a season before.

    fixtures: match_id, season, competition, tier, home_team, away_team; past_games: season,
    competition, tier, home_team, away_team.  0 if that season is not on record.
    """
    sides = past_games.select((F.col("season") + 1).alias("season"), F.col("competition").alias("c"), F.col("tier").alias("t"), F.explode(F.array("home_team", "away_team")).alias("team"))
    been = sides.groupBy("season", "team").agg(F.collect_set("c").alias("competitions"), F.max("t").alias("lowest"))
    own = fixtures.select("match_id", "season", "competition", "tier", F.explode(F.array("home_team", "away_team")).alias("team"))
    up = ~F.array_contains("competitions", F.col("competition")) & (F.col("lowest") > F.col("tier"))
    return own.join(been, ["season", "team"], "left").groupBy("match_id").agg(F.max(F.coalesce(up, F.lit(False)).cast("int")).alias("promotion_flag"))


def feature_vector(team_games: DataFrame, ratings: DataFrame, promotions: DataFrame) -> DataFrame:
    """The 15-number point-in-time vector of each match.

    ratings: match_id, elo_diff; promotions: match_id, promotion_flag, division_tier.
    """
    stats = ["ppg_l10", "goals_for_l10", "goals_against_l10", "sot_for_l10", "sot_against_l10"]
    dealt = team_games.repartition("team")  # one exchange for all windows, which are of teams and parts of their games
    before = F.lag("kickoff").over(Window.partitionBy("team").orderBy("kickoff", "match_id"))
    so_far = F.count("*").over(Window.partitionBy("team", "season").orderBy("kickoff", "match_id").rowsBetween(Window.unboundedPreceding, -1))
    rest = clamped(days(F.col("kickoff"), before), VENUE_REST_CAP, VENUE_REST_CAP)
    form = venue_form(dealt.withColumns({"_rest": rest, "_matchday": so_far + 1}), keep=("_rest", "_matchday"))
    both = form.groupBy("match_id").agg(of_side("H", "_rest", "_matchday", *stats).alias("h"), of_side("A", "_rest", *stats).alias("a")).where("h is not null and a is not null")
    out = both.select("match_id", *[F.col(f"{v}.{c}").alias(f"{p}_{c}") for v, p in (("h", "home"), ("a", "away")) for c in stats], (F.col("h._rest") - F.col("a._rest")).alias("rest_days_diff"), F.col("h._matchday").alias("matchday"))
    return out.join(ratings, "match_id").join(promotions, "match_id")


def cutoff(team_games: DataFrame, n: int) -> DataFrame:
    """Each season's latest n-th game of any team: the moment all teams have played n."""
    i = F.row_number().over(Window.partitionBy("season", "team").orderBy("kickoff", "match_id"))
    return team_games.withColumn("i", i).where(F.col("i") == n).groupBy("season").agg(F.max("kickoff").alias("cut"))


def nth_fixture_cut(matches: DataFrame, n: int) -> DataFrame:
    """A microsecond after each season's n-th match in order: everything up to it is strictly earlier."""
    i = F.row_number().over(Window.partitionBy("season").orderBy("kickoff", "match_id"))
    return matches.withColumn("i", i).where(F.col("i") == n).select("season", (F.col("kickoff") + F.expr("interval 1 microsecond")).alias("cut"))


def training_rows(matches: DataFrame) -> DataFrame:
    """Of each season: how many matches precede its first, which is what may be trained on."""
    starts = matches.groupBy("season").agg(F.min("kickoff").alias("start"))
    per = matches.groupBy("season").agg(F.count("*").alias("n"), F.min("kickoff").alias("first"))
    w = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a season
    return starts.join(per, "season").select("season", "start", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_train"))
