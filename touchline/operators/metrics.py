"""Scores of three-way forecasts: rows of p_home, p_draw, p_away and an outcome of 0, 1 or 2.

Everything is one expression a row and one partial aggregate; ``by`` groups score side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = ("p_home", "p_draw", "p_away")


def checked(rows: DataFrame) -> DataFrame:
    """Rows whose probabilities are clipped at 0 and sum to 1; fails at run time on rows that cannot be."""
    clipped = [F.greatest(F.col(p), F.lit(0.0)) for p in P]
    total = clipped[0] + clipped[1] + clipped[2]
    bad = F.col(P[0]).isNull() | F.col(P[1]).isNull() | F.col(P[2]).isNull() | F.coalesce(total <= 0, F.lit(True)) | F.coalesce(~F.col("outcome").between(0, 2), F.lit(True))
    guard = F.when(bad, F.raise_error(F.lit("a forecast needs three probabilities and an outcome of 0, 1 or 2")).cast("double")).otherwise(total)
    return rows.withColumn("_total", guard).select(*[c for c in rows.columns if c not in P], *[(c / F.col("_total")).alias(p) for c, p in zip(clipped, P, strict=True)])


def picked(prefix: str = "p_") -> Column:
    """The probability that the forecast gave to what happened."""
    return F.when(F.col("outcome") == 0, F.col(f"{prefix}home")).when(F.col("outcome") == 1, F.col(f"{prefix}draw")).otherwise(F.col(f"{prefix}away"))


def log_loss(floor: float = 1e-15, prefix: str = "p_") -> Column:
    return -F.log(F.greatest(picked(prefix), F.lit(floor)))


def rps(prefix: str = "p_") -> Column:
    """Half the squared differences of both cumulative distributions, on the scale home, draw, away."""
    home, draw = F.col(f"{prefix}home"), F.col(f"{prefix}draw")
    one, two = (F.col("outcome") == 0).cast("double"), (F.col("outcome") <= 1).cast("double")
    return ((home - one) * (home - one) + (home + draw - two) * (home + draw - two)) / 2


def brier(prefix: str = "p_") -> Column:
    gaps = [F.col(f"{prefix}{c}") - (F.col("outcome") == i).cast("double") for i, c in enumerate(("home", "draw", "away"))]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def confidence() -> Column:
    return F.greatest(*P)


def pick() -> Column:
    """The likeliest outcome; of equal ones the first of home, draw, away."""
    h, d, a = (F.col(p) for p in P)
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def pick_for_display() -> Column:
    """As above, but of equal ones home, then away, then draw."""
    h, d, a = (F.col(p) for p in P)
    return F.when((h >= d) & (h >= a), 0).when((a >= d) & (a >= h), 2).otherwise(1)


def hit() -> Column:
    return (pick() == F.col("outcome")).cast("double")


def calibration_error(rows: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """ece: the mean gap of confidence and hits over equal bins of confidence, weighted by their rows."""
    place = F.least(F.floor(confidence() * bins), F.lit(bins - 1))
    each = rows.groupBy(*by, place.alias("_bin")).agg(F.count("*").alias("n"), F.abs(F.avg(hit()) - F.avg(confidence())).alias("gap"))
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def evaluate(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, log_loss, rps, brier, accuracy and ece of each group."""
    good = checked(rows)
    sums = good.groupBy(*by).agg(F.count("*").alias("n"), F.avg(log_loss()).alias("log_loss"), F.avg(rps()).alias("rps"), F.avg(brier()).alias("brier"), F.avg(hit()).alias("accuracy"))
    errors = calibration_error(good, by)
    return sums.join(errors, list(by)) if by else sums.crossJoin(errors)  # one row each


def pooled_and_by_season(rows: DataFrame) -> DataFrame:
    """Every model's metrics over all seasons (season null) and season by season, from one rollup."""
    good = checked(rows)
    sums = good.rollup("model", "season").agg(F.grouping("season").alias("pooled"), F.grouping("model").alias("all"), F.count("*").alias("n"), F.avg(log_loss()).alias("log_loss"), F.avg(rps()).alias("rps"), F.avg(hit()).alias("accuracy"))
    return sums.where("`all` = 0").select("model", F.when(F.col("pooled") == 0, F.col("season")).alias("season"), "n", "log_loss", "rps", "accuracy")


def reliability(rows: DataFrame, by: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """Right-closed bins of confidence: rows, mean confidence and share of hits."""
    place = F.greatest(F.ceil(confidence() * bins).cast("int"), F.lit(1))
    return rows.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence()).alias("predicted"), F.avg(hit()).alias("observed"))


def classwise_bins(rows: DataFrame, by: Sequence[str] = (), width: float = 0.2) -> DataFrame:
    """Left-closed bins over all three probabilities of each row: points, mean probability and share that happened, in per cent."""
    points = F.explode(F.array(*[F.struct(F.col(p).alias("p"), (F.col("outcome") == i).cast("double").alias("o")) for i, p in enumerate(P)])).alias("x")
    last = round(1 / width) - 1
    place = F.least(F.floor(F.col("x.p") / F.lit(width)), F.lit(last)).cast("int")
    return rows.select(*by, points).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), (F.avg("x.p") * 100).alias("predicted"), (F.avg("x.o") * 100).alias("observed"))


def classwise_error(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bins = classwise_bins(rows, by)
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n") / 100).alias("ece"))


def scored_log(rows: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Each logged forecast with its scores and the market's (null where odds are missing: m_home, m_draw, m_away)."""
    market = F.col("m_home").isNotNull() & F.col("m_draw").isNotNull() & F.col("m_away").isNotNull()
    return rows.where("outcome is not null").withColumns(
        {"pick": pick_for_display(), "correct": pick_for_display() == F.col("outcome"), "log_loss": log_loss(floor), "rps": rps(), "market_log_loss": F.when(market, log_loss(floor, "m_")), "market_rps": F.when(market, rps("m_"))}
    )


def against_market(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Model and market on the fixtures that have odds."""
    return scored.where("market_log_loss is not null").groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("log_loss", "market_log_loss", "rps", "market_rps")])


#: What a model has to reach.
MARKET_TOLERANCE, ELO_WINS, ACCURACY_BAND = 0.03, 4, (0.51, 0.55)


def acceptance(per_season: DataFrame, model: str) -> DataFrame:
    """One row: seasons scored, wins over both baselines, the worst gap to the market and whether each target is met.

    per_season: model, season, log_loss, accuracy, n.
    """
    wide = per_season.groupBy("season").pivot("model", [model, "base_rate", "elo", "market"]).agg(F.first("log_loss").alias("loss"), F.first("accuracy").alias("acc"))
    loss = lambda m: F.col(f"{m}_loss")
    own = wide.where(loss(model).isNotNull())
    seasons = F.count("*")
    pooled = per_season.where(F.col("model") == model).agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"))
    found = own.agg(
        seasons.alias("seasons"), F.count_if(loss(model) < loss("base_rate")).alias("base_wins"), F.count_if(loss(model) < loss("elo")).alias("elo_wins"), F.max(loss(model) - loss("market")).alias("worst_gap"), F.max_by("season", loss(model) - loss("market")).alias("worst_season")
    ).crossJoin(pooled)  # one row each
    return found.select(
        "*",
        (F.col("base_wins") == F.col("seasons")).alias("beats_base_rate"),
        (F.col("elo_wins") >= F.least(F.lit(ELO_WINS), F.col("seasons"))).alias("beats_elo"),
        F.coalesce(F.col("worst_gap") <= MARKET_TOLERANCE, F.lit(False)).alias("near_market"),
        F.coalesce(F.col("accuracy").between(*ACCURACY_BAND), F.lit(False)).alias("in_band"),
    )


def best_setting(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The setting of the least mean loss over folds; scores: setting, fold, log_loss."""
    mean = scores.groupBy(*by, "setting").agg(F.avg("log_loss").alias("log_loss"))
    return mean.groupBy(*by).agg(F.min_by("setting", F.struct("log_loss", "setting")).alias("setting"), F.min("log_loss").alias("log_loss"))


def stored_scoreboard(versions: DataFrame) -> DataFrame:
    """Metrics that are stored as JSON text (name, version, metrics), one row each."""
    return versions.select("name", "version", F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"))
