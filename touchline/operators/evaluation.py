"""Walk-forward evaluation: every season is forecast from what came strictly before it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from . import goals_model as gm
from . import metrics as me
from . import ratings as rt

KEEP = ["model", "match_id", "season", "kickoff", "outcome", "p_home", "p_draw", "p_away"]


def season_folds(matches: DataFrame, first: int) -> DataFrame:
    """fold (a season) and its first kick-off, from season ``first`` on."""
    return matches.where(F.col("season") >= first).groupBy(F.col("season").alias("fold")).agg(F.min("kickoff").alias("start"))


def walk_forward(matches: DataFrame, first: int, half_life_days: float = gm.HALF_LIFE_DAYS) -> DataFrame:
    """Forecasts of the goals model, ratings, base rate, equal thirds and market for all test seasons.

    matches: match_id, season, kickoff, teams, goals, odds.  All folds are fitted side by
    side; a match is a training row of each later fold, and the aggregation to pairs of
    clubs happens before anything is shuffled.
    """
    played = matches.where("home_goals is not null").withColumn("outcome", numbers.outcome(F.col("home_goals"), F.col("away_goals")))
    folds = season_folds(matches, first)
    training = rt.expanding(played, folds)
    test = played.where(F.col("season") >= first).withColumn("fold", F.col("season"))

    rate = F.lit(numbers.half_life_to_rate(half_life_days))
    goals = gm.forecasts(test, gm.fit(training, ["fold"], rate), ["fold"]).withColumn("model", F.lit("goals"))
    rates = rt.base_rates(training, ["fold"])
    base = test.join(rates, "fold").withColumn("model", F.lit("base_rate"))
    uniform = test.withColumns({"model": F.lit("uniform"), **{f"p_{c}": F.lit(1 / 3) for c in ("home", "draw", "away")}})
    # ratings run on through the test seasons; the draw rate is that of the first training window
    start = folds.agg(F.min("start").alias("_s"))
    draws = played.crossJoin(start).where("kickoff < _s").agg(F.coalesce(F.avg((F.col("outcome") == 1).cast("double")), F.lit(rt.DRAW_FALLBACK)).alias("_draws"))  # one row each
    rated = rt.rate(played).where(F.col("season") >= first).crossJoin(draws)
    elo = rt.forecasts(rated, F.col("_draws")).withColumn("model", F.lit("elo"))
    book = numbers.market_first([(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))])
    market = test.withColumn("_m", book).where("_m is not null").withColumns({"model": F.lit("market"), **{f"p_{c}": F.col(f"_m.{c}") for c in ("home", "draw", "away")}})
    out = None
    for part in (goals, base, uniform, elo, market):
        part = part.select(*KEEP)
        out = part if out is None else out.unionByName(part)
    return out


def sweep(matches: DataFrame, first: int, half_lives: list[float]) -> DataFrame:
    """Goals-model forecasts under several half-lives: setting, fold and the forecast columns; one wider fit."""
    played = matches.where("home_goals is not null").withColumn("outcome", numbers.outcome(F.col("home_goals"), F.col("away_goals")))
    grid = F.explode(F.array(*[F.lit(float(h)) for h in half_lives]))
    training = rt.expanding(played, season_folds(matches, first)).withColumn("setting", grid)
    test = played.where(F.col("season") >= first).withColumn("fold", F.col("season")).withColumn("setting", grid)
    params = gm.fit(training, ["setting", "fold"], F.log(F.lit(2.0)) / F.col("setting"))
    return gm.forecasts(test, params, ["setting", "fold"])


# -------------------------------------------------- walk-forward calibration
def pooled_violators(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the steps of the increasing curve nearest to means ``total / n`` at ascending ``x``, and their values."""
    low, high, sums, counts = [], [], [], []
    for at, t, k in zip(x.tolist(), total.tolist(), n.tolist(), strict=True):
        low.append(at)
        high.append(at)
        sums.append(t)
        counts.append(k)
        while len(sums) > 1 and sums[-2] * counts[-1] >= sums[-1] * counts[-2]:
            low.pop()
            for held, merge in ((high, max), (sums, float.__add__), (counts, int.__add__)):
                top = held.pop()
                held[-1] = merge(held[-1], top)
    value = np.array(sums) / np.array(counts)
    ends = np.stack([low, high], 1).ravel()
    keep = np.append(True, np.diff(ends) > 0)
    return ends[keep], np.repeat(value, 2)[keep]


def earlier_curves(forecasts: DataFrame) -> DataFrame:
    """model, season, outcome (0, 1, 2), n_train, xs and ys: an isotonic curve for each season from all earlier ones.

    Equal probabilities of a season are summed before they are gathered, and a curve is fitted in one task.
    """
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(p).alias("x"), (F.col("outcome") == k).cast("double").alias("y")) for k, p in enumerate(me.P)])).alias("p")
    sums = forecasts.select("model", "season", points).groupBy("model", "season", "p.outcome", "p.x").agg(F.sum("p.y").alias("total"), F.count("*").alias("n"))
    later = forecasts.select("model", F.col("season").alias("later")).distinct()
    history = sums.join(later, "model").where("season < later")

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = group.groupby("x", sort=True)[["total", "n"]].sum()
        xs, ys = pooled_violators(whole.index.to_numpy(), whole.total.to_numpy(), whole.n.to_numpy())
        return pd.DataFrame({"model": [key[0]], "season": [key[1]], "outcome": [key[2]], "n_train": [int(whole.n.sum())], "xs": [xs], "ys": [ys]})

    return history.groupBy("model", "later", "outcome").applyInPandas(fit, "model string, season int, outcome int, n_train long, xs array<double>, ys array<double>")


def _on_curve(xs: Column, ys: Column, x: Column) -> Column:
    """The line through a curve's points at ``x``, flat outside them."""
    last = F.size(xs)
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(xs, lambda a: a <= x)), last - 1))
    at = lambda v, j: F.element_at(v, j)
    line = at(ys, i) + (at(ys, i + 1) - at(ys, i)) / (at(xs, i + 1) - at(xs, i)) * (x - at(xs, i))
    return F.when((x <= at(xs, F.lit(1))) | (last == 1), at(ys, F.lit(1))).when(x >= at(xs, last), at(ys, last)).otherwise(line)


def walk_forward_calibrated(forecasts: DataFrame, shrinks: Sequence[float]) -> DataFrame:
    """Forecasts of every season that has an earlier one, under each ``shrink`` (0: as they were), with n_train.

    forecasts: model, match_id, season, outcome and the probabilities.  A probability becomes a mixture of
    itself and its curve, ``shrink`` of the latter, and the three are made to sum to one again.
    """
    if not all(0.0 <= s <= 1.0 for s in shrinks):
        raise ValueError("shrink is a share")
    curves = earlier_curves(forecasts).groupBy("model", "season").agg(F.first("n_train").alias("n_train"), *[F.max(F.when(F.col("outcome") == k, F.struct("xs", "ys"))).alias(f"c{k}") for k in range(3)])
    rows = forecasts.join(curves, ["model", "season"]).withColumn("shrink", F.explode(F.array(*[F.lit(float(s)) for s in shrinks])))
    s = F.col("shrink")
    mixed = {f"_{p}": F.when(s == 0, F.col(p)).otherwise(F.greatest((1 - s) * F.col(p) + s * _on_curve(F.col(f"c{k}.xs"), F.col(f"c{k}.ys"), F.col(p)), F.lit(1e-9))) for k, p in enumerate(me.P)}
    out = rows.withColumns(mixed)
    total = F.col("_p_home") + F.col("_p_draw") + F.col("_p_away")
    return out.withColumns({p: F.col(f"_{p}") / total for p in me.P}).drop(*mixed, "c0", "c1", "c2")


def calibration_report(forecasts: DataFrame, shrinks: Sequence[float] = (0.0, 0.1, 0.3, 0.5, 1.0)) -> DataFrame:
    """model, season (null: pooled), shrink, n, log_loss, ece, their changes from shrink 0, and whether both got no worse."""
    rows = walk_forward_calibrated(forecasts, sorted({0.0, *shrinks}))
    by_season = me.evaluate(rows, ["model", "season", "shrink"])
    pooled = me.evaluate(rows.withColumn("season", F.lit(None).cast("int")), ["model", "shrink"]).withColumn("season", F.lit(None).cast("int"))
    every = by_season.unionByName(pooled).select("model", "season", "shrink", "n", "log_loss", "ece")
    plain = every.where("shrink = 0").select("model", "season", F.col("log_loss").alias("_loss"), F.col("ece").alias("_ece"))
    same = (F.col("e.model") == F.col("b.model")) & F.col("e.season").eqNullSafe(F.col("b.season"))
    both = every.alias("e").join(plain.alias("b"), same).select("e.*", (F.col("log_loss") - F.col("_loss")).alias("log_loss_change"), (F.col("ece") - F.col("_ece")).alias("ece_change"))
    return both.withColumn("helps", (F.col("log_loss_change") <= 0) & (F.col("ece_change") <= 0))
