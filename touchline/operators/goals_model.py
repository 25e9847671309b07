"""A bivariate goals model with time decay and a low-score correction.

The home side scores Poisson(exp(attack_h - defence_a + home_adv)) goals, the away side
Poisson(exp(attack_a - defence_h)), tied together in the four smallest scores by rho.  The
weighted likelihood depends on the matches only through seven sums for each ordered pair of
clubs, so Spark reduces any number of matches to at most n(n-1) rows in one aggregation, and
the optimiser never sees a match again.  Fits of many groups (folds, settings, bootstrap
replicates) are one aggregation with a wider key and run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from .resample import resampled, with_attempts

#: Where the correction is cut off, its bound, the ridge, the largest goal count of a grid.
TAU_FLOOR, RHO_BOUND, RIDGE, MAX_GOALS = 1e-10, 0.10, 1e-6, 10
HALF_LIFE_DAYS = 540.0

STATS = ["w", "wx", "wy", "w00", "w01", "w10", "w11"]


def pair_sums(matches: DataFrame, by: Sequence[str] = (), rate: Column | None = None, copies: Column | None = None) -> DataFrame:
    """The seven sums of each (by..., home_team, away_team).

    ``rate`` is the decay per day before the group's latest match (default: that of a
    half-life of 540 days); ``copies`` counts a match several times.
    """
    played = matches.where("home_goals is not null and away_goals is not null")
    if copies is not None:
        played = played.withColumn("_n", copies).where("_n > 0")
    else:
        played = played.withColumn("_n", F.lit(1))
    if by:
        last = played.groupBy(*by).agg(F.max("kickoff").alias("_last"))
        played = played.join(last, list(by))
    else:
        played = played.crossJoin(played.agg(F.max("kickoff").alias("_last")))  # one row
    rate = F.lit(numbers.half_life_to_rate(HALF_LIFE_DAYS)) if rate is None else rate
    w = F.col("_n") * F.exp(-rate * dates.age_days(F.col("_last"), F.col("kickoff")))
    x, y = F.col("home_goals"), F.col("away_goals")
    cell = lambda i, j: F.sum(F.when((x == i) & (y == j), F.col("_w")).otherwise(0.0))
    sums = [F.sum("_w").alias("w"), F.sum(F.col("_w") * x).alias("wx"), F.sum(F.col("_w") * y).alias("wy"), cell(0, 0).alias("w00"), cell(0, 1).alias("w01"), cell(1, 0).alias("w10"), cell(1, 1).alias("w11")]
    return played.withColumn("_w", w).groupBy(*by, "home_team", "away_team").agg(*sums)


class Likelihood:
    """Negative penalised log-likelihood of pair sums, and its gradient.

    Parameters: attack of each club, defence of each club, home advantage, z with rho = bound * tanh(z).
    """

    def __init__(self, home: np.ndarray, away: np.ndarray, sums: dict[str, np.ndarray], n: int, bound: float = RHO_BOUND, ridge: float = RIDGE):
        self.home, self.away, self.sums, self.n, self.bound, self.ridge = home, away, sums, n, bound, ridge

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        n, h, a, s = self.n, self.home, self.away, self.sums
        attack, defence, advantage, rho = p[:n], p[n : 2 * n], p[2 * n], self.bound * np.tanh(p[2 * n + 1])
        log_lam, log_mu = attack[h] - defence[a] + advantage, attack[a] - defence[h]
        lam, mu = np.exp(log_lam), np.exp(log_mu)
        value = (s["wx"] * log_lam - s["w"] * lam + s["wy"] * log_mu - s["w"] * mu).sum()
        d_lam, d_mu, d_rho = s["wx"] - s["w"] * lam, s["wy"] - s["w"] * mu, 0.0  # by the logarithms of lam and mu
        one = np.ones_like(lam)
        # factor of each corrected cell, then its derivatives by log lam, log mu and rho
        for w, t, by_lam, by_mu, by_rho in (
            (s["w00"], 1 - lam * mu * rho, -lam * mu * rho, -lam * mu * rho, -lam * mu),
            (s["w01"], 1 + lam * rho, lam * rho, 0 * lam, lam),
            (s["w10"], 1 + mu * rho, 0 * mu, mu * rho, mu),
            (s["w11"], (1 - rho) * one, 0 * lam, 0 * lam, -one),
        ):
            free = t > TAU_FLOOR
            t = np.maximum(t, TAU_FLOOR)
            value += (w * np.log(t)).sum()
            share = np.where(free, w / t, 0.0)
            d_lam, d_mu, d_rho = d_lam + share * by_lam, d_mu + share * by_mu, d_rho + (share * by_rho).sum()
        value -= self.ridge * (attack @ attack + defence @ defence)
        count = lambda i, x: np.bincount(i, weights=x, minlength=n)
        grad = np.concatenate(
            [
                count(h, d_lam) + count(a, d_mu) - 2 * self.ridge * attack,
                -count(a, d_lam) - count(h, d_mu) - 2 * self.ridge * defence,
                [d_lam.sum(), d_rho * self.bound * (1 - np.tanh(p[2 * n + 1]) ** 2)],
            ]
        )
        return -value, -grad


def minimise(f, start: np.ndarray, rounds: int = 500, tolerance: float = 1e-7) -> tuple[np.ndarray, float, int, float]:
    """BFGS with backtracking; parameters, value, rounds and the largest gradient entry."""
    x, (value, grad) = start.copy(), f(start)
    inverse, scale = np.eye(len(x)), max(1.0, np.abs(grad).max())
    inverse /= scale
    for i in range(rounds):
        if np.abs(grad).max() <= tolerance * max(1.0, abs(value)):
            return x, value, i, float(np.abs(grad).max())
        step = -inverse @ grad
        slope = grad @ step
        if slope >= 0:
            inverse = np.eye(len(x)) / scale
            step, slope = -inverse @ grad, -(grad @ inverse @ grad)
        size = 1.0
        while size > 1e-12:
            new = x + size * step
            new_value, new_grad = f(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x, value, i, float(np.abs(grad).max())
        moved, turned = new - x, new_grad - grad
        x, value, grad = new, new_value, new_grad
        curve = moved @ turned
        if curve > 1e-12 * np.sqrt((moved @ moved) * (turned @ turned)):
            if i == 0:
                inverse = np.eye(len(x)) * (curve / (turned @ turned))
            along = inverse @ turned
            inverse += np.outer(moved, moved) * ((curve + turned @ along) / curve**2) - (np.outer(along, moved) + np.outer(moved, along)) / curve
    return x, value, rounds, float(np.abs(grad).max())


def fit_pairs(home: np.ndarray, away: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray, pd.DataFrame, dict]:
    teams, index = np.unique(np.concatenate([home, away]), return_inverse=True)
    n = len(teams)
    f = Likelihood(index[: len(home)], index[len(home) :], sums, n)
    p, value, rounds, gradient = minimise(f, np.zeros(2 * n + 2))
    if not np.isfinite(p).all() or gradient > 1e-3 * max(1.0, abs(value)):
        raise RuntimeError(f"the fit did not converge: {rounds} rounds, gradient {gradient:.3g}")
    centre = p[:n].mean()  # attack and defence may move together without any change of goals
    return teams, pd.DataFrame({"attack": p[:n] - centre, "defence": p[n : 2 * n] - centre}), {"home_adv": p[2 * n], "rho": RHO_BOUND * np.tanh(p[2 * n + 1]), "objective": value, "rounds": rounds, "gradient": gradient}


def fit(matches: DataFrame, by: Sequence[str] = (), rate: Column | None = None, copies: Column | None = None, strict: bool = True) -> DataFrame:
    """by..., team, attack, defence, home_adv, rho, objective, rounds, gradient of each group of matches.

    A group without a fit is an error, or, unless ``strict``, one row without values.
    """
    keys = list(by)
    sums = pair_sums(matches, keys, rate, copies)
    if not keys:
        sums, keys = sums.withColumn("_all", F.lit(0)), ["_all"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["home_team", "away_team"])
        try:
            teams, out, rest = fit_pairs(group.home_team.to_numpy(), group.away_team.to_numpy(), {c: group[c].to_numpy(dtype=float) for c in STATS})
        except RuntimeError:
            if strict:
                raise
            teams, out, rest = group.home_team.to_numpy()[:1], pd.DataFrame({"attack": [None], "defence": [None]}), dict.fromkeys(("home_adv", "rho", "objective", "gradient")) | {"rounds": 0}
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        out.insert(len(keys), "team", teams)
        return out.assign(**rest)

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"team {kinds['home_team']}", "attack double, defence double, home_adv double, rho double, objective double, rounds long, gradient double"])
    return sums.groupBy(*keys).applyInPandas(one, schema).select(*by, "team", "attack", "defence", "home_adv", "rho", "objective", "rounds", "gradient")


def bootstrap(matches: DataFrame, replicates: int, seed: int = 42, rate: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Fits, of each group of matches, of ``replicates`` resamples and, as replicate 0, of the matches themselves.

    A resample draws as many played matches as there are, with replacement.  One whose fit does not converge
    is drawn anew, twice at most.
    """
    keys, played = [*by, "replicate"], matches.where("home_goals is not null")

    def run(attempt: int, only: DataFrame | None) -> DataFrame:
        copies = resampled(played, "match_id", replicates, seed, by, attempt).select(*by, "match_id", F.posexplode("copies").alias("replicate", "copies")).where("copies > 0")
        copies = copies.withColumn("replicate", F.col("replicate") + 1)
        if attempt == 0:
            copies = copies.unionByName(played.select(*by, "match_id", F.lit(0).alias("replicate"), F.lit(1).alias("copies")))
        if only is not None:
            copies = copies.join(only, keys, "left_semi")
        return fit(played.join(copies, [*by, "match_id"]), keys, rate, F.col("copies"), strict=False)

    return with_attempts(run, F.col("attack").isNull(), keys)


# ----------------------------------------------------------------- forecasts
def expected_goals(fixtures: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``fixtures`` with lam, mu and rho; clubs that a fit has not seen count as average."""
    side = lambda s: params.select(*by, F.col("team").alias(f"{s}_team"), F.col("attack").alias(f"_{s}_attack"), F.col("defence").alias(f"_{s}_defence"))
    shared = params.groupBy(*by).agg(F.first("home_adv").alias("home_adv"), F.first("rho").alias("rho"))
    out = fixtures.join(side("home"), [*by, "home_team"], "left").join(side("away"), [*by, "away_team"], "left")
    out = out.join(shared, list(by)) if by else out.crossJoin(shared)  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lam = F.exp(zero("_home_attack") - zero("_away_defence") + F.col("home_adv"))
    mu = F.exp(zero("_away_attack") - zero("_home_defence"))
    return out.withColumns({"lam": lam, "mu": mu}).drop("_home_attack", "_home_defence", "_away_attack", "_away_defence", "home_adv")


def _poisson(mean: Column) -> Column:
    logs = F.array(*[F.lit(float(np.sum(np.log(np.arange(1, g + 1))))) for g in range(MAX_GOALS + 1)])
    return F.transform(logs, lambda lf, g: F.exp(g * F.log(mean) - mean - lf))


def score_grid(lam: Column, mu: Column, rho: Column) -> Column:
    """array<array<double>>: the chance of each score up to 10 goals a side; sums to one."""
    home, away, zero = _poisson(lam), _poisson(mu), F.lit(0.0)
    cells = F.transform(home, lambda p, x: F.transform(away, lambda q, y: p * q * F.greatest(numbers.low_score_factor(x, y, lam, mu, rho), zero)))
    total = F.aggregate(cells, F.lit(0.0), lambda s, r: s + F.aggregate(r, F.lit(0.0), lambda t, p: t + p))
    return F.transform(cells, lambda r: F.transform(r, lambda p: p / total))


def forecasts(fixtures: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fixtures with p_home, p_draw, p_away, expected goals of both sides and the score grid (6 digits).

    But for the four corrected scores both sides' goals are independent, so chances and expectations come from
    sums over each side's goals alone, in generated code; the grid's cells are made only where it is asked for.
    """
    rated = expected_goals(fixtures, params, by).withColumns({"_h": _poisson(F.col("lam")), "_a": _poisson(F.col("mu"))})
    goals = range(MAX_GOALS + 1)
    h, a = ([F.col(c)[g] for g in goals] for c in ("_h", "_a"))
    corner = {(x, y): h[x] * a[y] * (F.greatest(numbers.low_score_factor(F.lit(x), F.lit(y), F.col("lam"), F.col("mu"), F.col("rho")), F.lit(0.0)) - 1) for x in (0, 1) for y in (0, 1)}
    plus = lambda terms: reduce(lambda s, t: s + t, terms)
    sums = {"_hs": plus(h), "_as": plus(a), "_hg": plus(h[g] * g for g in goals), "_ag": plus(a[g] * g for g in goals), **{f"_c{x}{y}": c for (x, y), c in corner.items()}}
    rated = rated.withColumns(sums)
    c = {k: F.col(f"_c{k[0]}{k[1]}") for k in corner}
    total = F.col("_hs") * F.col("_as") + plus(c.values())
    ahead = lambda own, other: plus(own[g] * plus(other[k] for k in range(g)) for g in goals if g)
    out = rated.withColumns(
        {
            "p_home": (ahead(h, a) + c[1, 0]) / total,
            "p_draw": (plus(h[g] * a[g] for g in goals) + c[0, 0] + c[1, 1]) / total,
            "p_away": (ahead(a, h) + c[0, 1]) / total,
            "goals_home": (F.col("_hg") * F.col("_as") + c[1, 0] + c[1, 1]) / total,
            "goals_away": (F.col("_ag") * F.col("_hs") + c[0, 1] + c[1, 1]) / total,
            "grid": F.transform(score_grid(F.col("lam"), F.col("mu"), F.col("rho")), lambda r: F.transform(r, lambda p: F.bround(p, 6))),
        }
    )
    return out.drop("_h", "_a", *sums)


def log_likelihood(matches: DataFrame, params: DataFrame, rate: float) -> DataFrame:
    """The decayed log-likelihood of played matches under a fit, constants included."""
    played = matches.where("home_goals is not null")
    rated = expected_goals(played, params).crossJoin(played.agg(F.max("kickoff").alias("_last")))  # one row
    x, y, lam, mu = F.col("home_goals"), F.col("away_goals"), F.col("lam"), F.col("mu")
    factor = F.greatest(numbers.low_score_factor(x, y, lam, mu, F.col("rho")), F.lit(TAU_FLOOR))
    each = F.log(factor) + x * F.log(lam) - lam - numbers.log_factorial(x) + y * F.log(mu) - mu - numbers.log_factorial(y)
    return rated.agg(F.sum(dates.decay(rate, dates.age_days(F.col("_last"), F.col("kickoff"))) * each).alias("log_likelihood"))


# ----------------------------------------------------------------- artifacts
CONVENTION = "defence is strength: a higher one lowers the other side's goals"


def to_artifact(params: DataFrame, **about: object) -> dict:
    """A fit as plain values: one row a club is collected, no matches."""
    rows = params.orderBy("team").collect()
    return {"convention": CONVENTION, "attack": {str(r.team): r.attack for r in rows}, "defence": {str(r.team): r.defence for r in rows}, "home_adv": rows[0].home_adv, "rho": rows[0].rho, **about}


def from_artifact(spark, artifact: dict) -> DataFrame:
    """The parameters of an artifact; refuses one of another sign convention."""
    if artifact.get("convention") != CONVENTION:
        raise ValueError("the artifact's sign convention is not this model's")
    rows = [(int(t), float(a), float(artifact["defence"][t]), float(artifact["home_adv"]), float(artifact["rho"])) for t, a in artifact["attack"].items()]
    return spark.createDataFrame(rows, "team int, attack double, defence double, home_adv double, rho double")
