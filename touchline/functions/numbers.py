"""Lenient and strict numbers, odds and probabilities as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_int(x: Column) -> Column:
    """``3``, ``3.0`` and `` 3.9 `` give 3; anything else null."""
    return F.trim(x).try_cast("double").try_cast("int")


def strict_int(x: Column) -> Column:
    """Empty gives null; text that is no whole number fails at run time."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a whole number: "), t)).cast("int"))


def lenient_float(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit("")).try_cast("double")


def positive_decimal(x: Column) -> Column:
    d = F.nullif(F.trim(x), F.lit("")).try_cast("decimal(18,6)")
    return F.when(d > 0, d)


# ---------------------------------------------------------------------- odds
Trio = tuple[Column, Column, Column]


def implied(trio: Trio, digits: int) -> Column:
    """struct(home, draw, away): shares of the inverse odds, rounded half to even."""
    inverse = [F.lit(1.0) / o for o in trio]
    total = inverse[0] + inverse[1] + inverse[2]
    return F.struct(*[F.bround(i / total, digits).alias(n) for i, n in zip(inverse, ("home", "draw", "away"), strict=True)])


def _usable(trio: Trio, above: float) -> Column:
    return F.coalesce((trio[0] > above) & (trio[1] > above) & (trio[2] > above), F.lit(False))


def market_longest(books: Sequence[Trio]) -> Column:
    """Of all complete books the one with the largest sum of odds, the first of equal ones; 5 digits."""
    best = F.array_max(F.array(*[F.when(_usable(b, 0), F.struct((b[0] + b[1] + b[2]).alias("total"), F.lit(-i).alias("place"))) for i, b in enumerate(books)]))["place"]
    out = F.lit(None)
    for i, b in enumerate(books):
        out = F.when(best == -i, implied(b, 5)).otherwise(out)
    return out


def market_first(books: Sequence[Trio], above: float = 0.0, digits: int = 4) -> Column:
    """The first complete book whose odds are all over ``above``."""
    return F.coalesce(*[F.when(_usable(b, above), implied(b, digits)) for b in books])


def market_renormalised(p: Trio) -> Column:
    """Stored market probabilities that sum to one; null if one is missing or they sum to nothing."""
    total = p[0] + p[1] + p[2]
    return F.when(total > 0, F.struct(*[(x / total).alias(n) for x, n in zip(p, ("home", "draw", "away"), strict=True)]))


# ------------------------------------------------------------- probabilities
def outcome(home_goals: Column, away_goals: Column) -> Column:
    """0 home win, 1 draw, 2 away win; null without a score."""
    return F.when(home_goals > away_goals, 0).when(home_goals == away_goals, 1).when(home_goals < away_goals, 2)


def rebalanced(p: Trio, digits: int = 5) -> Column:
    """Rounded probabilities whose rounding residual goes to the first largest."""
    r = [F.bround(x, digits) for x in p]
    rest = F.bround(F.lit(1.0) - (r[0] + r[1] + r[2]), digits)
    largest = F.when((r[0] >= r[1]) & (r[0] >= r[2]), 0).when(r[1] >= r[2], 1).otherwise(2)
    return F.struct(*[F.when(largest == i, F.bround(x + rest, digits)).otherwise(x).alias(n) for i, (x, n) in enumerate(zip(r, ("home", "draw", "away"), strict=True))])


def half_life_to_rate(days: float) -> float:
    if days <= 0:
        raise ValueError("a half-life is positive")
    return math.log(2.0) / days


def rate_to_half_life(rate: float) -> float:
    if rate <= 0:
        raise ValueError("a decay rate is positive")
    return math.log(2.0) / rate


def low_score_factor(x: Column, y: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """What ties the goals of both sides together in the four smallest scores."""
    one = F.lit(1.0)
    return F.when((x == 0) & (y == 0), one - lam * mu * rho).when((x == 0) & (y == 1), one + lam * rho).when((x == 1) & (y == 0), one + mu * rho).when((x == 1) & (y == 1), one - rho).otherwise(one)


def log_factorial(n: Column) -> Column:
    return F.log(F.factorial(n.cast("int")).cast("double"))


#: Statuses that are kept as they are, and those that count as full time.
KEPT_STATUSES = ("NS", "1H", "HT", "2H", "ET", "PST", "CANC", "ABD", "SUSP", "INT", "TBD")
FULL_TIME = ("FT", "AET", "PEN", "AWD", "WO")


def status_of(x: Column) -> Column:
    """The kept status of a feed's; unknown ones count as not started."""
    return F.when(x.isin(*FULL_TIME), "FT").when(x.isin(*KEPT_STATUSES), x).otherwise("NS")
