"""Learned three-way classifiers and calibration, by the distributed learners of ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import P


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(rows)


def fit_logistic(rows: DataFrame, features: Sequence[str], c: float = 1.0, rounds: int = 200):
    """Multinomial logistic regression with an L2 strength of 1 / (c n) on unscaled features; rows has outcome."""
    n = rows.count()
    learner = LogisticRegression(featuresCol="_x", labelCol="outcome", probabilityCol="_p", family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-6)
    return learner.fit(assembled(rows, features))


def predict_logistic(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    p = vector_to_array(F.col("_p"))
    scored = model.transform(assembled(rows, features)).withColumn("_a", p)
    return scored.select(*rows.columns, *[F.col("_a")[i].alias(name) for i, name in enumerate(P)])


def importance(model, features: Sequence[str], top: int = 10) -> list[tuple[str, float]]:
    """Features by their mean absolute coefficient over the classes."""
    weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return sorted(((f, round(float(w), 5)) for f, w in zip(features, weights, strict=True)), key=lambda x: -x[1])[:top]


# --------------------------------------------------------------- calibration
def _interpolated(knots: list[tuple[float, float]], x: Column) -> Column:
    """A monotone line through knots, flat outside them; the knots are part of the plan."""
    if len(knots) == 1:
        return F.lit(knots[0][1])
    points = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in knots])
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(points, lambda k: k["x"] <= x)), F.lit(len(knots) - 1)))
    low, high = F.element_at(points, i), F.element_at(points, i + 1)
    slope = (high["y"] - low["y"]) / (high["x"] - low["x"])
    return F.greatest(F.lit(knots[0][1]), F.least(F.lit(knots[-1][1]), low["y"] + slope * (x - low["x"])))


def fit_isotonic(rows: DataFrame) -> list[list[tuple[float, float]]]:
    """Knots of one increasing curve an outcome, from forecasts and what happened."""
    curves = []
    for k, p in enumerate(P):
        one = rows.select(F.col(p).alias("x"), (F.col("outcome") == k).cast("double").alias("label"))
        model = IsotonicRegression(featuresCol="x", labelCol="label", isotonic=True).fit(assembled(one, ["x"]).drop("x").withColumnRenamed("_x", "x"))
        knots = dict(zip(map(float, model.boundaries), (min(1.0, max(0.0, float(v))) for v in model.predictions), strict=True))
        curves.append(sorted(knots.items()))
    return curves


def calibrated(rows: DataFrame, curves: list[list[tuple[float, float]]], shrink: float = 1.0) -> DataFrame:
    """Forecasts mixed with their curves (``shrink`` of them) and made to sum to one again."""
    if not 0.0 <= shrink <= 1.0:
        raise ValueError("shrink is a share")
    mixed = [F.greatest((1.0 - shrink) * F.col(p) + shrink * _interpolated(c, F.col(p)), F.lit(1e-9)) for p, c in zip(P, curves, strict=True)]
    out = rows.withColumns({f"_{p}": m for p, m in zip(P, mixed, strict=True)})
    total = F.col("_p_home") + F.col("_p_draw") + F.col("_p_away")
    return out.withColumns({p: F.col(f"_{p}") / total for p in P}).drop(*[f"_{p}" for p in P])
