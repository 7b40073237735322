"""Linear model, calibration and alert columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    coefficients: Mapping[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    version: str = ""


@dataclass(frozen=True)
class Calibration:
    """``platt`` maps by a logistic curve, ``isotonic`` by ``knots`` (score, probability)."""

    kind: str = "platt"
    scale: float = 1.0
    offset: float = 0.0
    version: str = ""
    knots: Sequence[tuple[float, float]] = ()


@dataclass(frozen=True)
class Thresholds:
    # Alert thresholds of the default configuration.
    risk_h50: float = 0.85
    risk_h200: float = 0.75
    high: float = 0.9


def wide_lookup(columns: Sequence[str]) -> Callable[[str], Column | None]:
    """Find a feature among the columns of a wide frame."""
    present = set(columns)
    return lambda name: F.col(name) if name in present else None


def map_lookup(column: str = "features") -> Callable[[str], Column]:
    """Find a feature in a map column; null when the vector lacks it."""
    return lambda name: F.try_element_at(F.col(column), F.lit(name))


def contributions(
    model: LinearModel, lookup: Callable[[str], Column | None]
) -> list[tuple[str, Column]]:
    found = [(name, lookup(name), coef) for name, coef in sorted(model.coefficients.items())]
    return [(name, value * F.lit(float(coef))) for name, value, coef in found if value is not None]


def linear_score(model: LinearModel, lookup: Callable[[str], Column | None]) -> Column:
    """Intercept plus the dot product; a feature the vector lacks adds nothing."""
    terms = [F.coalesce(term, F.lit(0.0)) for _, term in contributions(model, lookup)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def calibrated(score: Column, calibration: Calibration) -> Column:
    if calibration.kind == "isotonic":
        return _interpolated(score, calibration.knots)
    scale = calibration.scale or 1.0
    return sigmoid(score * F.lit(float(scale)) + F.lit(float(calibration.offset)))


def _interpolated(score: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots and flat outside them. The number of knots follows the training data, so
    this is a binary search over arrays rather than a chain of conditions."""
    if not knots:
        raise ValueError("isotonic calibration needs knots")
    xs = np.array([x for x, _ in knots], dtype=float)
    ys = np.array([y for _, y in knots], dtype=float)

    @F.pandas_udf("double")
    def interpolate(values: pd.Series) -> pd.Series:
        return pd.Series(np.interp(values.to_numpy(dtype=float), xs, ys))

    return interpolate(score)


def long_horizon_risk(short: Column) -> Column:
    """Stand-in for the long horizon while only one model is given."""
    return F.least(F.lit(1.0), short * F.lit(0.9) + F.lit(0.05))


def severity(risk: Column, thresholds: Thresholds = Thresholds()) -> Column:
    return F.when(risk >= F.lit(thresholds.high), "high").otherwise("medium")


def three_decimals(value: Column) -> Column:
    """A number from 0 up as text with three decimals, rounded by its exact binary value, ties to even.

    Formatting in Java starts from the shortest decimal text of a double, so it rounds 0.9345, which is
    a little less than that, up. Here ``value * 2**63`` is put together from its whole part at 2**60 and
    three more bits; that is exact from 2**-11 up, and what is smaller is 0.000 in any case.
    """
    unit = F.lit(str(1 << 63)).cast("decimal(38,0)")
    whole = F.floor(value).cast("bigint")
    high = (value - whole) * F.lit(float(1 << 60))
    low = ((high - F.floor(high)) * 8).cast("bigint")
    scaled = (high.cast("bigint").cast("decimal(20,0)") * F.lit(8).cast("decimal(1,0)") + low.cast("decimal(1,0)")) * F.lit(
        1000
    ).cast("decimal(4,0)")
    digits = F.floor(scaled / unit).cast("bigint")
    rest = scaled - digits.cast("decimal(4,0)") * unit
    half = F.lit(str(1 << 62)).cast("decimal(38,0)")
    up = (rest > half) | ((rest == half) & (digits % 2 == 1))
    digits = digits + F.when(up, 1).otherwise(0)
    whole = whole + F.when(digits == 1000, 1).otherwise(0)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((digits % 1000).cast("string"), 3, "0"))


def alert_message(horizon: Column, risk: Column) -> Column:
    # Fixed value: the wording of an alert.
    return F.concat(F.lit("High disruption risk ("), horizon, F.lit("="), three_decimals(risk), F.lit(")"))
