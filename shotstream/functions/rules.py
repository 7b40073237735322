"""Recommendation rules compiled to columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: Sequence[Condition]
    action: str
    confidence: float
    rationale: str


# The two sample rules and their thresholds per environment.
DEV_RULES = (
    Rule(
        "high_risk_fast",
        (Condition("risk_h50", "gte", 0.85), Condition("missing_ratio", "lte", 0.2)),
        "reduce_heating_power",
        0.7,
        "High short-horizon disruption risk",
    ),
    Rule(
        "radiation_spike",
        (Condition("feature.prad_mean_w50", "gte", 1.5), Condition("risk_h200", "gte", 0.75)),
        "adjust_density",
        0.6,
        "Radiation increase correlates with instability",
    ),
)
PROD_RULES = (
    Rule(
        "high_risk_fast",
        (Condition("risk_h50", "gte", 0.85), Condition("missing_ratio", "lte", 0.25)),
        "reduce_heating_power",
        0.75,
        "High short-horizon disruption risk",
    ),
    Rule(
        "radiation_spike",
        (Condition("feature.prad_mean_w50", "gte", 1.8), Condition("risk_h200", "gte", 0.8)),
        "adjust_density",
        0.65,
        "Radiation increase correlates with instability",
    ),
)

_COMPARE: Mapping[str, Callable[[Column, Column], Column]] = {
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "eq": lambda a, b: a == b,
}


def compare(actual: Column, target: Column, op: str) -> Column:
    test = _COMPARE.get(op.lower())
    return F.lit(False) if test is None else F.coalesce(test(actual, target), F.lit(False))


def fires(
    rule: Rule,
    feature: Callable[[str], Column | None],
    risk: Mapping[str, Column],
) -> Column:
    """True when all conditions hold. An absent field fails its condition; no conditions is true."""
    result = F.lit(True)
    for condition in rule.conditions:
        if condition.field.startswith("feature."):
            value = feature(condition.field.removeprefix("feature."))
        else:
            value = risk.get(condition.field)
        if value is None:
            return F.lit(False)
        result = result & compare(value, F.lit(float(condition.value)), condition.op)
    return result


def recommendations(
    rules: Sequence[Rule],
    feature: Callable[[str], Column | None],
    risk: Mapping[str, Column],
) -> Column:
    """Array of the recommendations whose rule fires, in rule order."""
    entries = [
        F.when(
            fires(rule, feature, risk),
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.action).alias("action"),
                F.lit(float(rule.confidence)).alias("confidence"),
                F.lit(rule.rationale).alias("rationale"),
            ),
        )
        for rule in rules
    ]
    return F.array_compact(F.array(*entries))
