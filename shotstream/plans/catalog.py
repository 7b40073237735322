"""Registry of queries and of the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Results are compared at six decimals. The nudge keeps averages of two-decimal values, which often
# end in an exact half at the seventh decimal, off the rounding boundary.
NUDGE = 3.14159e-8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Round every double for comparison; + 0.0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(n) + F.lit(NUDGE), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def r(expression: str) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round(({expression}) + {NUDGE!r}, 6) + 0.0)"
