"""Registered queries: one Spark job and one DuckDB oracle per key.

``spark_queries()`` / ``oracle_sql()`` feed ``__spark_entry__``. Both sides
round every floating-point value to about seven significant digits by the
same rule, because the two engines sum doubles in different orders; every
other column is compared exactly. The library functions themselves return
unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from vendorscope.functions.numeric import ieee_div
from vendorscope.plans.context import VendorContext, context_for

CHECK_DIGITS = 7
# Values round to multiples of GRID * 10^(magnitude - CHECK_DIGITS). The step
# is no decimal fraction, so a sum of decimals never sits on a tie that the
# last bits of either engine would decide; for the same reason the magnitude
# steps at 10^(k - SHIFT), not at round numbers.
GRID = 1.0471975511965976
SHIFT = 0.123


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[VendorContext], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()):
    def deco(fn: Callable[[VendorContext], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles))
        return fn
    return deco


def check_round(c: Column) -> Column:
    """``c`` on the check grid; zeros (either sign) as 0.0, what is not finite
    as it is. The grid ends where its step underflows to 0 (values below about
    1e-316): such a value is NaN (inf * 0), as in the SQL."""
    magnitude = F.floor(F.log10(F.abs(c)) + SHIFT) - CHECK_DIGITS
    step = F.concat(F.lit("1e"), magnitude.cast("string")).cast("double") * GRID
    return (F.when(c == 0, F.lit(0.0))
            .when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c)
            .otherwise(F.rint(ieee_div(c, step)) * step))


def for_check(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[check_round(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def _oracle(q: Query) -> str:
    if not q.doubles:
        return q.sql

    def rounded(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        step = (f"(CAST('1e' || CAST(CAST(floor(log10(abs({x})) + {SHIFT!r}) AS BIGINT) - {CHECK_DIGITS} AS VARCHAR) AS DOUBLE)"
                f" * CAST({GRID!r} AS DOUBLE))")
        return (f"CASE WHEN {c} = 0 THEN CAST(0 AS DOUBLE) WHEN isnan({x}) OR isinf({x}) THEN {x} "
                f"ELSE round({x} / {step}) * {step} END AS {c}")
    repl = ", ".join(rounded(c) for c in q.doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{q.sql}\n) AS oracle_result"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def make(q: Query):
        return lambda spark, sf_dir: for_check(q.build(context_for(spark, sf_dir)))
    return {name: make(q) for name, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {name: _oracle(q) for name, q in REGISTRY.items() if q.sql is not None}


def _load() -> None:
    # importing the query modules fills REGISTRY
    from vendorscope.plans import (queries_analysis, queries_edge, queries_exact, queries_explore,  # noqa: F401
                                   queries_mart, queries_order, queries_stats)
