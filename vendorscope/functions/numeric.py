"""Numeric column expressions with pandas/numpy semantics, built from native
Spark functions (no Python UDFs, so they stay inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes NULL (the reference stores NaN as NULL, so later ``> 0``
    filters drop it instead of treating NaN as greater than everything)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def ieee_div(a, b) -> Column:
    """``a / b`` with IEEE results instead of ANSI errors.

    x/0 is +inf or -inf by the sign of x, 0/0 is NULL (NaN normalised), and a
    NULL operand gives NULL. Safe under ``spark.sql.ansi.enabled``: the division
    branch only runs when ``b != 0``.
    """
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), F.lit(None).cast("double"))
        .when(b != 0, nan_to_null(a / b))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )


def round_half_even(c, digits: int = 2) -> Column:
    """numpy's ``round``: ``rint(x * 10**d) / 10**d`` (0.125 -> 0.12).

    Spark's ``round`` is HALF_UP on the decimal string (0.125 -> 0.13).
    """
    scale = float(10 ** digits)
    return F.rint(_c(c) * scale) / scale


def is_finite(c) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def numeric_columns(schema: StructType) -> list[str]:
    """``select_dtypes(include=np.number)``: every numeric column, ids included."""
    return [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]


def floating_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]


def round_frame(df, digits: int = 2):
    """``round(frame, d)`` on a whole DataFrame: floating columns only, half-even;
    integer columns are left as they are (as pandas does)."""
    cols = set(floating_columns(df.schema))
    return df.select(*[round_half_even(F.col(n), digits).alias(n) if n in cols else F.col(n)
                       for n in df.columns])
