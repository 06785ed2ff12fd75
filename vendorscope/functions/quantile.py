"""Exact quantiles with pandas/numpy ``linear`` semantics and bounded memory.

Spark's exact ``percentile`` keeps a value->count map of the whole column and
merges it in one task for a global aggregate: unbounded at scale. Here order
statistics are found by radix selection over a 64-bit image of the double that
keeps its order. Every pass counts the next ``DIGIT_BITS`` bits of all columns, groups
and ranks at once: a task counts its rows in vectors (count, least and greatest
image a digit), Spark adds the digits up, and a running sum locates each rank. What
goes on to the next pass is the digit that holds a rank; a rank is settled when
its digit holds one value, or when it is the first or last of its digit. After
64 / ``DIGIT_BITS`` = 4 passes every digit is a value, whatever the number of rows,
ties or skew.

A pass shuffles at most 2**``DIGIT_BITS`` rows per task and open digit, and the
driver gets one row per open rank (two ranks a prob, column and group). Groups
(``by``) up to ``MAX_GROUPS`` are numbered by a join with their (broadcast) keys, so
their rows are never shuffled; with more groups the rows are shuffled by group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the digit counts run in Python workers: pickled by value, as numpy and
# pyarrow are all that executors need
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT_BITS = 16
MAX_GROUPS = 1024
#: Digits that a task holds before it adds them up.
HELD = 1 << 18
LONGS = "series long, digit long, n long, lo long, hi long"


def _lerp(a: float, b: float, t: float) -> float | None:
    """numpy's ``_lerp``: a + (b-a)*t, or b - (b-a)*(1-t) once t >= 0.5; NaN is NULL."""
    d = b - a
    v = b - d * (1.0 - t) if t >= 0.5 else a + d * t
    return None if math.isnan(v) else v


def image(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles (-0.0 as 0.0)."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_image(s: int) -> float:
    bits = s if s >= 0 else s ^ 0x7FFFFFFFFFFFFFFF
    return float(np.array([bits], np.int64).view(np.float64)[0])


def _added_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(series, digit, n, lo, hi) with one row a (series, digit)."""
    series, digit, n, lo, hi = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((digit, series))
    series, digit, n, lo, hi = (c[order] for c in (series, digit, n, lo, hi))
    at = np.flatnonzero(np.append(True, (np.diff(series) != 0) | (np.diff(digit) != 0)))
    return (series[at], digit[at], np.add.reduceat(n, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at))


def digit_counts(width: int, shift: int, open_digits: dict[int, np.ndarray] | None):
    """mapInArrow body: (group, ``width`` doubles) -> digit counts. A series is
    group * width + column. With ``open_digits`` (series -> sorted digits of the
    pass before) only values inside these are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _added_up(held)],
                                              ["series", "digit", "n", "lo", "hi"])
        for b in batches:
            group = b.column(0).to_numpy()
            for c in range(width):
                x = b.column(c + 1).to_numpy(zero_copy_only=False)
                there = ~np.isnan(x)
                s, series = image(x[there]), group[there] * width + c
                if open_digits is not None:
                    inside = np.zeros(len(s), bool)
                    for one in np.unique(series).tolist():
                        wanted = open_digits.get(one)
                        if wanted is not None:
                            own = series == one
                            inside[own] = np.isin(s[own] >> (shift + DIGIT_BITS), wanted)
                    s, series = s[inside], series[inside]
                if len(s):
                    held.append(_added_up([(series, s >> shift, np.ones(len(s), np.int64), s, s)]))
                    size += len(held[-1][0])
            if size > HELD:
                held[:] = [_added_up(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def ranks(n: int, q: float) -> tuple[int, int, float]:
    """numpy: virtual = (n-1)*q, both neighbours clamp to the last element."""
    virtual = (n - 1) * q
    if virtual >= n - 1:
        return n, n, virtual + 1
    return math.floor(virtual) + 1, math.floor(virtual) + 2, virtual - math.floor(virtual)


def _select(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[int, list[float | None]]:
    """series -> quantiles; ``df`` has _g (the group's number) and the columns."""
    spark, width = df.sparkSession, len(columns)
    # pandas hands q * 100 to numpy, which divides by 100 again
    eff = [(p * 100.0) / 100.0 for p in probs]
    rows = df.select(F.col("_g").cast("long"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def counted(shift: int, digits: dict[int, np.ndarray] | None) -> DataFrame:
        parts = rows.mapInArrow(digit_counts(width, shift, digits), LONGS)
        return parts.groupBy("series", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    # the first pass also gives every series' size, hence the ranks
    shift = 64 - DIGIT_BITS
    own = Window.partitionBy("series")
    virtual = (F.col("size") - 1).cast("double") * F.col("q")
    least = F.when(virtual >= F.col("size") - 1, F.col("size")).otherwise(F.floor(virtual) + 1)
    seen = (counted(shift, None)
            .withColumn("upto", F.sum("n").over(own.orderBy("digit"))).withColumn("size", F.sum("n").over(own))
            .select("*", F.posexplode(F.array(*[F.lit(q) for q in eff])).alias("prob", "q"))
            .withColumn("rank", F.explode(F.array_distinct(F.array(least, F.least(least + 1, F.col("size"))))))
            .filter("upto >= rank and upto - n < rank")
            .select("series", "prob", "rank", "size", "digit", "n", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("at"))
            .collect())
    sizes = {r.series: r.size for r in seen}
    value: dict[tuple[int, int], int] = {}                   # (series, rank) -> image
    todo: dict[tuple[int, int], tuple[int, int]] = {}        # (series, rank) -> (digit, rank inside it)

    def settle(series: int, rank: int, digit: int, n: int, lo: int, hi: int, at: int) -> None:
        todo.pop((series, rank), None)
        if lo == hi or at in (1, n):
            value[series, rank] = hi if at == n else lo
        else:
            todo[series, rank] = (digit, at)

    for r in seen:
        settle(r.series, r["rank"], r.digit, r.n, r.lo, r.hi, r["at"])
    while todo:
        shift -= DIGIT_BITS
        digits: dict[int, set] = {}
        for (series, _), (digit, _) in todo.items():
            digits.setdefault(series, set()).add(digit)
        wanted = spark.createDataFrame(
            [(s, d, k, at) for (s, k), (d, at) in todo.items()], "series long, above long, rank long, at long")
        place = Window.partitionBy("series", "above").orderBy("digit")
        found = (counted(shift, {s: np.array(sorted(d), np.int64) for s, d in digits.items()})
                 .withColumn("above", F.shiftright("digit", DIGIT_BITS))
                 .withColumn("upto", F.sum("n").over(place))
                 # a row per open rank: two a prob, column and group at most
                 .join(F.broadcast(wanted), ["series", "above"]).filter("upto >= at and upto - n < at")
                 .select("series", "rank", "digit", "n", "lo", "hi", (F.col("at") - F.col("upto") + F.col("n")).alias("at"))
                 .collect())
        for r in found:
            settle(r.series, r["rank"], r.digit, r.n, r.lo, r.hi, r["at"])
    out: dict[int, list[float | None]] = {}
    for series, n in sizes.items():
        out[series] = [_lerp(from_image(value[series, r1]), from_image(value[series, r2]), gamma)
                       for r1, r2, gamma in (ranks(n, q) for q in eff)]
    return out


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def group_keys(df: DataFrame, by: Sequence[str], most: int | None = None) -> list[tuple] | None:
    """The distinct non-NULL keys, or None where there are more than ``most``."""
    most = MAX_GROUPS if most is None else most
    keys = df.select(*by).dropna().distinct().limit(most + 1).collect()
    return None if len(keys) > most else sorted(tuple(r) for r in keys)


def exact_quantiles_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                         by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., column_name) with columns ``q0, q1, ...`` (one per
    prob): pandas ``Series.quantile`` (linear); NULL and NaN skipped; a group
    without values has no row (pandas gives NaN); NULL ``by`` keys are
    dropped, as pandas' groupby does.

    Runs its passes at once and returns a small local table, except for
    more than ``MAX_GROUPS`` groups (see ``_by_group``)."""
    spark, by, columns, probs = df.sparkSession, list(by), list(columns), [float(p) for p in probs]
    keys = group_keys(df, by) if by else [()]
    if keys is None:
        return _by_group(df, columns, probs, by)
    if by:
        types = [df.schema[b] for b in by]
        numbers = spark.createDataFrame([(*k, g) for g, k in enumerate(keys)],
                                        T.StructType([*types, T.StructField("_g", T.LongType())]))
        df = df.join(F.broadcast(numbers), by)                # MAX_GROUPS rows at most
    else:
        df = df.withColumn("_g", F.lit(0))
    found = _select(df, columns, probs) if columns and probs and keys else {}
    rows = [(*keys[s // len(columns)], columns[s % len(columns)], *q) for s, q in sorted(found.items())]
    schema = T.StructType(
        [T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField("column_name", T.StringType())]
        + [T.StructField(f"q{k}", T.DoubleType()) for k in range(len(probs))])
    return spark.createDataFrame(rows, schema)


def _by_group(df: DataFrame, columns: Sequence[str], probs: list[float], by: list[str]) -> DataFrame:
    """Many groups: one grouped aggregate with Spark's exact ``percentile``
    (partial value->count maps per group, merged by group)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _clean(c).alias("x")) for c in columns])
    long = df.dropna(subset=by).select(*by, F.inline(cells)).filter(F.col("x").isNotNull())
    return long.groupBy(*by, "column_name").agg(
        *[F.percentile("x", F.lit((p * 100.0) / 100.0)).alias(f"q{k}") for k, p in enumerate(probs)])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Long result ``(*by, column_name, prob, value)`` of ``exact_quantiles_wide``."""
    probs = [float(p) for p in probs]
    wide = exact_quantiles_wide(df, columns, probs, by)
    cells = F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"q{k}").alias("value"))
                      for k, p in enumerate(probs)])
    return wide.select(*by, "column_name", F.inline(cells))


def quantile_values(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row with one column ``q0, q1, ...`` per requested prob (no row
    when the column has no values; as a scalar subquery that reads NULL)."""
    wide = exact_quantiles_wide(df, [column], probs)
    return wide.select(*[f"q{k}" for k in range(len(probs))])


def quantile_scalar(df: DataFrame, column: str, prob: float) -> Column:
    """The quantile as a scalar-subquery column: usable in filters and
    projections of any DataFrame without a join."""
    return quantile_values(df, column, [prob]).select("q0").scalar()
