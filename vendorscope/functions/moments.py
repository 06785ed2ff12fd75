"""Moments and co-moments of many columns in one scan, as mergeable partials.

A task turns its batches into vectors, centres each batch on its own means and
keeps, for every pair of columns, the number of rows that have both, the means
over these rows, the squared deviations and the co-deviation. Two partials merge
exactly by the difference of their means (no difference of large sums anywhere, and
means are kept as a base value and what is above it, so columns shifted by 1e9 keep
their digits). Partials are k x k numbers each,
whatever the rows; they are merged in two steps, so that the last task gets about
the square root of the number of partitions.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorscope.functions.numeric import is_finite

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One partial: a row of k*k numbers per field, in this order. The mean is ``base``
#: (a value of the column) + ``above``; ``infinite`` counts rows of a pair where the
#: first column is infinite.
FIELDS = ("n", "base", "above", "m2", "c", "infinite")
PARTIAL = ", ".join(f"{f} array<double>" for f in FIELDS)


def batch_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The partial of a (columns, rows) matrix; NaN is missing. ``above[i, j]``
    and ``m2[i, j]`` are those of column i over the rows that have i and j."""
    there = ~np.isnan(x)
    endless = np.isinf(x)
    use = there & ~endless
    # a constant column stays exactly zero after its first value is taken off
    first = np.where(use.any(1), x[np.arange(len(x)), use.argmax(1)], 0.0)[:, None]
    y = np.where(use, x - first, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = y.sum(1, keepdims=True) / use.sum(1, keepdims=True)
        y = np.where(use, y - centre, 0.0)
        has = there.astype(float)
        n = has @ has.T
        s, q = y @ has.T, (y * y) @ has.T
        own = np.where(n > 0, s / n, 0.0)
        above = np.where(n > 0, own + np.nan_to_num(centre), 0.0)
    return n, np.broadcast_to(first, n.shape), above, q - n * own * own, y @ y.T - n * own * own.T, endless.astype(float) @ has.T


def merge_moments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The partial of both row sets together."""
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    gap = np.where((a[0] > 0) & (b[0] > 0), (b[1] - a[1]) + (b[2] - a[2]), 0.0)
    base, above = np.where(a[0] > 0, a[1], b[1]), np.where(a[0] > 0, a[2] + gap * share, b[2])
    weight = a[0] * share
    return n, base, above, a[3] + b[3] + gap * gap * weight, a[4] + b[4] + gap * gap.T * weight, a[5] + b[5]


def partial_rows(width: int):
    """mapInArrow body: rows of ``width`` doubles -> one partial."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = batch_moments(np.array([c.to_numpy(zero_copy_only=False) for c in b.columns], float).reshape(width, -1))
                total = one if total is None else merge_moments(total, one)
        if total is not None:
            yield as_batch(total)
    return run


def merged_rows(width: int):
    """mapInArrow body: partials -> one partial."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                one = tuple(np.array(c[i].as_py(), float).reshape(width, width) for c in b.columns)
                total = one if total is None else merge_moments(total, one)
        if total is not None:
            yield as_batch(total)
    return run


def as_batch(partial: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.ravel()], pa.list_(pa.float64())) for m in partial], list(FIELDS))


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (none for an empty table) of the ``FIELDS``, k*k numbers each."""
    width = len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(partial_rows(width), PARTIAL)
    some = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return (parts.repartition(some).mapInArrow(merged_rows(width), PARTIAL)
            .repartition(1).mapInArrow(merged_rows(width), PARTIAL))


def correlations(n: np.ndarray, _base, _above, m2: np.ndarray, c: np.ndarray, infinite: np.ndarray) -> np.ndarray:
    """Pearson's r a pair; NaN where undefined (fewer than two rows, a constant
    column, an infinite value among the pair's rows)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        r = c / (np.sqrt(m2) * np.sqrt(m2.T))
    r = np.where((n > 1) & (m2 > 0) & (m2.T > 0) & (infinite + infinite.T == 0), r, np.nan)
    return np.clip(r, -1.0, 1.0)


def correlation_rows(width: int):
    """mapInArrow body: the one partial -> (i, j, r) of all pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.divmod(np.arange(width * width), width)
        for b in batches:
            for k in range(b.num_rows):
                r = correlations(*(np.array(c[k].as_py(), float).reshape(width, width) for c in b.columns)).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i), pa.array(j), pa.array(r, mask=np.isnan(r))], ["i", "j", "corr"])
    return run


def column_rows(width: int):
    """mapInArrow body: rows of ``width`` doubles -> (k, n, mean, m2, lo, hi) a
    column; NaN is missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = np.zeros(width), np.zeros(width), np.zeros(width)
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        with np.errstate(invalid="ignore"):
            for b in batches:
                for k in range(width):
                    x = b.column(k).to_numpy(zero_copy_only=False)
                    x = x[~np.isnan(x)]
                    if not len(x):
                        continue
                    own = x[0] + (x - x[0]).mean() if np.isfinite(x[0]) else x.mean()
                    y = x - own
                    m2_own = (y * y).sum() - y.sum() ** 2 / len(x)
                    if n[k]:
                        gap, share = own - mean[k], len(x) / (n[k] + len(x))
                        m2[k] += m2_own + gap * gap * n[k] * share
                        # an infinite mean stays; two of opposite signs have none
                        mean[k] = mean[k] + gap * share if np.isfinite(gap) else mean[k] + own
                    else:
                        mean[k], m2[k] = own, m2_own
                    n[k] += len(x)
                    lo[k], hi[k] = min(lo[k], x.min()), max(hi[k], x.max())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2), pa.array(lo), pa.array(hi)],
            ["k", "n", "mean", "m2", "lo", "hi"])
    return run


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(k, count, mean, std, min, max) of each column that has values, from one
    scan; deviations of the tasks' rows are taken from the mean of all."""
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(column_rows(len(columns)), "k long, n long, mean double, m2 double, lo double, hi double")
    own = Window.partitionBy("k")
    least = F.min(F.struct("n", "mean")).over(own)["mean"]
    plain = F.sum(F.col("n") * F.col("mean")).over(own)
    from_least = least + F.sum(F.col("n") * (F.col("mean") - least)).over(own) / F.sum("n").over(own)
    whole = F.when(is_finite(plain), from_least).otherwise(plain)
    m2 = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("whole"), F.lit(2.0)))
    count = F.sum("n")
    return (parts.filter("n > 0").withColumn("whole", whole).groupBy("k").agg(
        count.alias("count"), F.first("whole").alias("mean"),
        F.when(count > 1, F.sqrt(m2 / (count - 1))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max")))
