"""Properties the results must satisfy, and randomized
quantiles against pandas."""

import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF001
from vendorscope.functions.quantile import exact_quantiles
from vendorscope.operators import distributions as D
from vendorscope.operators import inventory as I
from vendorscope.operators import summary as S
from vendorscope.plans.context import context_for


@pytest.fixture(scope="module")
def ctx(spark):
    return context_for(spark, SF001)


def test_consistency_filter_idempotent(ctx):
    once = ctx.clean
    twice = S.consistent_rows(once)
    assert once.count() == twice.count() == once.subtract(twice).count() + twice.count()


def test_histogram_counts_cover_finite_values(ctx):
    h = D.histogram(ctx.summary).groupBy("column_name").agg(F.sum("count").alias("n"))
    got = {r.column_name: r.n for r in h.collect()}
    for col, n in got.items():
        c = F.col(col).cast("double")
        finite = ctx.summary.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))).count()
        assert n == finite, col


def test_histogram_bins_contiguous(ctx):
    rows = D.histogram(ctx.clean, ["ProfitMargin"]).orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(30))
    assert all(rows[i].bin_hi == rows[i + 1].bin_lo for i in range(29))


def test_boxplot_order(ctx):
    for r in D.boxplot_stats(ctx.summary).collect():
        assert r.whislo <= r.q1 <= r.median <= r.q3 <= r.whishi, r.column_name
        assert 0 <= r.n_outliers <= r.n


def test_order_sizes_partition_rows(ctx):
    sized = I.with_order_size(ctx.clean)
    counts = {r.OrderSize: r["count"] for r in sized.groupBy("OrderSize").count().collect()}
    assert sum(counts.values()) == ctx.clean.count() and None not in counts
    ranges = {r.OrderSize: (r.lo, r.hi) for r in sized.groupBy("OrderSize").agg(
        F.min("TotalPurchaseQuantity").alias("lo"), F.max("TotalPurchaseQuantity").alias("hi")).collect()}
    assert ranges["Small"][1] < ranges["Medium"][0] and ranges["Medium"][1] < ranges["Large"][0]


def test_kde_density_positive_and_spans_range(ctx):
    k = D.kde(ctx.clean, ["ProfitMargin"]).orderBy("grid").collect()
    lo, hi = ctx.clean.agg(F.min("ProfitMargin"), F.max("ProfitMargin")).first()
    assert k[0].x == lo and k[-1].x == hi and len(k) == 200
    assert all(r.density > 0 for r in k)
    area = sum((k[i + 1].x - k[i].x) * (k[i].density + k[i + 1].density) / 2 for i in range(199))
    assert 0.5 < area <= 1.0 + 1e-9


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.integers(-50, 50).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=60),
       st.lists(st.sampled_from([0.0, 0.1, 0.15, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 0.85, 1.0]),
                min_size=1, max_size=4, unique=True))
def test_exact_quantiles_hypothesis(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], probs).collect()}
    exp = pd.Series(values).quantile(probs)
    for p in probs:
        e = exp[p]
        assert (got[p] is None and math.isnan(e)) or got[p] == e, (values, p, got[p], e)
