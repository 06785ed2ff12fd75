import math
import random

import pytest
from pyspark.sql import functions as F

from vendorscope.functions.exact_sum import exact_sums
from vendorscope.operators import inventory as I
from vendorscope.operators import rankings as R
from vendorscope.operators import summary as S
from vendorscope.plans.context import context_for
from tests.conftest import SF001


def cases(rng):
    kinds = [lambda: round(rng.uniform(-1e5, 1e5), 2),
             lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 300),
             lambda: rng.choice([1e16, -1e16, 1.0, 2.0 ** -30, 1e-300, -1e-300]),
             lambda: math.ldexp(rng.getrandbits(53) | 1, rng.randint(-1074, -1000)) * rng.choice([1, -1]),
             lambda: rng.choice([0.0, -0.0, 2.0 ** 53, 1.0, -1.0, 0.5]),
             lambda: math.ldexp(1 + rng.random(), rng.randint(-90, 120))]
    return [(g, kinds[g % 6](), rng.choice([None, 0.1, -0.3, 1e9])) for g in range(60)
            for _ in range(rng.choice([1, 2, 5, 40, 300]))]


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_sums_are_those_of_fsum_in_any_partitioning(spark, parts):
    rows = cases(random.Random(5))
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(parts)
    got = {r.g: (r.sx, r.sy, r.n) for r in exact_sums(df, ["g"], {"sx": "x", "sy": "y"}, {"n": F.lit(1)}).collect()}
    want = {}
    for g in range(60):
        ys = [r[2] for r in rows if r[0] == g and r[2] is not None]
        xs = [r[1] for r in rows if r[0] == g]
        want[g] = (math.fsum(xs), math.fsum(ys) if ys else None, len(xs))
    assert got == want


def test_values_that_are_not_finite_nulls_and_no_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, 1.0), (1, inf), (2, inf), (2, -inf), (3, nan), (3, 1.0), (4, None), (5, -inf), (None, 2.5), (None, 0.25),
            (6, 1.5e308), (6, 1.5e308), (7, 1e308), (7, 1e308), (7, -1e308)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.s for r in exact_sums(df, ["g"], {"s": "x"}).collect()}
    assert got.pop(2) != got.get(2) and math.isnan(got.pop(3))
    assert got == {1: inf, 4: None, 5: -inf, None: 2.75, 6: inf, 7: 1e308}
    assert [r.s for r in exact_sums(df.filter("g = 7"), [], {"s": "x"}).collect()] == [1e308]
    assert [r.s for r in exact_sums(df.filter("false"), [], {"s": "x"}).collect()] == [None]
    assert exact_sums(df.filter("false"), ["g"], {"s": "x"}).count() == 0


def test_plan_is_native_and_adds_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("x"))
    plan = exact_sums(df, ["g"], {"s": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum" in plan


def answers(spark, mart):
    clean = S.consistent_rows(mart)
    frames = [R.vendor_pareto(clean, exact=True), R.vendor_dependency(clean, exact=True), R.top_sales(clean, "VendorName", exact=True),
              R.brand_performance(clean, exact=True).orderBy("Description"), I.unsold_total(clean, exact_label=True),
              I.unsold_by_vendor(clean, exact_label=True)]
    return [[tuple(r) for r in f.collect()] for f in frames]


def test_shares_labels_and_thresholds_do_not_depend_on_partitions(spark):
    mart = context_for(spark, SF001).summary
    one, seven, many = (answers(spark, mart.repartition(n, F.rand(n))) for n in (1, 7, 60))
    assert one == seven == many


def test_the_exact_mart_does_not_depend_on_partitions(spark):
    s = context_for(spark, SF001).sources
    tables = (s.purchases, s.purchase_prices, s.vendor_invoice, s.sales)
    marts = [sorted(map(tuple, S.vendor_sales_summary(*[t.repartition(n, F.rand(n)) for t in tables], exact=True).collect()), key=repr)
             for n in (1, 7)]
    assert marts[0] == marts[1]
    plain = S.vendor_sales_summary(*tables)
    assert plain.schema == S.vendor_sales_summary(*tables, exact=True).schema and plain.count() == len(marts[0])
