"""The plans a large cluster would run: no broadcasts (every join a
sort-merge join), AQE skew-join splitting forced on tiny partitions, and one
vendor and one brand each holding a third of all lines. Results must equal
the default plan's and sums accumulated in plain Python."""

import contextlib
import math

import pytest
from pyspark.sql import functions as F

from vendorscope.functions.quantile import exact_quantiles
from vendorscope.operators import summary as S

LARGE_CLUSTER_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def conf(spark, settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    n = 30_000
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0                      # a third of all lines
    vendor = F.when(hot, F.lit(1)).otherwise(F.col("id") % 97 + 2)
    brand = F.when(F.col("id") % 3 == 1, F.lit(10)).otherwise(F.col("id") % 53 + 11)
    purchases = ids.select(
        vendor.alias("VendorNumber"),
        F.concat(F.lit(" V"), vendor.cast("string"), F.lit("\t")).alias("VendorName"),
        brand.alias("Brand"), F.concat(F.lit("B"), brand.cast("string")).alias("Description"),
        (F.col("id") % 5).cast("double").alias("PurchasePrice"),
        (F.col("id") % 17 + 1).alias("Quantity"),
        ((F.col("id") % 1000) / 10.0).alias("Dollars"))
    prices = spark.range(11, 64).select(
        (F.col("id") % 7).alias("VendorNumber"), F.col("id").alias("Brand"),
        (F.col("id") * 1.5).alias("Price"), (F.col("id") % 4 * 250).cast("string").alias("Volume"))
    prices = prices.unionByName(prices.filter(F.col("Brand") == 10))     # fan-out rows
    prices = prices.unionByName(spark.range(1).select(
        F.lit(3).cast("long").alias("VendorNumber"), F.lit(10).cast("long").alias("Brand"),
        F.lit(15.0).alias("Price"), F.lit("750").alias("Volume")))
    sales = ids.select(vendor.alias("VendorNo"), brand.alias("Brand"),
                       (F.col("id") % 11).alias("SalesQuantity"),
                       ((F.col("id") % 700) / 7.0).alias("SalesDollars"),
                       ((F.col("id") % 90) / 9.0).alias("SalesPrice"),
                       ((F.col("id") % 13) / 100.0).alias("ExciseTax"))
    invoice = ids.select(vendor.alias("VendorNumber"), (F.col("id") % 400).alias("PONumber"),
                         ((F.col("id") % 50) / 5.0).alias("Freight"))
    return purchases, prices, invoice, sales


def rows(df):
    """Rows sorted by every field (floats coarsened in the sort key only)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple(f"{x:.3f}" if isinstance(x, float) else str(x) for x in t))


def same(a, b):
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (ra, rb)
            else:
                assert x == y, (ra, rb)


def test_mart_same_under_large_cluster_plans(spark, skewed):
    default = rows(S.vendor_sales_summary(*skewed))
    with conf(spark, LARGE_CLUSTER_CONF):
        mart = S.vendor_sales_summary(*skewed)
        mart.write.format("noop").mode("overwrite").save()
        plan = mart._jdf.queryExecution().executedPlan().toString()
        large = rows(mart)
    assert "BroadcastHashJoin" not in plan
    same(large, default)
    assert len(default) > 0


def test_mart_equals_plain_sums_on_skewed_data(spark, skewed):
    """Sums accumulated in plain Python over the same generated ids."""
    from collections import Counter, defaultdict
    n, listed = 30_000, Counter()
    for brand in range(11, 64):
        listed[brand] = 1
    listed[10] = 1                                       # one extra row names brand 10
    units, dollars, freight = Counter(), Counter(), Counter()
    sold = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for i in range(n):
        vendor = 1 if i % 3 == 0 else i % 97 + 2
        brand = 10 if i % 3 == 1 else i % 53 + 11
        cost = float(i % 5)
        if cost > 0:
            units[vendor, brand, cost] += (i % 17 + 1) * listed[brand]
            dollars[vendor, brand, cost] += (i % 1000) / 10.0 * listed[brand]
        s = sold[vendor, brand]
        s[0] += i % 11
        s[1] += (i % 700) / 7.0
        s[2] += (i % 90) / 9.0
        s[3] += (i % 13) / 100.0
        freight[vendor] += (i % 50) / 5.0
    want = [(v, f" V{v}\t", b, f"B{b}", c, 15.0 if b == 10 else b * 1.5, "750" if b == 10 else str(b % 4 * 250),
             units[v, b, c], dollars[v, b, c], float(sold[v, b][0]), *sold[v, b][1:], freight[v])
            for v, b, c in units]
    with conf(spark, LARGE_CLUSTER_CONF):
        got = S.vendor_summary_raw(*skewed)
        same(sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[2], r[4])),
             sorted(want, key=lambda r: (r[0], r[2], r[4])))


def test_hot_value_quantiles_stay_exact(spark):
    """A third of all values identical: the tie collapses to one counted row,
    and the result still equals pandas."""
    import pandas as pd
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(42.0))
                               .otherwise((F.col("id") * 7919 % 10007).cast("double")).alias("x"))
    probs = [0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9]
    with conf(spark, LARGE_CLUSTER_CONF):
        got = {r.prob: r.value for r in exact_quantiles(df, ["x"], probs).collect()}
    exp = pd.Series([r.x for r in df.collect()]).quantile(probs)
    assert all(got[p] == exp[p] for p in probs)


@pytest.mark.parametrize("bits", [16, 4])
def test_quantiles_from_digits(spark, monkeypatch, bits):
    """Two million rows whose doubles differ in all 64 bits, in tasks that
    hold few digits: the passes end, and the result is the sorted column's."""
    import vendorscope.functions.quantile as Q
    n = 2_000_000 if bits == 16 else 20_000
    passes = []
    plain = Q.digit_counts
    monkeypatch.setattr(Q, "DIGIT_BITS", bits)
    monkeypatch.setattr(Q, "HELD", 500)
    monkeypatch.setattr(Q, "digit_counts", lambda *a: (passes.append(a[1]), plain(*a))[1])
    x = (F.col("id") * 7919 % 1_000_003 - 500_000) / 3.0
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-0.0)).otherwise(x * F.abs(x) / 7.0).alias("x"))
    probs = [0.0, 0.1, 0.5, 0.85, 1.0]
    got = Q.exact_quantiles_wide(df, ["x"], probs).first()
    xs = sorted(r.x for r in df.collect())
    for k, p in enumerate(probs):
        v = (n - 1) * p
        lo = int(v)
        a, b, t = xs[lo], xs[min(lo + 1, n - 1)], v - lo
        assert got[f"q{k}"] == (b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
    assert len(passes) <= 64 // bits and passes == sorted(passes, reverse=True)


def test_box_plot_of_many_groups(spark, monkeypatch):
    """More groups than are numbered take the grouped way, with equal results."""
    import vendorscope.functions.quantile as Q
    from vendorscope.operators.distributions import boxplot_stats
    df = spark.range(6000).select((F.col("id") % 200).alias("g"), (F.col("id") * F.col("id") % 1009).cast("double").alias("v"))
    few = sorted(tuple(r) for r in boxplot_stats(df, ["v"], by=["g"]).collect())
    monkeypatch.setattr(Q, "MAX_GROUPS", 50)
    many = sorted(tuple(r) for r in boxplot_stats(df, ["v"], by=["g"]).collect())
    assert few == many and len(few) == 200


def test_mart_shuffles_sums_not_lines(spark):
    """Without broadcasts: order lines are exchanged for the part join alone;
    the next exchange above it carries partial sums."""
    import contextlib as cl
    import io
    import re

    from vendorscope.operators import summary as S2
    from vendorscope.sources.fixtures import vendor_sources
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.enabled": "false"}):
        s = vendor_sources(spark, "/root/testdata/sf0.001")
        for df in (S2.purchase_summary(s.purchases, s.purchase_prices, s.purchase_totals),
                   S2.purchase_summary_loose(s.purchases, s.purchase_prices, s.purchase_totals), S2.sales_summary(s.sales)):
            text = io.StringIO()
            with cl.redirect_stdout(text):
                df.explain()
            plan = text.getvalue()
            keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
            assert any("l_partkey" in k for k in keys) and not any("l_suppkey" in k for k in keys)
            lines = plan.splitlines()
            at = next(i for i, x in enumerate(lines) if "hashpartitioning(l_partkey" in x)
            above = [x for x in lines[:at] if "Exchange hash" in x or "HashAggregate" in x or "SortMergeJoin" in x]
            # from the part join upwards: the join, a partial aggregate, then the next exchange
            order = [("join" if "SortMergeJoin" in x else "agg" if "HashAggregate" in x else "exchange") for x in reversed(above)]
            assert order[0] == "join" and order[1] == "agg"


def test_check_grid_below_its_smallest_step(spark):
    """The tail of a KDE curve may be any subnormal number."""
    import duckdb

    from vendorscope.plans.registry import Query, _oracle, check_round

    values = [0.0, -0.0, 5e-324, -1e-318, 1e-317, 3.3e-310, 2.2250738585072014e-308, -1e-300, 0.125, 1.7e308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    got = [r.x for r in df.select("i", check_round(F.col("x")).alias("x")).orderBy("i").collect()]
    sql = ", ".join(f"({i}, CAST('{v!r}' AS DOUBLE))" for i, v in enumerate(values))
    want = duckdb.sql(_oracle(Query("q", None, f"SELECT * FROM (VALUES {sql}) AS t(i, x)", ("x",)))
                      + " ORDER BY i").fetchall()
    assert [repr(abs(x)) for x in got] == [repr(abs(x)) for _, x in want]
    assert [math.isnan(x) for x in got] == [i in (2, 3, 4) for i in range(len(values))]


def star_tables(spark, folder):
    """Small part, supplier and lineitem tables: repeated and null keys, a brand
    whose prices are infinite, lines without discount."""
    inf = float("inf")
    part = [(k, f"Brand#{k % 14}", ["ECONOMY", "LARGE", "ODD", "OTHER"][k % 4], 900.0 + k, k % 7) for k in range(60)]
    part += [(3, "Brand#3", "LARGE", 950.0, 2), (None, "Brand#4", "LARGE", 1.0, 1)]
    part += [(100 + k, "Brand#26", "ECONOMY", inf, 1) for k in range(3)]
    supplier = [(k, f"Supplier#{k}") for k in range(6)] + [(2, "Supplier#2"), (None, "Supplier#none")]
    keys = [*range(60), 100, 101, 102, None, 999]
    line = [(i % 11 if i % 17 else None, keys[i % len(keys)], i % 7 if i % 19 else None, float(i % 5 + 1), 10.0 * (i % 23),
             [0.0, 0.05, None][i % 3], 0.02, "FO"[i % 4 == 3], "1995-01-01") for i in range(1500)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_retailprice double, p_size int"
                          ).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(supplier, "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate string"
                          ).write.parquet(f"{folder}/lineitem.parquet")


def test_summed_extracts_equal_the_lines(spark, tmp_path):
    """Totals that are summed before the joins equal sums over the extracts' lines,
    and the mart from them the mart from the extracts (F2, F3)."""
    from vendorscope.plans.context import VendorContext
    from vendorscope.sources.fixtures import edge_sources, vendor_sources

    star_tables(spark, str(tmp_path))
    base = vendor_sources(spark, str(tmp_path))
    for s in (base, edge_sources(base)):
        def rows(df, names):
            return sorted(((tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.select(*names).collect()),
                          key=str)
        names = [*S.PURCHASE_KEYS, "Quantity", "Dollars"]
        got = rows(s.purchase_totals, names)
        assert got == rows(S.purchase_totals(s.purchases), names)
        assert len(got) > 100
        freight = ["VendorNumber", "FreightCost"]
        assert rows(s.freight_totals, freight) == rows(S.freight_summary(s.vendor_invoice), freight)
        slow = S.vendor_summary_raw(s.purchases, s.purchase_prices, s.vendor_invoice, s.sales)
        ctx = VendorContext(spark, s)
        assert rows(ctx.summary_raw, slow.columns) == rows(slow, slow.columns)
        assert rows(ctx.summary, ["VendorNumber", "Brand", "GrossProfit"]) == rows(
            S.clean_summary_columns(slow), ["VendorNumber", "Brand", "GrossProfit"])


def test_mart_shuffles_sums_once(spark, tmp_path):
    """No shuffle of the wide rows by vendor alone, none for the price list's
    fan-out, and no second stored copy of the mart (F2, F3)."""
    from vendorscope.plans.context import VendorContext
    from vendorscope.sources.fixtures import edge_sources, vendor_sources

    star_tables(spark, str(tmp_path))
    base = vendor_sources(spark, str(tmp_path))
    for s in (base, edge_sources(base)):
        ctx = VendorContext(spark, s)
        assert ctx.summary.count() > 100 and ctx._raw is None
        freight = s.freight_totals.localCheckpoint()
        with conf(spark, {"spark.sql.adaptive.enabled": "false"}):
            plan = S.vendor_summary_raw(s.purchases, s.purchase_prices, s.vendor_invoice, s.sales, totals=s.purchase_totals,
                                        freight=F.broadcast(freight))._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines()
                if "Exchange hashpartitioning" in line]
        assert not [k for k in keys if "VendorName" in k and "s_suppkey" not in k]
        assert not [k for k in keys if k.startswith("VendorNumber") and k.count(",") < 2]       # key, partitions
