"""Golden values (FIXTURES.md §3, sf0.001) for every business question, and
properties the results must satisfy."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from vendorscope.functions.quantile import quantile_values
from vendorscope.operators import inventory as I
from vendorscope.operators import rankings as R
from vendorscope.operators import stats as ST
from vendorscope.plans.context import context_for


def close(a, b, rel=1e-6):
    return abs(a - b) <= rel * max(1.0, abs(b))


@pytest.fixture(scope="module")
def ctx(spark):
    return context_for(spark, SF001)


def test_mart(ctx):
    r = ctx.summary.agg(F.count("*").alias("n"), F.count_if(F.col("TotalSalesDollars") == 0).alias("unmatched"),
                        F.sum("TotalPurchaseDollars").alias("p"), F.sum("TotalSalesDollars").alias("s"),
                        F.sum("FreightCost").alias("f"), F.min("GrossProfit").alias("gp"),
                        F.count_if(F.col("ProfitMargin") == float("-inf")).alias("ninf")).first()
    assert (r.n, r.unmatched, r.ninf) == (925, 105, 105)
    assert close(r.p, 151251130.1) and close(r.s, 137658004.7703) and close(r.f, 594868439.054999)
    assert close(r.gp, -554292.333)
    assert ctx.clean.count() == 404


def test_brand_targets(ctx):
    th = R.brand_thresholds(R.brand_performance_stored(ctx.clean)).first()
    assert close(th.LowSalesThreshold, 311643.385) and close(th.HighMarginThreshold, 59.630863)
    assert R.target_brands(ctx.clean).count() == 6


def test_rankings(ctx):
    top = R.top_vendors_by_sales(ctx.clean, 1).first()
    assert top.VendorName == "Supplier#000000005" and close(top.TotalSalesDollars, 10442433.1186)
    pareto = R.vendor_pareto(ctx.clean).collect()
    assert (pareto[0].VendorName, pareto[0].PurchaseContributionPct) == ("Supplier#000000001", 11.88)
    tenth = [p for p in pareto if p.Rank == 10][0]
    assert (tenth.VendorName, tenth.PurchaseContributionPct) == ("Supplier#000000004", 8.2)
    assert close(tenth.CumulativeContributionPct, 99.99)
    cums = [p.CumulativeContributionPct for p in sorted(pareto, key=lambda p: p.Rank)]
    assert cums == sorted(cums)
    dep = R.vendor_dependency(ctx.clean).collect()
    assert close(sum(d.PurchaseContributionPct for d in dep), 100.0, 1e-12)
    assert close([d for d in dep if d.VendorName == "Other Vendors"][0].PurchaseContributionPct, 0.01)


def test_order_sizes(ctx):
    edges = quantile_values(ctx.clean, "TotalPurchaseQuantity", [1 / 3, 2 / 3]).first()
    assert edges.q0 == 36.0 and close(edges.q1, 72.333333)
    rows = {r.OrderSize: r for r in I.unit_price_by_order_size(ctx.clean).collect()}
    assert [rows[s].Rows for s in ("Small", "Medium", "Large")] == [136, 133, 135]
    assert close(rows["Small"].UnitPurchasePrice, 4476.871282)
    assert close(rows["Large"].UnitPurchasePrice, 1645.0332)


def test_inventory(ctx):
    assert ctx.clean.filter("StockTurnover < 1").count() == 93
    assert close(I.unsold_total(ctx.clean).first().TotalUnsoldValue, -8086938.35)
    slow = I.slow_vendors(ctx.clean, 1).first()
    assert slow.VendorName == "Supplier#000000000" and close(slow.StockTurnover, 0.500541)


def test_statistics(ctx):
    q = quantile_values(ctx.clean, "TotalSalesDollars", [0.75, 0.25]).first()
    assert close(q.q0, 292863.837775) and close(q.q1, 120160.128925)
    m = {r.segment: r for r in ST.sample_moments(ST.margin_samples(ctx.clean)).collect()}
    assert m["top"].n == m["low"].n == 101
    assert close(m["top"].mean, 50.428148) and close(m["low"].variance, 798.504414)
    w = ST.welch_test(ctx.clean).first()
    assert close(w.t_statistic, 1.926951) and close(w.dof, 198.017411) and close(w.p_value, 5.5417e-02, 1e-4)
    assert w.reject_h0 is False
    ci = {r.segment: r for r in ST.margin_confidence_intervals(ctx.clean).collect()}
    assert close(ci["top"].lower, 45.382562) and close(ci["top"].upper, 55.473733)
    assert close(ci["low"].lower, 37.54411) and close(ci["low"].upper, 48.701006)
    for r in ci.values():
        assert r.lower < r.mean < r.upper


def test_correlation_properties(ctx):
    cells = {(r.col_x, r.col_y): r.corr for r in ST.correlation_matrix(ctx.clean).collect()}
    assert close(cells[("TotalPurchaseQuantity", "TotalSalesQuantity")], 0.483711)
    assert close(cells[("PurchasePrice", "GrossProfit")], -0.090847)
    assert close(cells[("ProfitMargin", "TotalSalesPrice")], -0.041215)
    for (a, b), v in cells.items():
        assert cells[(b, a)] == v
        if a == b and v is not None:
            assert close(v, 1.0, 1e-12)


def test_welch_antisymmetric(ctx):
    """Swapping the samples flips the sign of t and keeps p."""
    from vendorscope.functions.tdist import t_two_sided_p
    m = {r.segment: r for r in ST.sample_moments(ST.margin_samples(ctx.clean)).collect()}
    vn1, vn2 = m["top"].variance / m["top"].n, m["low"].variance / m["low"].n
    t = (m["top"].mean - m["low"].mean) / (vn1 + vn2) ** 0.5
    t_rev = (m["low"].mean - m["top"].mean) / (vn2 + vn1) ** 0.5
    assert t == -t_rev
    assert t_two_sided_p(t, 198.0) == t_two_sided_p(t_rev, 198.0)


@pytest.mark.parametrize("build, column, descending", [
    ("vendor_summary_raw", "TotalPurchaseDollars", True),
    ("purchase_summary_loose", "TotalPurchaseDollars", False),
    ("sales_summary", "TotalSalesDollars", False),
    ("target_brands", "TotalSalesDollars", False),
])
def test_row_order(spark, build, column, descending):
    """Rows come in the order the original asks for."""
    from vendorscope.plans.registry import spark_queries
    values = [r[column] for r in spark_queries()[build](spark, SF001).collect()]
    assert len(values) > 3 and values == sorted(values, reverse=descending)
