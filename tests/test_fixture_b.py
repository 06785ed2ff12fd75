"""Fixture B: hand-made edge rows, one per semantic trap (grouping before
trimming, fan-out of the brand-only price join, 0/0 and x/0, NULL names,
freight repeated per vendor row)."""

import math

import pytest

from vendorscope.operators import rankings as R
from vendorscope.operators import summary as S
from vendorscope.sources import schemas


@pytest.fixture(scope="module")
def sources(spark):
    purchases = spark.createDataFrame([
        (1, " ACME ", 10, "Gin", 5.0, 10, 50.0),
        (1, " ACME ", 10, "Gin", 5.0, 5, 25.0),
        (1, "ACME", 10, "Gin", 5.0, 1, 5.0),
        (1, " ACME ", 11, "Rum", 0.0, 3, 0.0),
        (2, "Bolt\t", 20, "Rye", 8.0, 4, 32.0),
        (2, "Bolt\t", 21, "Ale", 2.0, 0, 0.0),
        (3, None, 30, "Mead", 1.0, 5, 5.0),
        (4, "Zed", 99, "X", 1.0, 1, 1.0),
    ], "VendorNumber long, VendorName string, Brand long, Description string, "
       "PurchasePrice double, Quantity long, Dollars double")
    prices = spark.createDataFrame([
        (1, 10, 9.0, "750"), (1, 11, 9.0, "750"), (2, 20, 12.0, None), (2, 21, 3.0, " 50 "),
        (3, 30, 2.0, "750"), (5, 30, 2.0, "750"),
    ], "VendorNumber long, Brand long, Price double, Volume string")
    sales = spark.createDataFrame([(1, 10, 12, 120.0, 10.0, 1.2), (3, 30, 4, 8.0, 2.0, 0.1)],
                                  schemas.SALES)
    invoice = spark.createDataFrame([(1, 100, 10.0), (1, 101, 5.0), (2, 200, 3.0)],
                                    "VendorNumber long, PONumber long, Freight double")
    return purchases, prices, invoice, sales


@pytest.fixture(scope="module")
def summary(sources):
    return S.vendor_sales_summary(*sources)


def test_summary_rows(summary):
    assert [(f.name, f.dataType) for f in summary.schema] == \
        [(f.name, f.dataType) for f in schemas.VENDOR_SALES_SUMMARY]
    rows = sorted(summary.collect(), key=lambda r: (r.VendorNumber, r.Brand, r.TotalPurchaseQuantity))
    got = [(r.VendorNumber, r.VendorName, r.Brand, r.Volume, r.TotalPurchaseQuantity, r.TotalPurchaseDollars,
            r.TotalSalesQuantity, r.TotalSalesDollars, r.FreightCost, r.GrossProfit) for r in rows]
    assert got == [
        (1, "ACME", 10, 750.0, 1, 5.0, 12.0, 120.0, 15.0, 115.0),
        (1, "ACME", 10, 750.0, 15, 75.0, 12.0, 120.0, 15.0, 45.0),
        (2, "Bolt", 20, 0.0, 4, 32.0, 0.0, 0.0, 3.0, -32.0),
        (2, "Bolt", 21, 50.0, 0, 0.0, 0.0, 0.0, 3.0, 0.0),
        (3, None, 30, 750.0, 10, 10.0, 4.0, 8.0, 0.0, -2.0),
    ]
    ratios = [(r.ProfitMargin, r.StockTurnover, r.SalesToPurchaseRatio) for r in rows]
    assert abs(ratios[0][0] - 95.83333333333334) < 1e-9 and ratios[0][1:] == (12.0, 24.0)
    assert ratios[1] == (37.5, 0.8, 1.6)
    assert ratios[2] == (-math.inf, 0.0, 0.0)
    assert ratios[3] == (None, None, None)          # 0/0 is NULL, never NaN
    assert ratios[4] == (-25.0, 0.4, 0.8)


def test_consistency_filter_and_vendor_totals(summary):
    clean = S.consistent_rows(summary)
    assert clean.count() == 2
    totals = {r.VendorName: r.TotalSalesDollars for r in R.group_sum(clean, "VendorName", "TotalSalesDollars").collect()}
    assert totals == {"ACME": 240.0}


def test_null_key_dropped_by_pandas_style_groupby(summary):
    names = [r.VendorName for r in R.group_sum(summary, "VendorName", "TotalSalesDollars").collect()]
    assert None not in names and sorted(names) == ["ACME", "Bolt"]


def test_purchase_summary_rows(spark, sources):
    """Literal rows: the price list names brand 30 twice, so its one purchase
    counts twice; a price of 0 and a brand without a list row drop out."""
    got = sorted((tuple(r) for r in S.purchase_summary(sources[0], sources[1]).collect()), key=str)
    assert got == sorted([
        (1, " ACME ", 10, "Gin", 5.0, 9.0, "750", 15, 75.0),
        (1, "ACME", 10, "Gin", 5.0, 9.0, "750", 1, 5.0),
        (2, "Bolt\t", 20, "Rye", 8.0, 12.0, None, 4, 32.0),
        (2, "Bolt\t", 21, "Ale", 2.0, 3.0, " 50 ", 0, 0.0),
        (3, None, 30, "Mead", 1.0, 2.0, "750", 10, 10.0),
    ], key=str)
