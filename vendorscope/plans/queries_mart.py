"""Registered queries for the mart build (B1) and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendorscope.operators import summary as S
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import with_views
from vendorscope.plans.registry import register

SUMMARY_DOUBLES = ("PurchasePrice", "ActualPrice", "Volume", "TotalPurchaseDollars",
                   "TotalSalesQuantity", "TotalSalesDollars", "TotalSalesPrice", "TotalExciseTax",
                   "FreightCost", "GrossProfit", "ProfitMargin", "StockTurnover",
                   "SalesToPurchaseRatio")


@register("freight_by_vendor", with_views("SELECT * FROM freight_per_vendor", clean=False),
          doubles=("FreightCost",))
def freight_by_vendor(ctx: VendorContext):
    return S.freight_summary(ctx.sources.vendor_invoice)


@register("purchase_summary", with_views("""
SELECT VendorNumber, VendorName, Brand, Description, PurchasePrice, ActualPrice, Volume,
       TotalPurchaseQuantity, TotalPurchaseDollars FROM summary_raw""", clean=False),
          doubles=("PurchasePrice", "ActualPrice", "TotalPurchaseDollars"))
def purchase_summary(ctx: VendorContext):
    s = ctx.sources
    return S.purchase_summary(s.purchases, s.purchase_prices, s.purchase_totals)


@register("sales_summary",
          with_views("""
SELECT supp AS VendorNo, brand AS Brand, sold_units AS TotalSalesQuantity, sold_amount AS TotalSalesDollars,
       sold_prices AS TotalSalesPrice, sold_tax AS TotalExciseTax FROM pair WHERE sales > 0""", clean=False),
          doubles=("TotalSalesDollars", "TotalSalesPrice", "TotalExciseTax"))
def sales_summary(ctx: VendorContext):
    return S.sales_summary_sorted(ctx.sources.sales)


@register("purchase_summary_loose", with_views("""
SELECT VendorNumber, VendorName, Brand, PurchasePrice, Volume, ActualPrice,
       TotalPurchaseQuantity, TotalPurchaseDollars FROM summary_raw""", clean=False),
          doubles=("PurchasePrice", "ActualPrice", "TotalPurchaseDollars"))
def purchase_summary_loose(ctx: VendorContext):
    s = ctx.sources
    return S.purchase_summary_loose(s.purchases, s.purchase_prices, s.purchase_totals)


@register("vendor_summary_raw",
          with_views("SELECT * FROM summary_raw ORDER BY TotalPurchaseDollars DESC", clean=False),
          doubles=("PurchasePrice", "ActualPrice", "TotalPurchaseDollars", "TotalSalesQuantity",
                   "TotalSalesDollars", "TotalSalesPrice", "TotalExciseTax", "FreightCost"))
def vendor_summary_raw(ctx: VendorContext):
    return ctx.summary_raw.orderBy(F.col("TotalPurchaseDollars").desc())


@register("vendor_summary", with_views("SELECT * FROM vss"), doubles=SUMMARY_DOUBLES)
def vendor_summary(ctx: VendorContext):
    return ctx.summary


@register("clean_summary", with_views("SELECT * FROM clean"), doubles=SUMMARY_DOUBLES)
def clean_summary(ctx: VendorContext):
    return ctx.clean
