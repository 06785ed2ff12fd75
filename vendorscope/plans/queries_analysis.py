"""Registered queries for the business questions B2-B8 and B13."""

from __future__ import annotations

from vendorscope.operators import inventory as I
from vendorscope.operators import rankings as R
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import dollar_label_sql, np_quantiles, with_views
from vendorscope.plans.queries_mart import SUMMARY_DOUBLES
from vendorscope.plans.registry import register

# ------------------------------------------------------------------ B2 -----

BP = """
bp AS MATERIALIZED (
  SELECT Description, coalesce(sum(TotalSalesDollars), 0) AS TotalSalesDollars,
         avg(ProfitMargin) AS ProfitMargin
  FROM clean WHERE Description IS NOT NULL GROUP BY Description
),
bp_sales AS (SELECT TotalSalesDollars AS x FROM bp),
bp_margin AS (SELECT ProfitMargin AS x FROM bp)"""
THRESH = (BP + "," + np_quantiles("q_low", "bp_sales", [], [0.15])
          + "," + np_quantiles("q_high", "bp_margin", [], [0.85]) + """,
th AS (SELECT (SELECT value FROM q_low) AS LowSalesThreshold,
              (SELECT value FROM q_high) AS HighMarginThreshold)""")


@register("brand_performance", with_views("SELECT * FROM bp", BP),
          doubles=("TotalSalesDollars", "ProfitMargin"))
def brand_performance(ctx: VendorContext):
    return R.brand_performance(ctx.clean)


@register("brand_thresholds", with_views("SELECT * FROM th", THRESH),
          doubles=("LowSalesThreshold", "HighMarginThreshold"))
def brand_thresholds(ctx: VendorContext):
    return R.brand_thresholds(ctx.brands)


@register("target_brands", with_views("""
SELECT bp.Description, bp.TotalSalesDollars, bp.ProfitMargin FROM bp, th
WHERE bp.TotalSalesDollars <= th.LowSalesThreshold AND bp.ProfitMargin >= th.HighMarginThreshold
ORDER BY bp.TotalSalesDollars, bp.Description""", THRESH),
          doubles=("TotalSalesDollars", "ProfitMargin"))
def target_brands(ctx: VendorContext):
    return R.target_brands(ctx.clean, brands=ctx.brands)


@register("brand_scatter", with_views("""
SELECT 'All brands' AS Layer, Description, TotalSalesDollars, ProfitMargin FROM bp
WHERE TotalSalesDollars < 10000
UNION ALL
SELECT 'Target brands', bp.Description, bp.TotalSalesDollars, bp.ProfitMargin FROM bp, th
WHERE bp.TotalSalesDollars <= th.LowSalesThreshold AND bp.ProfitMargin >= th.HighMarginThreshold""",
                                      THRESH),
          doubles=("TotalSalesDollars", "ProfitMargin"))
def brand_scatter(ctx: VendorContext):
    return R.brand_scatter(ctx.clean, brands=ctx.brands)


# ------------------------------------------------------------------ B3 -----

def _top_sales_sql(key: str) -> str:
    return with_views(f"""
SELECT {key}, TotalSalesDollars, {dollar_label_sql('TotalSalesDollars')} AS SalesLabel
FROM (SELECT {key}, coalesce(sum(TotalSalesDollars), 0) AS TotalSalesDollars
      FROM clean WHERE {key} IS NOT NULL GROUP BY {key}) AS g
ORDER BY TotalSalesDollars DESC NULLS LAST, {key} LIMIT 10""")


@register("top_vendors_sales", _top_sales_sql("VendorName"), doubles=("TotalSalesDollars",))
def top_vendors_sales(ctx: VendorContext):
    return R.top_vendors_by_sales(ctx.clean)


@register("top_brands_sales", _top_sales_sql("Description"), doubles=("TotalSalesDollars",))
def top_brands_sales(ctx: VendorContext):
    return R.top_brands_by_sales(ctx.clean)


# ------------------------------------------------------------------ B4/B5 --

PARETO = """
vp AS (
  SELECT VendorName, coalesce(sum(TotalPurchaseDollars), 0) AS TotalPurchaseDollars,
         coalesce(sum(GrossProfit), 0) AS GrossProfit,
         coalesce(sum(TotalSalesDollars), 0) AS TotalSalesDollars
  FROM clean WHERE VendorName IS NOT NULL GROUP BY VendorName
),
vp_tot AS (SELECT sum(TotalPurchaseDollars) AS total FROM vp),
vp_share AS (
  SELECT vp.*, CASE WHEN vp_tot.total <> 0 THEN vp.TotalPurchaseDollars / vp_tot.total
                    WHEN vp.TotalPurchaseDollars > 0 THEN CAST('inf' AS DOUBLE)
                    WHEN vp.TotalPurchaseDollars < 0 THEN CAST('-inf' AS DOUBLE) END * 100 AS share
  FROM vp, vp_tot
),
vp_top AS (SELECT * FROM vp_share ORDER BY share DESC NULLS LAST, VendorName LIMIT 10),
pareto AS (
  SELECT CAST(row_number() OVER w AS BIGINT) AS Rank, VendorName,
         round_even(TotalPurchaseDollars, 2) AS TotalPurchaseDollars,
         round_even(GrossProfit, 2) AS GrossProfit,
         round_even(TotalSalesDollars, 2) AS TotalSalesDollars,
         round_even(share, 2) AS PurchaseContributionPct,
         sum(round_even(share, 2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS CumulativeContributionPct
  FROM vp_top WINDOW w AS (ORDER BY share DESC NULLS LAST, VendorName)
)"""


@register("vendor_pareto", with_views(f"""
SELECT Rank, VendorName, TotalPurchaseDollars, GrossProfit, TotalSalesDollars,
       PurchaseContributionPct, CumulativeContributionPct,
       {dollar_label_sql('TotalPurchaseDollars')} AS PurchaseDollarsLabel,
       {dollar_label_sql('GrossProfit')} AS GrossProfitLabel,
       {dollar_label_sql('TotalSalesDollars')} AS SalesDollarsLabel
FROM pareto""", PARETO),
          doubles=("TotalPurchaseDollars", "GrossProfit", "TotalSalesDollars",
                   "PurchaseContributionPct", "CumulativeContributionPct"))
def vendor_pareto(ctx: VendorContext):
    return R.vendor_pareto(ctx.clean)


@register("vendor_dependency", with_views("""
SELECT Rank, VendorName, PurchaseContributionPct FROM pareto
UNION ALL
SELECT CAST(11 AS BIGINT), 'Other Vendors', 100 - coalesce(sum(PurchaseContributionPct), 0) FROM pareto""", PARETO),
          doubles=("PurchaseContributionPct",))
def vendor_dependency(ctx: VendorContext):
    return R.vendor_dependency(ctx.clean)


@register("top_vendor_share", with_views(
    "SELECT coalesce(sum(PurchaseContributionPct), 0) AS TopVendorsPct FROM pareto", PARETO),
          doubles=("TopVendorsPct",))
def top_vendor_share(ctx: VendorContext):
    return R.top_vendor_share(ctx.clean)


# ------------------------------------------------------------------ B6 -----

QCUT = """
tpq AS (SELECT TotalPurchaseQuantity AS x FROM clean),""" + np_quantiles(
    "edges", "tpq", [], [0.0, 1.0 / 3.0, 2.0 * (1.0 / 3.0), 1.0]) + """,
e AS (SELECT max(CASE WHEN prob = 0.0 THEN value END) AS e0,
             max(CASE WHEN prob = 0.3333333333333333 THEN value END) AS e1,
             max(CASE WHEN prob = 0.6666666666666666 THEN value END) AS e2,
             max(CASE WHEN prob = 1.0 THEN value END) AS e3 FROM edges),
sized AS (
  SELECT clean.*,
         CASE WHEN TotalPurchaseQuantity IS NULL OR TotalPurchaseDollars IS NULL THEN NULL
              WHEN TotalPurchaseQuantity <> 0 THEN TotalPurchaseDollars / TotalPurchaseQuantity
              WHEN TotalPurchaseDollars > 0 THEN CAST('inf' AS DOUBLE)
              WHEN TotalPurchaseDollars < 0 THEN CAST('-inf' AS DOUBLE) END AS UnitPurchasePrice,
         CASE WHEN e0 = e1 OR e1 = e2 OR e2 = e3 THEN error('qcut: bin edges must be unique')
              WHEN TotalPurchaseQuantity <= e1 THEN 'Small'
              WHEN TotalPurchaseQuantity <= e2 THEN 'Medium'
              WHEN TotalPurchaseQuantity <= e3 THEN 'Large' END AS OrderSize
  FROM clean, e
)"""


@register("order_size", with_views("""
SELECT VendorNumber, VendorName, Brand, Description, TotalPurchaseQuantity, UnitPurchasePrice,
       OrderSize FROM sized""", QCUT), doubles=("UnitPurchasePrice",))
def order_size(ctx: VendorContext):
    return I.order_sizes(ctx.clean, ctx.analysis)


@register("unit_price_by_order_size", with_views("""
SELECT CAST(s.SizeRank AS BIGINT) AS SizeRank, s.OrderSize, avg(z.UnitPurchasePrice) AS UnitPurchasePrice,
       count(z.OrderSize) AS Rows
FROM (VALUES (1, 'Small'), (2, 'Medium'), (3, 'Large')) AS s(SizeRank, OrderSize)
LEFT JOIN sized z ON z.OrderSize = s.OrderSize
GROUP BY s.SizeRank, s.OrderSize""", QCUT), doubles=("UnitPurchasePrice",))
def unit_price_by_order_size(ctx: VendorContext):
    return I.unit_price_by_order_size(ctx.clean, ctx.analysis)


# ------------------------------------------------------------------ B7/B8 --

@register("slow_vendors", with_views("""
SELECT VendorName, avg(StockTurnover) AS StockTurnover FROM clean
WHERE StockTurnover < 1 AND VendorName IS NOT NULL GROUP BY VendorName
ORDER BY StockTurnover ASC NULLS LAST, VendorName LIMIT 10"""), doubles=("StockTurnover",))
def slow_vendors(ctx: VendorContext):
    return I.slow_vendors(ctx.clean)


UNSOLD = """
unsold AS (SELECT *, (TotalPurchaseQuantity - TotalSalesQuantity) * PurchasePrice
                   AS UnsoldInventoryValue FROM clean)"""


@register("unsold_total", with_views(f"""
SELECT v AS TotalUnsoldValue, {dollar_label_sql('round_even(v, 2)')} AS TotalUnsoldLabel
FROM (SELECT coalesce(sum(UnsoldInventoryValue), 0) AS v FROM unsold) AS t""", UNSOLD),
          doubles=("TotalUnsoldValue",))
def unsold_total(ctx: VendorContext):
    return I.unsold_total(ctx.clean)


@register("unsold_by_vendor", with_views(f"""
SELECT VendorName, UnsoldInventoryValue,
       {dollar_label_sql('round_even(UnsoldInventoryValue, 2)')} AS UnsoldLabel
FROM (SELECT VendorName, coalesce(sum(UnsoldInventoryValue), 0) AS UnsoldInventoryValue
      FROM unsold WHERE VendorName IS NOT NULL GROUP BY VendorName) AS g
ORDER BY UnsoldInventoryValue DESC NULLS LAST, VendorName LIMIT 10""", UNSOLD),
          doubles=("UnsoldInventoryValue",))
def unsold_by_vendor(ctx: VendorContext):
    return I.unsold_by_vendor(ctx.clean)


# ------------------------------------------------------------------ B13 ----

@register("final_export", with_views("""
SELECT *, (TotalPurchaseQuantity - TotalSalesQuantity) * PurchasePrice AS UnsoldInventoryValue
FROM sized""", QCUT), doubles=SUMMARY_DOUBLES + ("UnitPurchasePrice", "UnsoldInventoryValue"))
def final_export(ctx: VendorContext):
    return ctx.analysis

