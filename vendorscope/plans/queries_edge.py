"""Registered queries over extracts with the cases that the plain views lack:
several price rows for a brand (equal and different ones), vendors without
invoices, two purchase prices of one (vendor, brand), and brands whose totals
are thousands or less. Whole tables, the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendorscope.functions.text import dollar_label
from vendorscope.operators import quality as QL
from vendorscope.operators import rankings as R
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import CLEAN, SUMMARY, VIEWS, dollar_label_sql
from vendorscope.plans.queries_analysis import THRESH
from vendorscope.plans.queries_explore import _uniq_sql
from vendorscope.plans.queries_mart import SUMMARY_DOUBLES
from vendorscope.plans.registry import register

EDGE_VIEWS = """
edge_scale AS (SELECT Brand, CASE Brand % 11 WHEN 0 THEN 0.00001 WHEN 1 THEN 0.001 ELSE 1.0 END AS factor
               FROM purchase_prices),
edge_prices AS (
  SELECT VendorNumber, Brand, Price, Volume FROM purchase_prices
  UNION ALL SELECT VendorNumber + 1, Brand, Price + 1, Volume FROM purchase_prices WHERE Brand % 7 = 0
  UNION ALL SELECT VendorNumber + 2, Brand, Price, Volume FROM purchase_prices WHERE Brand % 3 = 0
),
edge_invoice AS (SELECT * FROM vendor_invoice WHERE VendorNumber % 5 <> 0)"""

# Purchases per key from one pass over the lines; a list row counts as often as it stands
# in the list; sales and freight are looked up per result row.
EDGE_SUMMARY = """
edge_bought AS (
  SELECT VendorNumber, VendorName, Brand, Description, cost, CAST(sum(Quantity) AS BIGINT) AS units, sum(spent) AS amount
  FROM (SELECT p.*, Dollars * factor AS spent,
               PurchasePrice / CASE WHEN p.Brand % 13 = 0 AND PONumber % 2 = 0 THEN 2 ELSE 1 END AS cost
        FROM purchases p JOIN edge_scale e ON e.Brand = p.Brand) AS t
  WHERE cost > 0 GROUP BY VendorNumber, VendorName, Brand, Description, cost
),
edge_list AS (SELECT Brand, Price, Volume, count(*) AS times FROM edge_prices GROUP BY Brand, Price, Volume),
edge_sold AS (
  SELECT supp, pair.brand AS brand, CAST(sold_units AS DOUBLE) AS u, sold_amount * factor AS a, sold_prices AS p, sold_tax AS t
  FROM pair JOIN edge_scale e ON e.Brand = pair.brand WHERE sales > 0
),
summary_raw AS (
  SELECT VendorNumber, VendorName, b.Brand, Description, cost AS PurchasePrice, Price AS ActualPrice, Volume,
         CAST(units * times AS BIGINT) AS TotalPurchaseQuantity, amount * times AS TotalPurchaseDollars,
         (SELECT u FROM edge_sold s WHERE s.supp = VendorNumber AND s.brand = b.Brand) AS TotalSalesQuantity,
         (SELECT a FROM edge_sold s WHERE s.supp = VendorNumber AND s.brand = b.Brand) AS TotalSalesDollars,
         (SELECT p FROM edge_sold s WHERE s.supp = VendorNumber AND s.brand = b.Brand) AS TotalSalesPrice,
         (SELECT t FROM edge_sold s WHERE s.supp = VendorNumber AND s.brand = b.Brand) AS TotalExciseTax,
         (SELECT sum(Freight) FROM edge_invoice i WHERE i.VendorNumber = b.VendorNumber) AS FreightCost
  FROM edge_bought b JOIN edge_list l ON l.Brand = b.Brand
)"""


def edge_sql(body: str, *ctes: str) -> str:
    lines = SUMMARY[:SUMMARY.index("freight_per_vendor AS")].rstrip().rstrip(",")
    return "WITH " + ",".join([VIEWS, lines, EDGE_VIEWS, EDGE_SUMMARY, CLEAN, *ctes]) + "\n" + body


@register("edge_summary", edge_sql("SELECT * FROM vss"), doubles=SUMMARY_DOUBLES)
def edge_summary(ctx: VendorContext):
    return ctx.edge.summary


@register("edge_brand_scatter", edge_sql("""
SELECT 'All brands' AS Layer, Description, TotalSalesDollars, ProfitMargin FROM bp WHERE TotalSalesDollars < 10000
UNION ALL
SELECT 'Target brands', bp.Description, bp.TotalSalesDollars, bp.ProfitMargin FROM bp, th
WHERE bp.TotalSalesDollars <= th.LowSalesThreshold AND bp.ProfitMargin >= th.HighMarginThreshold""", THRESH),
          doubles=("TotalSalesDollars", "ProfitMargin"))
def edge_brand_scatter(ctx: VendorContext):
    return R.brand_scatter(ctx.edge.clean, brands=ctx.edge.brands)


@register("edge_brand_labels", edge_sql(f"""
SELECT Description, {dollar_label_sql('whole')} AS SalesLabel
FROM (SELECT Description, floor(sum(TotalSalesDollars) + 0.005) AS whole FROM clean
      WHERE Description IS NOT NULL GROUP BY Description) AS g"""))
def edge_brand_labels(ctx: VendorContext):
    totals = R.group_sum(ctx.edge.clean, "Description", "TotalSalesDollars")
    # whole dollars: the last digits of a sum depend on its order
    whole = F.floor(F.col("TotalSalesDollars") + 0.005).cast("double")
    return totals.select("Description", dollar_label(whole).alias("SalesLabel"))


@register("edge_key_uniqueness", edge_sql(" UNION ALL ".join([
    _uniq_sql("purchase_prices", "edge_prices", "VendorNumber,Brand"),
    _uniq_sql("purchase_prices_by_brand", "edge_prices", "Brand"),
    _uniq_sql("vendor_sales_summary", "vss", "VendorNumber,Brand")])))
def edge_key_uniqueness(ctx: VendorContext):
    e = ctx.edge
    return QL.key_uniqueness({
        "purchase_prices": (e.sources.purchase_prices, ["VendorNumber", "Brand"]),
        "purchase_prices_by_brand": (e.sources.purchase_prices, ["Brand"]),
        "vendor_sales_summary": (e.summary, ["VendorNumber", "Brand"])})
