"""Registered queries for source exploration (B12) and data quality (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vendorscope.operators import explore as X
from vendorscope.operators import quality as QL
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import with_views
from vendorscope.plans.registry import register
from vendorscope.sources.schemas import SUMMARY_RAW

VIEW_COLUMNS = {"purchases": 9, "purchase_prices": 6, "vendor_invoice": 5, "sales": 6}


@register("table_profile", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS BIGINT) AS column_count FROM {t}"
    for t, n in VIEW_COLUMNS.items()), summary=False, clean=False))
def table_profile(ctx: VendorContext):
    return X.table_profile(ctx.sources.as_dict())


PREVIEW_ORDER = {
    "purchases": "VendorNumber, Brand, PONumber, Quantity, Dollars, PODate", "purchase_prices": "Brand",
    "vendor_invoice": "VendorNumber, PONumber", "sales": "VendorNo, Brand, SalesQuantity, SalesDollars, ExciseTax"}
PREVIEW_TEXT = {
    "purchases": ("VendorNumber", "Brand", "PONumber", "Quantity"), "purchase_prices": ("Brand", "VendorNumber", "Volume"),
    "vendor_invoice": ("VendorNumber", "PONumber", "Quantity"), "sales": ("VendorNo", "Brand", "SalesQuantity")}


def _preview_sql() -> str:
    parts = []
    for t, order in PREVIEW_ORDER.items():
        shown = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in PREVIEW_TEXT[t])
        parts.append(f"SELECT '{t}' AS table_name, row_number() OVER (ORDER BY {order}) AS position, {shown} AS shown "
                     f"FROM (SELECT * FROM {t} ORDER BY {order} LIMIT 5)")
    return with_views("\nUNION ALL ".join(parts), summary=False, clean=False)


@register("table_preview", _preview_sql())
def table_preview(ctx: VendorContext):
    out = None
    for t, order in PREVIEW_ORDER.items():
        keys = order.split(", ")
        rows = X.preview(ctx.sources.as_dict()[t], 5, order_by=keys)
        w = Window.orderBy(*keys)                     # over the five rows of the preview
        shown = F.concat_ws("|", *[F.col(c).cast("string") for c in PREVIEW_TEXT[t]])
        part = rows.select(F.lit(t).alias("table_name"), F.row_number().over(w).cast("long").alias("position"),
                           shown.alias("shown"))
        out = part if out is None else out.unionByName(part)
    return out


BUSIEST = """
busiest AS (SELECT VendorNumber FROM purchases
            WHERE VendorNumber IS NOT NULL AND VendorNumber IN (SELECT VendorNumber FROM purchase_prices)
            GROUP BY VendorNumber ORDER BY count(*) DESC, VendorNumber LIMIT 1)"""


def _vendor_sql(table: str, col: str, columns: str) -> str:
    return with_views(f"SELECT {columns} FROM {table} WHERE {col} = (SELECT VendorNumber FROM busiest)",
                      BUSIEST, summary=False, clean=False)


def _vendor_rows(ctx: VendorContext, table: str):
    df = ctx.sources.as_dict()[table]
    rows = X.vendor_rows(df, table, X.most_active_vendor(ctx.sources.purchases,
                                                         ctx.sources.purchase_prices))
    if "PODate" in rows.columns:      # dates compared as ISO text
        rows = rows.withColumn("PODate", F.col("PODate").cast("string"))
    return rows


@register("vendor_purchases", _vendor_sql(
    "purchases", "VendorNumber",
    "VendorNumber, VendorName, Brand, Description, PurchasePrice, Quantity, Dollars, PONumber, "
    "CAST(PODate AS VARCHAR) AS PODate"), doubles=("PurchasePrice", "Dollars"))
def vendor_purchases(ctx: VendorContext):
    return _vendor_rows(ctx, "purchases")


@register("vendor_prices", _vendor_sql("purchase_prices", "VendorNumber", "*"),
          doubles=("Price", "PurchasePrice"))
def vendor_prices(ctx: VendorContext):
    return _vendor_rows(ctx, "purchase_prices")


@register("vendor_invoices", _vendor_sql("vendor_invoice", "VendorNumber", "*"),
          doubles=("Dollars", "Freight"))
def vendor_invoices(ctx: VendorContext):
    return _vendor_rows(ctx, "vendor_invoice")


@register("vendor_sales", _vendor_sql("sales", "VendorNo", "*"),
          doubles=("SalesDollars", "SalesPrice", "ExciseTax"))
def vendor_sales(ctx: VendorContext):
    return _vendor_rows(ctx, "sales")


@register("purchases_by_brand_price", with_views("""
SELECT VendorNumber, Brand, PurchasePrice, CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS Quantity,
       coalesce(sum(Dollars), 0) AS Dollars
FROM purchases WHERE VendorNumber IS NOT NULL AND Brand IS NOT NULL AND PurchasePrice IS NOT NULL
GROUP BY VendorNumber, Brand, PurchasePrice""", summary=False, clean=False),
          doubles=("PurchasePrice", "Dollars"))
def purchases_by_brand_price(ctx: VendorContext):
    return X.purchases_by_brand_price(ctx.sources.purchases)


@register("sales_by_brand", with_views("""
SELECT VendorNo, Brand, coalesce(sum(SalesDollars), 0) AS SalesDollars,
       coalesce(sum(SalesPrice), 0) AS SalesPrice,
       CAST(coalesce(sum(SalesQuantity), 0) AS BIGINT) AS SalesQuantity
FROM sales WHERE VendorNo IS NOT NULL AND Brand IS NOT NULL GROUP BY VendorNo, Brand""",
                                       summary=False, clean=False),
          doubles=("SalesDollars", "SalesPrice"))
def sales_by_brand(ctx: VendorContext):
    return X.sales_by_brand(ctx.sources.sales)


@register("distinct_po", with_views("""
SELECT VendorNumber, count(DISTINCT PONumber) AS DistinctPOs FROM vendor_invoice
WHERE VendorNumber IS NOT NULL GROUP BY VendorNumber""", summary=False, clean=False))
def distinct_po(ctx: VendorContext):
    return X.distinct_po(ctx.sources.vendor_invoice)


def _null_profile_sql() -> str:
    parts = []
    for i, f in enumerate(SUMMARY_RAW.fields):
        nan = f" OR isnan({f.name})" if f.dataType.typeName() == "double" else ""
        parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{f.name}' AS column_name, "
                     f"'{f.dataType.simpleString()}' AS data_type, "
                     f"count(*) FILTER (WHERE {f.name} IS NULL{nan}) AS null_count FROM summary_raw")
    return with_views("\nUNION ALL ".join(parts), clean=False)


@register("null_profile", _null_profile_sql())
def null_profile(ctx: VendorContext):
    return X.null_profile(ctx.summary_raw)


@register("distinct_vendors", with_views("SELECT DISTINCT VendorName FROM summary_raw", clean=False))
def distinct_vendors(ctx: VendorContext):
    return X.distinct_values(ctx.summary_raw, "VendorName")


@register("distinct_descriptions", with_views("SELECT DISTINCT Description FROM summary_raw", clean=False))
def distinct_descriptions(ctx: VendorContext):
    return X.distinct_values(ctx.summary_raw, "Description")


@register("min_gross_profit", with_views("SELECT min(GrossProfit) AS min_GrossProfit FROM vss"),
          doubles=("min_GrossProfit",))
def min_gross_profit(ctx: VendorContext):
    return X.column_min(ctx.summary, "GrossProfit")


@register("anomaly_profile", with_views("""
SELECT count(*) AS rows,
       count(*) FILTER (WHERE GrossProfit < 0) AS negative_profit_rows,
       count(*) FILTER (WHERE ProfitMargin = CAST('-inf' AS DOUBLE)) AS neg_inf_margin_rows,
       count(*) FILTER (WHERE TotalSalesQuantity = 0) AS zero_sales_qty_rows,
       count(*) FILTER (WHERE TotalSalesDollars = 0) AS zero_sales_dollar_rows,
       count(*) FILTER (WHERE StockTurnover > 1) AS turnover_above_1_rows,
       min(GrossProfit) AS min_gross_profit, min(ProfitMargin) AS min_profit_margin,
       max(PurchasePrice) AS max_purchase_price, avg(PurchasePrice) AS mean_purchase_price,
       max(ActualPrice) AS max_actual_price, avg(ActualPrice) AS mean_actual_price,
       min(FreightCost) AS min_freight, max(FreightCost) AS max_freight,
       min(StockTurnover) AS min_turnover, max(StockTurnover) AS max_turnover
FROM vss"""), doubles=("min_gross_profit", "min_profit_margin", "max_purchase_price",
                        "mean_purchase_price", "max_actual_price", "mean_actual_price",
                        "min_freight", "max_freight", "min_turnover", "max_turnover"))
def anomaly_profile(ctx: VendorContext):
    return QL.anomaly_profile(ctx.summary)


def _uniq_sql(name: str, table: str, keys: str) -> str:
    return f"""
SELECT '{name}' AS table_name, '{keys}' AS key_columns, CAST(coalesce(sum(c), 0) AS BIGINT) AS rows,
       count(*) AS distinct_keys, count(*) FILTER (WHERE c > 1) AS duplicate_keys,
       CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS rows_in_duplicates
FROM (SELECT count(*) AS c FROM {table} GROUP BY {keys}) AS k"""


@register("key_uniqueness", with_views(" UNION ALL ".join([
    _uniq_sql("purchase_prices", "purchase_prices", "VendorNumber,Brand"),
    _uniq_sql("vendor_invoice", "vendor_invoice", "VendorNumber,PONumber"),
    _uniq_sql("vendor_sales_summary", "vss", "VendorNumber,Brand")])))
def key_uniqueness(ctx: VendorContext):
    s = ctx.sources
    return QL.key_uniqueness({
        "purchase_prices": (s.purchase_prices, ["VendorNumber", "Brand"]),
        "vendor_invoice": (s.vendor_invoice, ["VendorNumber", "PONumber"]),
        "vendor_sales_summary": (ctx.summary, ["VendorNumber", "Brand"]),
    })
