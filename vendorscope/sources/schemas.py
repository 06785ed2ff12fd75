"""Explicit schemas for the four source extracts and the derived tables.

Money is ``double`` (the runtime type of the original tables; the declared
DECIMALs never applied). ``Volume`` arrives as text and is cast on cleaning.
"""

from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField,
                               StructType)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


L, D, S = LongType(), DoubleType(), StringType()

PURCHASES = _schema(
    ("VendorNumber", L), ("VendorName", S), ("Brand", L), ("Description", S),
    ("PurchasePrice", D), ("Quantity", L), ("Dollars", D), ("PONumber", L), ("PODate", DateType()),
)

PURCHASE_PRICES = _schema(
    ("VendorNumber", L), ("Brand", L), ("Description", S), ("Price", D), ("Volume", S),
    ("PurchasePrice", D),
)

VENDOR_INVOICE = _schema(
    ("VendorNumber", L), ("PONumber", L), ("Quantity", L), ("Dollars", D), ("Freight", D),
)

SALES = _schema(
    ("VendorNo", L), ("Brand", L), ("SalesQuantity", L), ("SalesDollars", D), ("SalesPrice", D),
    ("ExciseTax", D),
)

SOURCE_SCHEMAS = {
    "purchases": PURCHASES,
    "purchase_prices": PURCHASE_PRICES,
    "vendor_invoice": VENDOR_INVOICE,
    "sales": SALES,
}

# the 14 columns of the joined summary before cleaning
SUMMARY_RAW = _schema(
    ("VendorNumber", L), ("VendorName", S), ("Brand", L), ("Description", S),
    ("PurchasePrice", D), ("ActualPrice", D), ("Volume", S),
    ("TotalPurchaseQuantity", L), ("TotalPurchaseDollars", D),
    ("TotalSalesQuantity", D), ("TotalSalesDollars", D), ("TotalSalesPrice", D),
    ("TotalExciseTax", D), ("FreightCost", D),
)

# ``vendor_sales_summary``: 18 columns after cleaning. TotalSalesQuantity is a
# double because the left join gives the integer column NULLs before 0-filling.
VENDOR_SALES_SUMMARY = _schema(
    ("VendorNumber", L), ("VendorName", S), ("Brand", L), ("Description", S),
    ("PurchasePrice", D), ("ActualPrice", D), ("Volume", D),
    ("TotalPurchaseQuantity", L), ("TotalPurchaseDollars", D),
    ("TotalSalesQuantity", D), ("TotalSalesDollars", D), ("TotalSalesPrice", D),
    ("TotalExciseTax", D), ("FreightCost", D),
    ("GrossProfit", D), ("ProfitMargin", D), ("StockTurnover", D), ("SalesToPurchaseRatio", D),
)

# the exported analysis frame: the summary plus three derived columns
FINAL_EXPORT = StructType(VENDOR_SALES_SUMMARY.fields + [
    StructField("UnitPurchasePrice", D, True),
    StructField("OrderSize", S, True),
    StructField("UnsoldInventoryValue", D, True),
])


def ddl(schema: StructType) -> str:
    """``CREATE TABLE`` column list for a schema (the declared target table)."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields)
