"""Source exploration (B12): table profile, one vendor's rows across the four
extracts, per-brand rollups, distinct PO count, null profile, distinct
values, a global minimum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# the vendor column of each extract (sales names it differently)
VENDOR_COLUMN = {"purchases": "VendorNumber", "purchase_prices": "VendorNumber",
                 "vendor_invoice": "VendorNumber", "sales": "VendorNo"}


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """S5 + S6 + A9: one row per table: name, row count, column count (one
    count job per table, unioned). Previews are ``preview()``."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"))
        out = row if out is None else out.unionByName(row)
    return out


def catalog_profile(spark, database: str | None = None) -> DataFrame:
    """S5 + S6: list the catalog's tables (``spark.catalog.listTables``, the
    metadata query) and profile each one."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    names = [t.name if not database else f"{database}.{t.name}" for t in tables if not t.isTemporary]
    return table_profile({n: spark.table(n) for n in names})


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """O3: ``n`` rows: any (``LIMIT n``), or the first in the given order (a
    per-partition top n, then a merge)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def most_active_vendor(purchases: DataFrame, price_list: DataFrame | None = None) -> Column:
    """The vendor with the most purchase lines (ties: smallest number), among
    vendors that also appear in ``price_list`` when given (a semi join), as a
    scalar subquery: a data-derived stand-in for a hand-picked vendor id."""
    p = purchases.filter(F.col("VendorNumber").isNotNull())
    if price_list is not None:
        p = p.join(price_list.select("VendorNumber"), "VendorNumber", "left_semi")
    busiest = (p.groupBy("VendorNumber").agg(F.count(F.lit(1)).alias("lines"))
               .orderBy(F.col("lines").desc(), F.col("VendorNumber")).limit(1))
    return busiest.select("VendorNumber").scalar()


def vendor_rows(table: DataFrame, table_name: str, vendor) -> DataFrame:
    """one vendor's rows of an extract (``vendor`` a literal or column)."""
    v = vendor if isinstance(vendor, Column) else F.lit(vendor)
    return table.filter(F.col(VENDOR_COLUMN[table_name]) == v)


def purchases_by_brand_price(purchases: DataFrame, by_vendor: bool = True) -> DataFrame:
    """A5: purchased quantity and dollars per (brand, purchase price), per
    vendor unless ``by_vendor`` is False (pandas drops NULL keys)."""
    keys = (["VendorNumber"] if by_vendor else []) + ["Brand", "PurchasePrice"]
    return (purchases.dropna(subset=keys).groupBy(*keys)
            .agg(F.coalesce(F.sum("Quantity"), F.lit(0)).alias("Quantity"),
                 F.coalesce(F.sum("Dollars"), F.lit(0.0)).alias("Dollars")))


def sales_by_brand(sales: DataFrame, by_vendor: bool = True) -> DataFrame:
    """Sales dollars, summed sales price and quantity per brand."""
    keys = (["VendorNo"] if by_vendor else []) + ["Brand"]
    return (sales.dropna(subset=keys).groupBy(*keys)
            .agg(F.coalesce(F.sum("SalesDollars"), F.lit(0.0)).alias("SalesDollars"),
                 F.coalesce(F.sum("SalesPrice"), F.lit(0.0)).alias("SalesPrice"),
                 F.coalesce(F.sum("SalesQuantity"), F.lit(0)).alias("SalesQuantity")))


def distinct_po(vendor_invoice: DataFrame, by_vendor: bool = True) -> DataFrame:
    """Number of distinct PO numbers (NULL not counted), per vendor.
    Exact ``count(DISTINCT)`` (Spark plans it as a two-level aggregate,
    distinct keys shuffled once); ``approx_count_distinct`` is the cheap
    alternative when an estimate will do."""
    if by_vendor:
        return (vendor_invoice.filter(F.col("VendorNumber").isNotNull()).groupBy("VendorNumber")
                .agg(F.count_distinct("PONumber").alias("DistinctPOs")))
    return vendor_invoice.agg(F.count_distinct("PONumber").alias("DistinctPOs"))


def null_profile(df: DataFrame) -> DataFrame:
    """A10 + Q1 + P17: per column its type and number of NULLs (NaN counts
    as missing in floating columns), in one aggregate pass."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        missing = c.isNull()
        if f.dataType.typeName() in ("double", "float"):
            missing = missing | F.isnan(c)
        aggs.append(F.count_if(missing).alias(f"n{len(aggs)}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(f.dataType.simpleString()).alias("data_type"),
                              F.col(f"n{i}").alias("null_count"))
                     for i, f in enumerate(df.schema.fields)])
    return one.select(F.inline(rows))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column (NULL is one value)."""
    return df.select(column).distinct()


def column_min(df: DataFrame, column: str) -> DataFrame:
    """The global minimum of a column."""
    return df.agg(F.min(column).alias(f"min_{column}"))


def vendor_purchase_summary(purchases: DataFrame) -> DataFrame:
    """A5 as the original runs it: one vendor (the busiest), by brand and price."""
    one = vendor_rows(purchases, "purchases", most_active_vendor(purchases))
    return purchases_by_brand_price(one, by_vendor=False)


__all__ = ["table_profile", "catalog_profile", "preview", "most_active_vendor", "vendor_rows",
           "purchases_by_brand_price", "sales_by_brand", "distinct_po", "null_profile",
           "distinct_values", "column_min", "vendor_purchase_summary"]
