"""The vendor x brand summary mart (freight, purchase and sales summaries,
their joins, and the cleaning step that adds the four ratios).

Plan shape: each source is aggregated before it is joined (partial/final
hash aggregation, so a hot vendor or brand collapses map-side before the
shuffle); purchases are pre-summed on their own five keys *before* the
brand-only price join, which fans rows out (several price rows per brand).
Summing after the fan-out equals fanning out the sums, and this way the
shuffle carries aggregated rows, never raw purchase lines. Equal price rows
are counted first, so the fanned-out sums need no second aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.functions.exact_sum import exact_sums
from vendorscope.functions.numeric import ieee_div
from vendorscope.functions.text import strip_ws

PURCHASE_KEYS = ["VendorNumber", "VendorName", "Brand", "Description", "PurchasePrice"]
SUMMARY_KEYS = PURCHASE_KEYS + ["ActualPrice", "Volume"]


def group_sums(df: DataFrame, keys: list[str], whole: dict[str, str], doubles: dict[str, str], exact: bool) -> DataFrame:
    """Sums per ``keys`` (name -> column): integers, then doubles. ``exact`` adds the
    doubles exactly (``exact_sums``), so the result does not depend on partitions;
    its partial sums are six longs a column, against one double."""
    if exact:
        return exact_sums(df, keys, doubles, whole)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in {**whole, **doubles}.items()])


def freight_summary(vendor_invoice: DataFrame, exact: bool = False) -> DataFrame:
    """A1: freight per vendor (SQL GROUP BY: a NULL vendor is its own group)."""
    return group_sums(vendor_invoice, ["VendorNumber"], {}, {"FreightCost": "Freight"}, exact)


def purchase_totals(purchases: DataFrame, exact: bool = False) -> DataFrame:
    """Purchases with a positive price, summed per purchase key."""
    return group_sums(purchases.filter(F.col("PurchasePrice") > 0), PURCHASE_KEYS,
                      {"Quantity": "Quantity"}, {"Dollars": "Dollars"}, exact)


def purchase_summary(purchases: DataFrame, purchase_prices: DataFrame, totals: DataFrame | None = None,
                     exact: bool = False) -> DataFrame:
    """A2: purchases with a positive price, joined to the price list on Brand
    alone (fan-out kept), summed per 7 keys. ``totals``: the purchases already
    summed per purchase key, one row a key (see ``purchase_totals``)."""
    pre = totals if totals is not None else purchase_totals(purchases, exact)
    return with_price_list(pre, purchase_prices).select(*SUMMARY_KEYS, "TotalPurchaseQuantity", "TotalPurchaseDollars")


def with_price_list(totals: DataFrame, purchase_prices: DataFrame) -> DataFrame:
    """``totals`` (one row per purchase key) joined to the distinct price rows of
    their brand. A price row counts as often as it stands in the list, which is
    what sums over the fanned-out rows come to, without adding them up again."""
    listed = (purchase_prices.groupBy("Brand", F.col("Price").alias("ActualPrice"), "Volume")
              .agg(F.count(F.lit(1)).alias("_times")))
    return (totals.join(listed, "Brand")
            .withColumn("TotalPurchaseQuantity", F.col("Quantity") * F.col("_times"))
            .withColumn("TotalPurchaseDollars", F.col("Dollars") * F.col("_times")))


def sales_summary(sales: DataFrame, exact: bool = False) -> DataFrame:
    """A3: sales per (vendor, brand)."""
    return group_sums(sales, ["VendorNo", "Brand"], {"TotalSalesQuantity": "SalesQuantity"},
                      {"TotalSalesDollars": "SalesDollars", "TotalSalesPrice": "SalesPrice", "TotalExciseTax": "ExciseTax"},
                      exact)


def vendor_summary_raw(purchases: DataFrame, purchase_prices: DataFrame, vendor_invoice: DataFrame,
                       sales: DataFrame, sort: bool = False, totals: DataFrame | None = None,
                       exact: bool = False, freight: DataFrame | None = None) -> DataFrame:
    """A4: purchase summary LEFT JOIN sales summary on (vendor, brand) LEFT
    JOIN freight on vendor: the 14 raw columns. ``sort`` adds the reference's
    ORDER BY TotalPurchaseDollars DESC (a full range-partitioned sort; stored
    tables do not need it); ``exact`` takes sums that do not depend on partitions.
    ``freight``: the freight summary, where it is stored already (its size then
    lets the planner join it without shuffling the wide rows by vendor)."""
    # the price list joins last: its fan-out and columns are not shuffled with the sums
    ps = totals if totals is not None else purchase_totals(purchases, exact)
    ss = sales_summary(sales, exact).withColumnRenamed("Brand", "_ss_brand")
    fs = freight if freight is not None else freight_summary(vendor_invoice, exact)
    fs = fs.withColumnRenamed("VendorNumber", "_fs_vendor")
    sold = ps.join(ss, (ps.VendorNumber == ss.VendorNo) & (ps.Brand == ss._ss_brand), "left")
    out = (with_price_list(sold, purchase_prices)
             .join(fs, F.col("VendorNumber") == fs._fs_vendor, "left")
             .select(*SUMMARY_KEYS, "TotalPurchaseQuantity", "TotalPurchaseDollars",
                     # unmatched purchases leave the integer sum NULL: a float column,
                     # as in the original frame
                     F.col("TotalSalesQuantity").cast("double").alias("TotalSalesQuantity"),
                     "TotalSalesDollars", "TotalSalesPrice",
                     "TotalExciseTax", "FreightCost"))
    return out.orderBy(F.col("TotalPurchaseDollars").desc()) if sort else out


def clean_summary_columns(raw: DataFrame, lenient_volume: bool = False) -> DataFrame:
    """Cast Volume, fill missing numbers with 0 (before the ratios),
    strip names, then GrossProfit, ProfitMargin, StockTurnover and
    SalesToPurchaseRatio with IEEE division (x/0 = +-inf, 0/0 = NULL).

    ``lenient_volume`` turns unparsable Volume text into NULL (then 0)
    instead of failing the job, as a strict cast does.
    """
    volume = (F.col("Volume").try_cast("double") if lenient_volume
              else F.col("Volume").cast("double"))
    df = raw.select(
        "VendorNumber", "VendorName", "Brand", "Description", "PurchasePrice", "ActualPrice",
        volume.alias("Volume"), "TotalPurchaseQuantity", "TotalPurchaseDollars",
        F.col("TotalSalesQuantity").cast("double").alias("TotalSalesQuantity"),
        "TotalSalesDollars", "TotalSalesPrice", "TotalExciseTax", "FreightCost",
    )
    df = df.fillna(0)
    df = (df.withColumn("VendorName", strip_ws("VendorName"))
            .withColumn("Description", strip_ws("Description")))
    return df.select(
        "*",
        (F.col("TotalSalesDollars") - F.col("TotalPurchaseDollars")).alias("GrossProfit"),
        (ieee_div(F.col("TotalSalesDollars") - F.col("TotalPurchaseDollars"),
                  F.col("TotalSalesDollars")) * 100).alias("ProfitMargin"),
        ieee_div("TotalSalesQuantity", "TotalPurchaseQuantity").alias("StockTurnover"),
        ieee_div("TotalSalesDollars", "TotalPurchaseDollars").alias("SalesToPurchaseRatio"),
    )


def vendor_sales_summary(purchases: DataFrame, purchase_prices: DataFrame,
                         vendor_invoice: DataFrame, sales: DataFrame,
                         lenient_volume: bool = False, totals: DataFrame | None = None,
                         exact: bool = False) -> DataFrame:
    """B1 without the write: the 18-column cleaned mart."""
    raw = vendor_summary_raw(purchases, purchase_prices, vendor_invoice, sales, totals=totals, exact=exact)
    return clean_summary_columns(raw, lenient_volume)


def purchase_summary_loose(purchases: DataFrame, purchase_prices: DataFrame,
                           totals: DataFrame | None = None) -> DataFrame:
    """The exploratory 3-key purchase summary. Its three ungrouped columns
    (PurchasePrice, Volume, ActualPrice) come from an arbitrary row in the
    original engine; here deterministically the minimum. Sorted ascending.
    Sums and minima are taken before and after the price join alike."""
    pre = totals if totals is not None else purchase_totals(purchases)
    prices = purchase_prices.select("Brand", F.col("Price").alias("ActualPrice"), "Volume")
    return (pre.join(prices, "Brand")
            .groupBy("VendorNumber", "VendorName", "Brand")
            .agg(F.min("PurchasePrice").alias("PurchasePrice"),
                 F.min("Volume").alias("Volume"),
                 F.min("ActualPrice").alias("ActualPrice"),
                 F.sum("Quantity").alias("TotalPurchaseQuantity"),
                 F.sum("Dollars").alias("TotalPurchaseDollars"))
            .orderBy(F.col("TotalPurchaseDollars").asc_nulls_first()))


def sales_summary_sorted(sales: DataFrame) -> DataFrame:
    """A3 + O2: the sales summary ordered by sales dollars ascending."""
    return sales_summary(sales).orderBy(F.col("TotalSalesDollars").asc_nulls_first())


def consistent_rows(summary: DataFrame) -> DataFrame:
    """the rows every later analysis uses (profit, margin and sales
    quantity all positive; NULL ratios fail the test and drop out)."""
    return summary.filter((F.col("GrossProfit") > 0) & (F.col("ProfitMargin") > 0)
                          & (F.col("TotalSalesQuantity") > 0))
