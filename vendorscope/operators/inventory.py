"""Inventory questions: bulk-purchase effect (B6), slow movers (B7), capital
locked in unsold stock (B8), and the final exported frame (B13).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorscope.functions.exact_sum import exact_sums
from vendorscope.functions.numeric import ieee_div, round_half_even
from vendorscope.functions.quantile import quantile_values
from vendorscope.functions.text import dollar_label
from vendorscope.operators.rankings import group_sum, top_k

# Order-size labels, smallest first (an ordered category).
ORDER_SIZE_LABELS = ("Small", "Medium", "Large")


def unit_purchase_price() -> Column:
    """Purchase dollars per unit (x/0 = inf, 0/0 = NULL)."""
    return ieee_div("TotalPurchaseDollars", "TotalPurchaseQuantity")


def qcut(df: DataFrame, column: str, labels=ORDER_SIZE_LABELS) -> Column:
    """``pd.qcut(x, q=len(labels), labels)`` as a column expression.

    Edges are the exact linear quantiles at ``linspace(0, 1, q + 1)``; bins
    are right-closed and the first includes the minimum. Repeated edges raise,
    as pandas does. The edges are one scalar subquery (a q+1 element array).
    """
    q = len(labels)
    step = 1.0 / q
    probs = [0.0] + [k * step for k in range(1, q)] + [1.0]   # numpy linspace
    edges = quantile_values(df, column, probs)
    e = edges.select(F.array(*[F.col(f"q{i}") for i in range(q + 1)])).scalar()
    dup = F.lit(False)
    for i in range(q):
        dup = dup | (e[i] == e[i + 1])
    x = F.col(column).cast("double")
    out = F.when(dup, F.raise_error(F.lit("qcut: bin edges must be unique")).cast("string"))
    for i, label in enumerate(labels):
        out = out.when(x <= e[i + 1], F.lit(label))
    return out


def with_order_size(clean: DataFrame) -> DataFrame:
    """P11 + W3: UnitPurchasePrice and OrderSize on every clean row."""
    return clean.withColumns({
        "UnitPurchasePrice": unit_purchase_price(),
        "OrderSize": qcut(clean, "TotalPurchaseQuantity"),
    })


def order_sizes(clean: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """The order-size label next to each row's purchase quantity
    (``sized``: an already labelled frame, e.g. the stored analysis frame)."""
    return (sized if sized is not None else with_order_size(clean)).select("VendorNumber", "VendorName", "Brand", "Description",
                                         "TotalPurchaseQuantity", "UnitPurchasePrice", "OrderSize")


def unit_price_by_order_size(clean: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Mean unit price per order size, all three sizes in category order
    (an empty size keeps its row with a NULL mean, as pandas' categorical
    grouping does). One conditional aggregate, then three rows."""
    sized = sized if sized is not None else with_order_size(clean)
    aggs = []
    for label in ORDER_SIZE_LABELS:
        hit = F.col("OrderSize") == label
        aggs += [F.avg(F.when(hit, F.col("UnitPurchasePrice"))).alias(f"m_{label}"),
                 F.count(F.when(hit, F.lit(1))).alias(f"n_{label}")]
    one = sized.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("SizeRank"), F.lit(label).alias("OrderSize"),
                              F.col(f"m_{label}").alias("UnitPurchasePrice"),
                              F.col(f"n_{label}").alias("Rows"))
                     for i, label in enumerate(ORDER_SIZE_LABELS)])
    return one.select(F.inline(rows))


def slow_vendors(clean: DataFrame, k: int = 10, max_turnover: float = 1.0) -> DataFrame:
    """Vendors with the lowest mean stock turnover among rows under 1."""
    slow = (clean.filter((F.col("StockTurnover") < max_turnover) & F.col("VendorName").isNotNull())
                 .groupBy("VendorName").agg(F.avg("StockTurnover").alias("StockTurnover")))
    return top_k(slow, "StockTurnover", "VendorName", k, ascending=True)


def unsold_inventory_value() -> Column:
    """(purchased - sold) x purchase price; negative when more was sold."""
    return ((F.col("TotalPurchaseQuantity") - F.col("TotalSalesQuantity"))
            * F.col("PurchasePrice"))


def cents_label(c: str, exact: bool = False) -> Column:
    """Dollar label of the value rounded to cents. A negative total is printed
    with every digit (``str``), and the last digits of a floating-point sum
    depend on the summation order, which no parallel engine fixes; the label
    therefore uses the cent-rounded value (the number column stays exact).
    ``exact`` labels the sum as it is, as the original does; the functions below
    then take exact sums, so that label does not depend on partitions."""
    return dollar_label(F.col(c) if exact else round_half_even(F.col(c), 2))


def unsold_total(clean: DataFrame, exact_label: bool = False) -> DataFrame:
    """B8 headline: total unsold capital, with its dollar label."""
    value = unsold_inventory_value()
    one = exact_sums(clean, [], {"sum": value}) if exact_label else clean.agg(F.sum(value).alias("sum"))
    total = one.select(F.coalesce("sum", F.lit(0.0)).alias("TotalUnsoldValue"))
    return total.withColumn("TotalUnsoldLabel", cents_label("TotalUnsoldValue", exact_label))


def unsold_by_vendor(clean: DataFrame, k: int = 10, exact_label: bool = False) -> DataFrame:
    """Vendors with the most capital locked in unsold stock."""
    per = group_sum(clean.withColumn("UnsoldInventoryValue", unsold_inventory_value()),
                    "VendorName", "UnsoldInventoryValue", exact=exact_label)
    return (top_k(per, "UnsoldInventoryValue", "VendorName", k)
            .withColumn("UnsoldLabel", cents_label("UnsoldInventoryValue", exact_label)))


def final_frame(clean: DataFrame) -> DataFrame:
    """The analysed frame as exported (18 summary columns + UnitPurchasePrice,
    OrderSize, UnsoldInventoryValue)."""
    return with_order_size(clean).withColumn("UnsoldInventoryValue", unsold_inventory_value())
