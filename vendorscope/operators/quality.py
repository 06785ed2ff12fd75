"""Data-quality operators: the anomaly profile behind the summary-statistics
notes (Q2) and key-uniqueness checks for the keys the tables claim (Q3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def anomaly_profile(summary: DataFrame) -> DataFrame:
    """Q2: one pass over the full (unfiltered) summary: loss rows, -inf
    margins, unsold rows, turnover above 1, and the extremes the notes quote
    (minimum gross profit, price max/mean, freight and turnover range)."""
    return summary.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("GrossProfit") < 0).alias("negative_profit_rows"),
        F.count_if(F.col("ProfitMargin") == F.lit(-INF)).alias("neg_inf_margin_rows"),
        F.count_if(F.col("TotalSalesQuantity") == 0).alias("zero_sales_qty_rows"),
        F.count_if(F.col("TotalSalesDollars") == 0).alias("zero_sales_dollar_rows"),
        F.count_if(F.col("StockTurnover") > 1).alias("turnover_above_1_rows"),
        F.min("GrossProfit").alias("min_gross_profit"),
        F.min("ProfitMargin").alias("min_profit_margin"),
        F.max("PurchasePrice").alias("max_purchase_price"),
        F.avg("PurchasePrice").alias("mean_purchase_price"),
        F.max("ActualPrice").alias("max_actual_price"),
        F.avg("ActualPrice").alias("mean_actual_price"),
        F.min("FreightCost").alias("min_freight"),
        F.max("FreightCost").alias("max_freight"),
        F.min("StockTurnover").alias("min_turnover"),
        F.max("StockTurnover").alias("max_turnover"),
    )


def key_uniqueness(checks: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Q3: for each (table, key columns): rows, distinct keys, keys seen more
    than once and the rows they cover. A key is unique when
    duplicate_keys == 0. One grouped count per table, then a global sum."""
    out = None
    for name, (df, keys) in checks.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        row = per_key.agg(
            F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("c") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("long")
             .alias("rows_in_duplicates"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*")
        out = row if out is None else out.unionByName(row)
    return out
