"""Rankings and shares: brand performance and target brands (B2), top vendors
and brands (B3), the purchase Pareto (B4) and top-10 dependency (B5).

Semantics follow the original pandas code: groupings drop a NULL key, a
group sum of nothing is 0, ties are broken by the key (ascending) so every
top-k is deterministic. Thresholds and grand totals are scalar subqueries
(one-row aggregates evaluated once), never joins; windows run only over the
already-limited top-k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorscope.functions.exact_sum import exact_sums
from vendorscope.functions.numeric import ieee_div, round_half_even
from vendorscope.functions.quantile import exact_quantiles_wide
from vendorscope.functions.text import dollar_label
from vendorscope.session import materialize


def group_sum(df: DataFrame, key: str, *metrics: str, exact: bool = False) -> DataFrame:
    """pandas ``groupby(key)[metrics].sum()``: NULL keys dropped, empty sums 0.
    ``exact``, here and below: sums are exact and rounded once, so no digit of an
    answer depends on how the rows are partitioned (``exact_sums``)."""
    known = df.filter(F.col(key).isNotNull())
    if exact:
        sums = exact_sums(known, [key], {m: m for m in metrics})
        return sums.select(key, *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in metrics])
    return known.groupBy(key).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in metrics])


def top_k(df: DataFrame, metric: str, key: str, k: int = 10, ascending: bool = False) -> DataFrame:
    """Top ``k`` rows by ``metric`` (NULLs last), ties by ``key``; plans as a
    TakeOrderedAndProject (per-partition top-k, then a k-row merge)."""
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(m, F.col(key).asc()).limit(k)


# ---------------------------------------------------------------- B2 -------

def brand_performance(clean: DataFrame, exact: bool = False) -> DataFrame:
    """Per Description, total sales dollars and the unweighted mean margin."""
    if exact:
        sums = exact_sums(clean.filter(F.col("Description").isNotNull()), ["Description"],
                          {"sales": "TotalSalesDollars", "margins": "ProfitMargin"},
                          {"n": F.col("ProfitMargin").isNotNull().cast("long")})
        return sums.select("Description", F.coalesce("sales", F.lit(0.0)).alias("TotalSalesDollars"),
                           F.when(F.col("n") > 0, F.col("margins") / F.col("n")).alias("ProfitMargin"))
    return (clean.filter(F.col("Description").isNotNull()).groupBy("Description")
            .agg(F.coalesce(F.sum("TotalSalesDollars"), F.lit(0.0)).alias("TotalSalesDollars"),
                 F.avg("ProfitMargin").alias("ProfitMargin")))


def brand_thresholds(brands: DataFrame, low_sales_q: float = 0.15,
                     high_margin_q: float = 0.85) -> DataFrame:
    """One row, the low-sales and high-margin thresholds (exact, linear),
    both from one quantile job over the two columns."""
    q = exact_quantiles_wide(brands, ["TotalSalesDollars", "ProfitMargin"], [low_sales_q, high_margin_q])
    both = q.agg(F.max(F.when(F.col("column_name") == "TotalSalesDollars", F.col("q0"))).alias("low"),
                 F.max(F.when(F.col("column_name") == "ProfitMargin", F.col("q1"))).alias("high"))
    t = both.select(F.struct("low", "high")).scalar()
    return brands.sparkSession.range(1).select(t["low"].alias("LowSalesThreshold"),
                                               t["high"].alias("HighMarginThreshold"))


def _target_flag(brands: DataFrame, thresholds: DataFrame) -> Column:
    t = thresholds.select(F.struct("LowSalesThreshold", "HighMarginThreshold")).scalar()
    return ((F.col("TotalSalesDollars") <= t["LowSalesThreshold"])
            & (F.col("ProfitMargin") >= t["HighMarginThreshold"]))


def brand_performance_stored(clean: DataFrame) -> DataFrame:
    """Brand performance written once, so the thresholds and the rows they
    select are the same stored doubles (a re-computed sum may differ in its
    last bit and move a brand across its own quantile)."""
    return materialize(brand_performance(clean), "brand_performance")


def target_brands(clean: DataFrame, low_sales_q: float = 0.15, high_margin_q: float = 0.85,
                  brands: DataFrame | None = None) -> DataFrame:
    """B2 / F4 + O7: brands with low sales but a high margin, by sales ascending."""
    bp = brands if brands is not None else brand_performance_stored(clean)
    th = brand_thresholds(bp, low_sales_q, high_margin_q)
    return (bp.filter(_target_flag(bp, th))
              .orderBy(F.col("TotalSalesDollars").asc_nulls_last(), F.col("Description")))


def brand_scatter(clean: DataFrame, max_sales: float = 10_000.0, low_sales_q: float = 0.15,
                  high_margin_q: float = 0.85, brands: DataFrame | None = None) -> DataFrame:
    """X10 data: the 'All brands' layer (sales below ``max_sales``) and the
    'Target brands' layer (flag computed on all brands *before* the sales
    limit, so a target above the limit still appears in its own layer)."""
    bp = brands if brands is not None else brand_performance_stored(clean)
    th = brand_thresholds(bp, low_sales_q, high_margin_q)
    flagged = bp.withColumn("IsTarget", _target_flag(bp, th))
    layer = F.explode(F.array_compact(F.array(
        F.when(F.col("TotalSalesDollars") < max_sales, F.lit("All brands")),
        F.when(F.col("IsTarget"), F.lit("Target brands")))))
    return flagged.select(layer.alias("Layer"), "Description", "TotalSalesDollars", "ProfitMargin")


# ---------------------------------------------------------------- B3 -------

def top_sales(clean: DataFrame, key: str, k: int = 10, exact: bool = False) -> DataFrame:
    """A16 + O4 + P15: top ``k`` of ``key`` by summed sales dollars, labelled."""
    top = top_k(group_sum(clean, key, "TotalSalesDollars", exact=exact), "TotalSalesDollars", key, k)
    return top.withColumn("SalesLabel", dollar_label("TotalSalesDollars"))


def top_vendors_by_sales(clean: DataFrame, k: int = 10) -> DataFrame:
    return top_sales(clean, "VendorName", k)


def top_brands_by_sales(clean: DataFrame, k: int = 10) -> DataFrame:
    return top_sales(clean, "Description", k)


# ---------------------------------------------------------------- B4 / B5 --

def vendor_performance(clean: DataFrame, exact: bool = False) -> DataFrame:
    """A15 + W2: per vendor purchase $, gross profit, sales $, and the share of
    all purchase dollars (the total is a scalar subquery, not a window)."""
    vp = group_sum(clean, "VendorName", "TotalPurchaseDollars", "GrossProfit", "TotalSalesDollars", exact=exact)
    total = (exact_sums(vp, [], {"total": "TotalPurchaseDollars"}) if exact
             else vp.agg(F.sum("TotalPurchaseDollars"))).scalar()
    return vp.withColumn("PurchaseContributionPct",
                         ieee_div(F.col("TotalPurchaseDollars"), total) * 100)


def vendor_pareto(clean: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """The top ``k`` vendors by purchase share. As in the original, every
    number is rounded half-even to 2 decimals *before* the cumulative share is
    summed (sorting uses the unrounded share)."""
    vp = vendor_performance(clean, exact)
    money = ["TotalPurchaseDollars", "GrossProfit", "TotalSalesDollars", "PurchaseContributionPct"]
    # plain columns only up to the limit: a per-partition top k, then a merge of k rows
    top = top_k(vp.select("VendorName", *money), "PurchaseContributionPct", "VendorName", k)
    # windows over the k limited rows only; everything derived comes after them
    w = Window.orderBy(F.col("PurchaseContributionPct").desc_nulls_last(), F.col("VendorName"))
    ranked = top.withColumn("Rank", F.row_number().over(w).cast("long")).withColumn(
        "CumulativeContributionPct", F.sum(round_half_even(F.col("PurchaseContributionPct"), 2)).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
    rounded = ranked.select("Rank", "VendorName", *[round_half_even(F.col(c), 2).alias(c) for c in money],
                            "CumulativeContributionPct")
    return rounded.select(
        "*", dollar_label("TotalPurchaseDollars").alias("PurchaseDollarsLabel"),
        dollar_label("GrossProfit").alias("GrossProfitLabel"),
        dollar_label("TotalSalesDollars").alias("SalesDollarsLabel"))


def _top_shares(clean: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """One row: the top ``k`` (rank, vendor, rounded share) as an array."""
    top = vendor_pareto(clean, k, exact)
    return top.agg(F.array_sort(F.collect_list(F.struct("Rank", "VendorName", "PurchaseContributionPct"))).alias("top"))


def _share_sum(top: Column) -> Column:
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + F.coalesce(x["PurchaseContributionPct"], F.lit(0.0)))


def vendor_dependency(clean: DataFrame, k: int = 10, other_label: str = "Other Vendors",
                      exact: bool = False) -> DataFrame:
    """The top ``k`` rounded shares plus one residual row,
    100 minus the sum of the rounded top shares (both from one run of the
    ranking: its k rows travel as one array)."""
    rest = F.struct(F.lit(k + 1).cast("long").alias("Rank"), F.lit(other_label).alias("VendorName"),
                    (F.lit(100.0) - _share_sum(F.col("top"))).alias("PurchaseContributionPct"))
    return _top_shares(clean, k, exact).select(F.inline(F.concat("top", F.array(rest))))


def top_vendor_share(clean: DataFrame, k: int = 10) -> DataFrame:
    """B5 headline: the summed rounded share of the top ``k`` vendors."""
    return _top_shares(clean, k).select(_share_sum(F.col("top")).alias("TopVendorsPct"))
