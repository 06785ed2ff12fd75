"""Descriptive statistics (A13), the correlation matrix (A24/X9), and the
margin confidence intervals and Welch test for top- vs low-selling rows
(B9, B10).

Everything is one or two passes of built-in aggregates; only the Student t
quantile / tail probability of the final one- or two-row result goes
through an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.functions.moments import co_moments, column_moments, correlation_rows
from vendorscope.functions.numeric import ieee_div, nan_to_null, numeric_columns
from vendorscope.functions.quantile import exact_quantiles_wide, quantile_values
from vendorscope.functions.tdist import t_ppf_udf, t_two_sided_p_udf
from vendorscope.functions.text import fixed_decimals

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df.describe().T``: per numeric column count, mean, std (ddof 1), min,
    25/50/75% (exact, linear) and max: one scan for the moments, and the passes
    of the exact quantiles for all columns together."""
    cols = list(columns) if columns is not None else numeric_columns(df.schema)
    q = exact_quantiles_wide(df, cols, DESCRIBE_PROBS)
    names = df.sparkSession.range(len(cols)).select(
        F.col("id").alias("position"), F.array(*[F.lit(c) for c in cols])[F.col("id")].alias("column_name"))
    # one row per column: a bound fixed by the caller's column list
    return (names.join(F.broadcast(column_moments(df, cols).withColumnRenamed("k", "position")), "position", "left")
            .join(F.broadcast(q), "column_name", "left")
            .select("position", "column_name", F.coalesce(F.col("count"), F.lit(0)).alias("count"),
                    nan_to_null(F.col("mean")).alias("mean"), nan_to_null(F.col("std")).alias("std"),
                    "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"),
                    "max"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The square matrix in long form (col_x, col_y, corr, label).

    Pairwise-complete Pearson r from one scan: every task reduces its rows to
    one partial of co-moments (``functions/moments.py``), partials merge. A
    constant or one-row column gives NULL, not an ANSI error; so does a pair
    with an infinite value."""
    cols = list(columns) if columns is not None else numeric_columns(df.schema)
    pairs = co_moments(df, cols).mapInArrow(correlation_rows(len(cols)), "i long, j long, corr double")
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.select(names[F.col("i").cast("int")].alias("col_x"), names[F.col("j").cast("int")].alias("col_y"),
                        "corr", fixed_decimals(F.col("corr"), 2).alias("corr_label"))


# ------------------------------------------------------------- B9 / B10 ----

def margin_samples(clean: DataFrame, top_q: float = 0.75, low_q: float = 0.25,
                   sales: str = "TotalSalesDollars", metric: str = "ProfitMargin") -> DataFrame:
    """F7 + P13: rows with sales >= the 75th percentile are 'top', rows with
    sales <= the 25th are 'low' (a row can be both); the metric without NULLs.
    Long form (segment, value); the two thresholds are one scalar subquery."""
    th = quantile_values(clean, sales, [top_q, low_q])
    t = th.select(F.struct(F.col("q0").alias("top"), F.col("q1").alias("low"))).scalar()
    groups = F.array_compact(F.array(F.when(F.col(sales) >= t["top"], F.lit("top")),
                                     F.when(F.col(sales) <= t["low"], F.lit("low"))))
    return (clean.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
                 .select(F.explode(groups).alias("segment"), F.col(metric).alias("value")))


def sample_moments(samples: DataFrame) -> DataFrame:
    """N, mean, sample variance and std per group, both groups always present."""
    one = samples.agg(*[
        agg for g in ("top", "low") for agg in (
            F.count(F.when(F.col("segment") == g, F.col("value"))).alias(f"n_{g}"),
            F.avg(F.when(F.col("segment") == g, F.col("value"))).alias(f"mean_{g}"),
            F.var_samp(F.when(F.col("segment") == g, F.col("value"))).alias(f"var_{g}"))])
    rows = F.array(*[F.struct(F.lit(g).alias("segment"), F.col(f"n_{g}").alias("n"),
                              F.col(f"mean_{g}").alias("mean"),
                              nan_to_null(F.col(f"var_{g}")).alias("variance"))
                     for g in ("top", "low")])
    return one.select(F.inline(rows))


def margin_confidence_intervals(clean: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean +- t((1+c)/2, n-1) * s / sqrt(n) for each group."""
    m = sample_moments(margin_samples(clean))
    std = F.sqrt(F.col("variance"))
    se = std / F.sqrt(F.col("n").cast("double"))
    tcrit = t_ppf_udf(F.lit((1.0 + confidence) / 2.0), (F.col("n") - 1).cast("double"))
    return (m.select("segment", "n", "mean", std.alias("std"), se.alias("std_err"),
                     tcrit.alias("t_critical"))
             .withColumn("lower", F.col("mean") - F.col("t_critical") * F.col("std_err"))
             .withColumn("upper", F.col("mean") + F.col("t_critical") * F.col("std_err"))
             .withColumn("confidence", F.lit(confidence)))


def welch_test(clean: DataFrame, alpha: float = 0.05) -> DataFrame:
    """X2 + X3 / B10: Welch's unequal-variance t test, two-sided, top vs low;
    H0 rejected when p < alpha (strictly)."""
    m = sample_moments(margin_samples(clean))
    one = m.agg(*[F.max(F.when(F.col("segment") == g, F.col(c))).alias(f"{c}_{g}")
                  for g in ("top", "low") for c in ("n", "mean", "variance")])
    vn1 = F.col("variance_top") / F.col("n_top")
    vn2 = F.col("variance_low") / F.col("n_low")
    t = ieee_div(F.col("mean_top") - F.col("mean_low"), F.sqrt(vn1 + vn2))
    dof = ieee_div((vn1 + vn2) * (vn1 + vn2),
                   vn1 * vn1 / (F.col("n_top") - 1) + vn2 * vn2 / (F.col("n_low") - 1))
    tested = one.select(nan_to_null(t).alias("t_statistic"), nan_to_null(dof).alias("dof"))
    p = t_two_sided_p_udf(F.col("t_statistic"), F.col("dof"))
    return (tested.select("t_statistic", "dof", nan_to_null(p).alias("p_value"))
            .withColumn("alpha", F.lit(alpha))
            .withColumn("reject_h0", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
            .withColumn("conclusion", F.when(F.col("reject_h0"),
                        F.lit("Reject H0: significant difference in profit margins"))
                        .otherwise(F.lit("Fail to reject H0: no significant difference"))))
