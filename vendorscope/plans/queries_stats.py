"""Registered queries for statistics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendorscope.functions.numeric import numeric_columns
from vendorscope.operators import distributions as D
from vendorscope.operators import stats as ST
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import np_quantiles, with_views
from vendorscope.plans.registry import register
from vendorscope.sources.schemas import VENDOR_SALES_SUMMARY

NUMERIC = numeric_columns(VENDOR_SALES_SUMMARY)


def nn(expr: str) -> str:
    """NaN -> NULL."""
    return f"(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END)"


def long_sql(name: str, src: str, finite_only: bool, ids: bool = False) -> str:
    """(column_name, x[, rowid_, id_vendor, id_brand]) rows of every numeric
    summary column of ``src``."""
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
    extra = "VendorNumber AS id_vendor, Brand AS id_brand, row_number() OVER () AS rowid_, " if ids else ""
    keep = "id_vendor, id_brand, rowid_, " if ids else ""
    cond = "WHERE isfinite(x)" if finite_only else "WHERE NOT isnan(x)"
    return f"""
{name} AS (
  SELECT {keep}column_name, x FROM (SELECT {extra}{casts} FROM {src})
  UNPIVOT (x FOR column_name IN ({", ".join(NUMERIC)})) {cond}
)"""


POSITIONS = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(NUMERIC)) + ") AS p(position, column_name)"

# ---------------------------------------------------------------- A13 ------

DESCRIBE = with_views(f"""
SELECT CAST(p.position AS BIGINT) AS position, p.column_name, coalesce(m.count, 0) AS count,
       {nn('m.mean')} AS mean, {nn('m.std')} AS std, m.min, q.q25, q.q50, q.q75, m.max
FROM {POSITIONS}
LEFT JOIN (SELECT column_name, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std,
                  min(x) AS min, max(x) AS max FROM d_long GROUP BY column_name) AS m
       ON m.column_name = p.column_name
LEFT JOIN (SELECT column_name, max(CASE WHEN prob = 0.25 THEN value END) AS q25,
                  max(CASE WHEN prob = 0.5 THEN value END) AS q50,
                  max(CASE WHEN prob = 0.75 THEN value END) AS q75
           FROM d_q GROUP BY column_name) AS q ON q.column_name = p.column_name""",
    long_sql("d_long", "vss", finite_only=False), np_quantiles("d_q", "d_long", ["column_name"], [0.25, 0.5, 0.75]))


@register("describe", DESCRIBE, doubles=("mean", "std", "min", "q25", "q50", "q75", "max"))
def describe(ctx: VendorContext):
    return ST.describe(ctx.summary)


# ---------------------------------------------------------------- A24 ------

def _corr_sql() -> str:
    exprs, cells = [], []
    for i, a in enumerate(NUMERIC):
        for j in range(i, len(NUMERIC)):
            b = NUMERIC[j]
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            den = (f"(stddev_samp(CAST({a} AS DOUBLE)) FILTER (WHERE {both}) * "
                   f"stddev_samp(CAST({b} AS DOUBLE)) FILTER (WHERE {both}))")
            num = f"covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FILTER (WHERE {both})"
            exprs.append(f"CASE WHEN {den} = 0 OR isnan({num} / {den}) THEN NULL "
                         f"ELSE {num} / {den} END AS c_{i}_{j}")
            cells.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, c_{i}_{j} AS corr FROM cw")
            if i != j:
                cells.append(f"SELECT '{b}' AS col_x, '{a}' AS col_y, c_{i}_{j} AS corr FROM cw")
    cw = "cw AS (SELECT " + ",\n  ".join(exprs) + " FROM clean)"
    body = ("SELECT col_x, col_y, corr, printf('%.2f', corr) AS corr_label FROM (\n"
            + "\nUNION ALL ".join(cells) + "\n) AS cells")
    return with_views(body, cw)


@register("correlation", _corr_sql(), doubles=("corr",))
def correlation(ctx: VendorContext):
    return ST.correlation_matrix(ctx.clean)


# ---------------------------------------------------------------- B9/B10 ---

def _t_quantile_sql(target: float) -> str:
    """CTE tq(segment, t_critical): the t quantile with P(0 < T < t) =
    ``target`` for each segment's nu, from a cumulative trapezoid integral of
    the density on a 1e-4 grid (with its end correction) and one
    second-order Newton step."""
    h = 1e-4
    return f"""
tq_nu AS (SELECT segment, CAST(n - 1 AS DOUBLE) AS nu FROM mom WHERE n >= 2),
tq_f AS (
  SELECT segment, nu, t,
         exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi())
           * pow(1 + t * t / nu, -(nu + 1) / 2) AS f
  FROM (SELECT segment, nu, CAST(i AS DOUBLE) * {h} AS t FROM tq_nu, range(0, 400001) r(i)) AS g
),
tq_c AS (
  SELECT segment, nu, t, f,
         {h} * (sum(f) OVER w - 0.5 * first_value(f) OVER w - 0.5 * f)
           + ({h} * {h} / 12) * f * (nu + 1) * t / (nu + t * t) AS c
  FROM tq_f WINDOW w AS (PARTITION BY segment ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
tq_last AS (SELECT segment, max(t) AS tk FROM tq_c WHERE c < {target!r} GROUP BY segment),
tq AS (
  SELECT c.segment,
         c.t + d.delta + ((c.nu + 1) * c.t / (c.nu + c.t * c.t)) / 2 * d.delta * d.delta AS t_critical
  FROM tq_c c JOIN tq_last l ON c.segment = l.segment AND c.t = l.tk,
       LATERAL (SELECT ({target!r} - c.c) / c.f AS delta) AS d
)"""


MARGIN = """
mq AS (SELECT TotalSalesDollars AS x FROM clean),""" + np_quantiles("m_th", "mq", [], [0.75, 0.25]) + """,
mth AS (SELECT max(CASE WHEN prob = 0.75 THEN value END) AS top,
               max(CASE WHEN prob = 0.25 THEN value END) AS low FROM m_th),
samples AS (
  SELECT 'top' AS segment, ProfitMargin AS v FROM clean, mth
  WHERE TotalSalesDollars >= mth.top AND ProfitMargin IS NOT NULL AND NOT isnan(ProfitMargin)
  UNION ALL
  SELECT 'low', ProfitMargin FROM clean, mth
  WHERE TotalSalesDollars <= mth.low AND ProfitMargin IS NOT NULL AND NOT isnan(ProfitMargin)
),
mom AS (
  SELECT g.segment, count(s.v) AS n, avg(s.v) AS mean,
         CASE WHEN isnan(var_samp(s.v)) THEN NULL ELSE var_samp(s.v) END AS variance
  FROM (VALUES ('top'), ('low')) AS g(segment) LEFT JOIN samples s ON s.segment = g.segment
  GROUP BY g.segment
)"""


@register("welch_inputs", with_views("SELECT segment, n, mean, variance FROM mom", MARGIN),
          doubles=("mean", "variance"))
def welch_inputs(ctx: VendorContext):
    return ST.sample_moments(ST.margin_samples(ctx.clean))


@register("margin_ci", with_views("""
SELECT m.segment, m.n, m.mean, sqrt(m.variance) AS std, sqrt(m.variance) / sqrt(m.n) AS std_err,
       tq.t_critical,
       m.mean - tq.t_critical * (sqrt(m.variance) / sqrt(m.n)) AS lower,
       m.mean + tq.t_critical * (sqrt(m.variance) / sqrt(m.n)) AS upper,
       CAST(0.95 AS DOUBLE) AS confidence
FROM mom m LEFT JOIN tq ON tq.segment = m.segment""", MARGIN, _t_quantile_sql((1.0 + 0.95) / 2.0 - 0.5)),
          doubles=("mean", "std", "std_err", "t_critical", "lower", "upper", "confidence"))
def margin_ci(ctx: VendorContext):
    return ST.margin_confidence_intervals(ctx.clean)


SIMPSON_N = 20000

WELCH = f"""
w1 AS (
  SELECT max(CASE WHEN segment = 'top' THEN n END) AS n_top,
         max(CASE WHEN segment = 'top' THEN mean END) AS mean_top,
         max(CASE WHEN segment = 'top' THEN variance END) AS var_top,
         max(CASE WHEN segment = 'low' THEN n END) AS n_low,
         max(CASE WHEN segment = 'low' THEN mean END) AS mean_low,
         max(CASE WHEN segment = 'low' THEN variance END) AS var_low
  FROM mom
),
w2 AS (SELECT *, var_top / n_top AS vn1, var_low / n_low AS vn2 FROM w1),
w3 AS (
  SELECT (mean_top - mean_low) / sqrt(vn1 + vn2) AS t_statistic,
         (vn1 + vn2) * (vn1 + vn2) / (vn1 * vn1 / (n_top - 1) + vn2 * vn2 / (n_low - 1)) AS dof
  FROM w2
),
simpson AS (
  -- the tail beyond |t|, mapped to s in [0, 1) by x = |t| + s / (1 - s)
  SELECT sum(CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi())
             * pow(1 + x * x / dof, -(dof + 1) / 2) / ((1 - s) * (1 - s)) / {SIMPSON_N}) / 3 AS tail
  FROM (SELECT dof, i, s, abs(t_statistic) + s / (1 - s) AS x
        FROM (SELECT t_statistic, dof, i, CAST(i AS DOUBLE) / {SIMPSON_N} AS s
              FROM w3, range(0, {SIMPSON_N}) r(i)) AS q) AS g
)"""


@register("welch_test", with_views("""
SELECT t_statistic, dof, p_value, CAST(0.05 AS DOUBLE) AS alpha, coalesce(p_value < 0.05, false) AS reject_h0,
       CASE WHEN coalesce(p_value < 0.05, false)
            THEN 'Reject H0: significant difference in profit margins'
            ELSE 'Fail to reject H0: no significant difference' END AS conclusion
FROM (SELECT t_statistic, dof, 2 * tail AS p_value FROM w3, simpson) AS r""",
                                   MARGIN, WELCH),
          doubles=("t_statistic", "dof", "p_value", "alpha"))
def welch_test(ctx: VendorContext):
    return ST.welch_test(ctx.clean)


# ---------------------------------------------------------------- X4-X8 ----

def _hist_sql(long_cte: str, long_name: str, bins: int = 30) -> list[str]:
    return [long_cte, f"""
h_rng AS (
  SELECT column_name,
         CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM {long_name} GROUP BY column_name
),
h_edges AS (
  SELECT column_name, k,
         CASE WHEN k = {bins} THEN hi ELSE CAST(k AS DOUBLE) * ((hi - lo) / CAST({bins} AS DOUBLE)) + lo END AS e
  FROM h_rng, range(0, {bins + 1}) r(k)
),
h_bin AS (
  SELECT l.column_name, count(e.k) AS bin
  FROM {long_name} l LEFT JOIN h_edges e
    ON e.column_name = l.column_name AND e.k BETWEEN 1 AND {bins - 1} AND e.e <= l.x
  GROUP BY l.column_name, l.rowid_
),
h_cnt AS (SELECT column_name, bin, count(*) AS cnt FROM h_bin GROUP BY column_name, bin)"""]


HIST_BODY = """
SELECT e.column_name, e.k AS bin, e.e AS bin_lo, e2.e AS bin_hi, coalesce(c.cnt, 0) AS count
FROM h_edges e JOIN h_edges e2 ON e2.column_name = e.column_name AND e2.k = e.k + 1
LEFT JOIN h_cnt c ON c.column_name = e.column_name AND c.bin = e.k"""


@register("histogram", with_views(HIST_BODY, *_hist_sql(long_sql("h_long", "clean", True, ids=True), "h_long")),
          doubles=("bin_lo", "bin_hi"))
def histogram(ctx: VendorContext):
    return D.histogram(ctx.clean)


@register("margin_histogram_by_group", with_views(HIST_BODY, MARGIN, *_hist_sql("""
mh_long AS (SELECT segment AS column_name, v AS x, row_number() OVER () AS rowid_ FROM samples
            WHERE isfinite(v))""", "mh_long")), doubles=("bin_lo", "bin_hi"))
def margin_histogram_by_group(ctx: VendorContext):
    samples = ST.margin_samples(ctx.clean)
    return D.histogram_long(samples.select(F.col("segment").alias("column_name"),
                                           F.col("value").alias("x")))


@register("histogram_unfiltered", with_views(HIST_BODY, *_hist_sql(long_sql("h_long", "vss", True, ids=True),
                                                                    "h_long")),
          doubles=("bin_lo", "bin_hi"))
def histogram_unfiltered(ctx: VendorContext):
    return D.histogram(ctx.summary)


KDE = f"""
k_par AS (
  SELECT column_name, count(x) AS n, min(x) AS lo, max(x) AS hi,
         stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2) AS bw
  FROM k_long GROUP BY column_name HAVING count(x) >= 2 AND stddev_samp(x) > 0
),
k_grid AS (
  SELECT column_name, g, n, lo, hi, bw,
         CASE WHEN g = 199 THEN hi ELSE CAST(g AS DOUBLE) * ((hi - lo) / 199.0) + lo END AS gx
  FROM k_par, range(0, 200) r(g)
)"""


KDE_BODY = """
SELECT g.column_name, g.g AS grid, g.gx AS x,
       sum(exp(-0.5 * ((g.gx - l.x) / g.bw) * ((g.gx - l.x) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())) AS density,
       sum(exp(-0.5 * ((g.gx - l.x) / g.bw) * ((g.gx - l.x) / g.bw))) / (g.n * g.bw * sqrt(2 * pi()))
         * g.n * (g.hi - g.lo) / 30.0 AS count_density
FROM k_grid g JOIN k_long l ON l.column_name = g.column_name
GROUP BY g.column_name, g.g, g.gx, g.n, g.bw, g.lo, g.hi"""
KDE_DOUBLES = ("x", "density", "count_density")


@register("kde_unfiltered", with_views(KDE_BODY, long_sql("k_long", "vss", True), KDE), doubles=KDE_DOUBLES)
def kde_unfiltered(ctx: VendorContext):
    return D.kde(ctx.summary, prebin=None)


@register("margin_kde_by_group", with_views(KDE_BODY, MARGIN, """
k_long AS (SELECT segment AS column_name, v AS x FROM samples WHERE isfinite(v))""", KDE),
          doubles=KDE_DOUBLES)
def margin_kde_by_group(ctx: VendorContext):
    samples = ST.margin_samples(ctx.clean)
    return D.kde_long(samples.select(F.col("segment").alias("column_name"), F.col("value").alias("x")),
                      prebin=None)


@register("kde", with_views(KDE_BODY, long_sql("k_long", "clean", True), KDE), doubles=KDE_DOUBLES)
def kde(ctx: VendorContext):
    return D.kde(ctx.clean, prebin=None)


KDE_BINNED = """
SELECT g.column_name, g.g AS grid, g.gx AS x, sum(c.w * exp(-0.5 * pow((g.gx - c.centre) / g.bw, 2)))
       / (g.n * g.bw * sqrt(2 * pi())) AS density,
       sum(c.w * exp(-0.5 * pow((g.gx - c.centre) / g.bw, 2))) / (g.bw * sqrt(2 * pi())) * (g.hi - g.lo) / 30.0
         AS count_density
FROM k_grid g JOIN (
  SELECT column_name, any_value(lo) + (cell + 0.5) * (any_value(hi - lo) / 2048) AS centre, count(*) AS w
  FROM (SELECT l.column_name, lo, hi, least(CAST(floor((l.x - lo) / ((hi - lo) / 2048)) AS BIGINT), 2047) AS cell
        FROM k_long l JOIN k_par p ON p.column_name = l.column_name) GROUP BY column_name, cell) AS c
  ON c.column_name = g.column_name
GROUP BY g.column_name, g.g, g.gx, g.n, g.bw, g.lo, g.hi"""


@register("kde_binned", with_views(KDE_BINNED, long_sql("k_long", "clean", True), KDE), doubles=KDE_DOUBLES)
def kde_binned(ctx: VendorContext):
    return D.kde(ctx.clean)


def _box_sql(src_long: str, groups: list[str]) -> str:
    keys = groups + ["column_name"]
    k = ", ".join(keys)
    on = " AND ".join(f"l.{c} IS NOT DISTINCT FROM q.{c}" for c in keys)
    on_s = " AND ".join(f"l.{c} IS NOT DISTINCT FROM s.{c}" for c in keys)
    return np_quantiles("b_q", src_long, keys, [0.25, 0.5, 0.75]) + f""",
b_qw AS (
  SELECT {k}, max(CASE WHEN prob = 0.25 THEN value END) AS q1,
         max(CASE WHEN prob = 0.5 THEN value END) AS median,
         max(CASE WHEN prob = 0.75 THEN value END) AS q3
  FROM b_q GROUP BY {k}
),
b_ext AS (
  SELECT {", ".join("q." + c for c in keys)}, count(l.x) AS n, min(q.q1) AS q1, min(q.median) AS median,
         min(q.q3) AS q3, min(q.q3 - q.q1) AS iqr,
         min(l.x) FILTER (WHERE l.x >= q.q1 - 1.5 * (q.q3 - q.q1)) AS wlo,
         max(l.x) FILTER (WHERE l.x <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whi
  FROM {src_long} l JOIN b_qw q ON {on} GROUP BY {", ".join("q." + c for c in keys)}
),
b_st AS (
  SELECT {k}, n, q1, median, q3, iqr,
         CASE WHEN wlo IS NULL OR wlo > q1 THEN q1 ELSE wlo END AS whislo,
         CASE WHEN whi IS NULL OR whi < q3 THEN q3 ELSE whi END AS whishi
  FROM b_ext
),
b_out AS (
  SELECT {", ".join("s." + c for c in keys)}, count(*) FILTER (WHERE l.x < s.whislo OR l.x > s.whishi) AS n_outliers
  FROM {src_long} l JOIN b_st s ON {on_s} GROUP BY {", ".join("s." + c for c in keys)}
)"""


BOX_DOUBLES = ("q1", "median", "q3", "iqr", "whislo", "whishi")


@register("boxplot", with_views("SELECT b_st.*, b_out.n_outliers FROM b_st JOIN b_out USING (column_name)",
                                long_sql("b_long", "vss", True), _box_sql("b_long", [])),
          doubles=BOX_DOUBLES)
def boxplot(ctx: VendorContext):
    return D.boxplot_stats(ctx.summary)


@register("boxplot_by_order_size", with_views(
    "SELECT b_st.*, b_out.n_outliers FROM b_st JOIN b_out USING (OrderSize, column_name)",
    __import__("vendorscope.plans.queries_analysis", fromlist=["QCUT"]).QCUT,
    """
ob_long AS (SELECT OrderSize, 'UnitPurchasePrice' AS column_name, UnitPurchasePrice AS x
            FROM sized WHERE isfinite(UnitPurchasePrice))""", _box_sql("ob_long", ["OrderSize"])),
          doubles=BOX_DOUBLES)
def boxplot_by_order_size(ctx: VendorContext):
    return D.boxplot_stats(ctx.analysis, ["UnitPurchasePrice"], by=["OrderSize"])


@register("outliers", with_views("""
SELECT l.column_name, l.id_vendor AS VendorNumber, l.id_brand AS Brand, l.x AS value
FROM o_long l JOIN b_st s ON s.column_name = l.column_name
WHERE l.x < s.whislo OR l.x > s.whishi""",
                                 long_sql("b_long", "vss", True), _box_sql("b_long", []),
                                 long_sql("o_long", "vss", True, ids=True)),
          doubles=("value",))
def outliers(ctx: VendorContext):
    return D.outliers(ctx.summary)


@register("category_counts", with_views("""
SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS BIGINT) AS rank,
       value, count
FROM (SELECT 'VendorName' AS column_name, VendorName AS value, count(*) AS count FROM clean
      WHERE VendorName IS NOT NULL GROUP BY VendorName
      UNION ALL
      SELECT 'Description', Description, count(*) FROM clean
      WHERE Description IS NOT NULL GROUP BY Description) AS c
QUALIFY rank <= 10"""))
def category_counts(ctx: VendorContext):
    return D.category_counts(ctx.clean)
