"""DuckDB SQL oracles: an independent statement of every registered query.

Each oracle starts with the vendor views (built from the star-schema tables
the checker registers), the summary CTEs, and the cleaned mart as a
MATERIALIZED CTE (so thresholds and rows share one set of stored doubles, as
in the Spark jobs). DuckDB-specific spellings: ``regexp_replace(..., 'g')``,
and IEEE division written out as a CASE because DuckDB returns NULL for x/0.
"""

from __future__ import annotations

from vendorscope.functions.text import STRIP_PATTERN

VIEWS = """
brand_dim AS (
  SELECT p_partkey,
         CAST(replace(p_brand, 'Brand#', '') AS BIGINT) * 10 +
           CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2
                       WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS Brand,
         concat(p_brand, ' ', p_type) AS Description, p_retailprice, p_size
  FROM part
),
purchase_prices AS (
  SELECT min(p_partkey) % 10 AS VendorNumber, Brand, min(Description) AS Description,
         max(p_retailprice) AS Price, CAST(max(p_size) AS VARCHAR) AS Volume,
         min(p_retailprice) / 2 AS PurchasePrice
  FROM brand_dim GROUP BY Brand
),
purchases AS (
  SELECT l.l_suppkey AS VendorNumber, concat('  ', s.s_name, chr(9)) AS VendorName, b.Brand,
         concat(b.Description, ' ') AS Description,
         CASE WHEN l.l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE pp.PurchasePrice END AS PurchasePrice,
         CAST(l.l_quantity AS BIGINT) AS Quantity, l.l_extendedprice AS Dollars,
         l.l_orderkey AS PONumber, CAST(l.l_shipdate AS DATE) AS PODate
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
       JOIN brand_dim b ON b.p_partkey = l.l_partkey
       JOIN purchase_prices pp ON pp.Brand = b.Brand
  WHERE l.l_linestatus = 'F'
),
vendor_invoice AS (
  SELECT l_suppkey AS VendorNumber, l_orderkey AS PONumber,
         CAST(sum(l_quantity) AS BIGINT) AS Quantity, sum(l_extendedprice) AS Dollars,
         sum(l_extendedprice * l_tax) AS Freight
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey, l_orderkey
),
sales AS (
  SELECT l.l_suppkey AS VendorNo, b.Brand, CAST(l.l_quantity AS BIGINT) AS SalesQuantity,
         l.l_extendedprice * (1 - l.l_discount) AS SalesDollars,
         l.l_extendedprice / l.l_quantity AS SalesPrice, l.l_extendedprice * l.l_tax AS ExciseTax
  FROM lineitem l JOIN brand_dim b ON b.p_partkey = l.l_partkey
  WHERE l.l_linestatus = 'O'
)"""

# One pass over the order lines gives both sides of every (vendor, brand):
# conditional sums over the line status. What a purchase costs and how often
# the price list names its brand come from the list, once per brand.
SUMMARY = """
line AS (
  SELECT l_suppkey AS supp, Brand AS brand, concat(Description, ' ') AS label, l_linestatus = 'F' AS is_buy,
         l_discount <> 0 AS has_price, CAST(l_quantity AS BIGINT) AS units, l_extendedprice AS amount,
         l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice / l_quantity AS unit_price,
         l_extendedprice * l_tax AS tax
  FROM lineitem JOIN brand_dim ON p_partkey = l_partkey
),
pair AS (
  SELECT supp, brand, min(label) AS label,
         count(*) FILTER (WHERE is_buy AND has_price) AS buys,
         CAST(sum(units) FILTER (WHERE is_buy AND has_price) AS BIGINT) AS bought_units,
         sum(amount) FILTER (WHERE is_buy AND has_price) AS bought_amount,
         count(*) FILTER (WHERE NOT is_buy) AS sales,
         CAST(sum(units) FILTER (WHERE NOT is_buy) AS BIGINT) AS sold_units,
         sum(revenue) FILTER (WHERE NOT is_buy) AS sold_amount,
         sum(unit_price) FILTER (WHERE NOT is_buy) AS sold_prices,
         sum(tax) FILTER (WHERE NOT is_buy) AS sold_tax
  FROM line GROUP BY supp, brand
),
freight_per_vendor AS (
  SELECT l_suppkey AS VendorNumber, sum(l_extendedprice * l_tax) AS FreightCost
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey
),
summary_raw AS (
  SELECT supp AS VendorNumber, concat('  ', s_name, chr(9)) AS VendorName, pair.brand AS Brand, label AS Description,
         list.PurchasePrice, list.Price AS ActualPrice, list.Volume,
         bought_units AS TotalPurchaseQuantity, bought_amount AS TotalPurchaseDollars,
         CAST(sold_units AS DOUBLE) AS TotalSalesQuantity, sold_amount AS TotalSalesDollars,
         sold_prices AS TotalSalesPrice, sold_tax AS TotalExciseTax,
         (SELECT FreightCost FROM freight_per_vendor f WHERE f.VendorNumber = pair.supp) AS FreightCost
  FROM pair JOIN purchase_prices list ON list.Brand = pair.brand JOIN supplier ON s_suppkey = supp
  WHERE buys > 0 AND list.PurchasePrice > 0
)"""


def ieee(a: str, b: str) -> str:
    """a / b with x/0 = +-inf and 0/0 = NULL."""
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN ({b}) <> 0 THEN ({a}) / ({b}) "
            f"WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) ELSE NULL END)")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{STRIP_PATTERN}', '', 'g')"


CLEAN = f"""
filled AS (
  SELECT coalesce(VendorNumber, 0) AS VendorNumber, {strip('VendorName')} AS VendorName,
         coalesce(Brand, 0) AS Brand, {strip('Description')} AS Description,
         coalesce(PurchasePrice, 0) AS PurchasePrice, coalesce(ActualPrice, 0) AS ActualPrice,
         coalesce(CAST(Volume AS DOUBLE), 0) AS Volume,
         coalesce(TotalPurchaseQuantity, 0) AS TotalPurchaseQuantity,
         coalesce(TotalPurchaseDollars, 0) AS TotalPurchaseDollars,
         coalesce(CAST(TotalSalesQuantity AS DOUBLE), 0) AS TotalSalesQuantity,
         coalesce(TotalSalesDollars, 0) AS TotalSalesDollars,
         coalesce(TotalSalesPrice, 0) AS TotalSalesPrice,
         coalesce(TotalExciseTax, 0) AS TotalExciseTax, coalesce(FreightCost, 0) AS FreightCost
  FROM summary_raw
),
vss AS MATERIALIZED (
  SELECT *, TotalSalesDollars - TotalPurchaseDollars AS GrossProfit,
         {ieee('TotalSalesDollars - TotalPurchaseDollars', 'TotalSalesDollars')} * 100 AS ProfitMargin,
         {ieee('TotalSalesQuantity', 'TotalPurchaseQuantity')} AS StockTurnover,
         {ieee('TotalSalesDollars', 'TotalPurchaseDollars')} AS SalesToPurchaseRatio
  FROM filled
),
clean AS (
  SELECT * FROM vss WHERE GrossProfit > 0 AND ProfitMargin > 0 AND TotalSalesQuantity > 0
)"""


def with_views(body: str, *ctes: str, summary: bool = True, clean: bool = True) -> str:
    """``WITH <views>[, <summary>][, <clean>][, ctes...] <body>``."""
    blocks = [VIEWS]
    if summary:
        blocks.append(SUMMARY)
    if clean:
        blocks.append(CLEAN)
    blocks.extend(ctes)
    return "WITH " + ",".join(blocks) + "\n" + body


def dollar_label_sql(v: str) -> str:
    """The dollar label in DuckDB: printf rounds the binary value like Python,
    and DuckDB prints doubles exactly as Python's ``str``."""
    return (f"(CASE WHEN isnan({v}) THEN 'nan' "
            f"WHEN ({v}) >= 1000000 THEN printf('%.6f', ({v}) / 1000000) || 'M' "
            f"WHEN ({v}) >= 1000 THEN printf('%.2f', ({v}) / 1000) || 'K' "
            f"ELSE CAST({v} AS VARCHAR) END)")


def np_quantiles(name: str, src: str, groups: list[str], probs: list[float]) -> str:
    """CTEs ``{name}`` = (groups..., prob, value): numpy/pandas linear quantiles
    of ``x`` in ``src`` per group, from exact ranks (row_number), with numpy's
    two-sided lerp and pandas' q*100/100 round trip."""
    g = ", ".join(groups)
    gsel = (g + ", ") if groups else ""
    part = f"PARTITION BY {g}" if groups else ""
    on = " AND ".join([f"o.{c} IS NOT DISTINCT FROM i.{c}" for c in groups] + ["o.k = i.i0"])
    on_b = on.replace("o.", "o2.").replace("i.i0", "i.i1")
    qp = ", ".join(repr((p * 100.0) / 100.0) for p in probs)
    pl = ", ".join(repr(float(p)) for p in probs)
    return f"""
{name}_src AS (SELECT {gsel}CAST(x AS DOUBLE) AS x FROM {src} WHERE x IS NOT NULL AND NOT isnan(CAST(x AS DOUBLE))),
{name}_ord AS (SELECT {gsel}x, row_number() OVER ({part} ORDER BY x) - 1 AS k,
                      count(*) OVER ({part}) AS n FROM {name}_src),
{name}_p AS (SELECT unnest([{qp}]::DOUBLE[]) AS qq, unnest([{pl}]::DOUBLE[]) AS prob),
{name}_i AS (
  SELECT {gsel}prob,
         CASE WHEN v >= n - 1 THEN n - 1 ELSE CAST(floor(v) AS BIGINT) END AS i0,
         CASE WHEN v >= n - 1 THEN n - 1 ELSE CAST(floor(v) AS BIGINT) + 1 END AS i1,
         CASE WHEN v >= n - 1 THEN v + 1 ELSE v - floor(v) END AS t
  FROM (SELECT DISTINCT {gsel}n FROM {name}_ord) AS grp,
       LATERAL (SELECT prob, CAST(n - 1 AS DOUBLE) * qq AS v FROM {name}_p) AS pv
),
{name} AS (
  SELECT {", ".join("i." + c for c in groups) + ", " if groups else ""}i.prob,
         CASE WHEN isnan(val) THEN NULL ELSE val END AS value
  FROM (SELECT i.*, CASE WHEN i.t >= 0.5 THEN o2.x - (o2.x - o.x) * (1 - i.t)
                         ELSE o.x + (o2.x - o.x) * i.t END AS val
        FROM {name}_i i JOIN {name}_ord o ON {on} JOIN {name}_ord o2 ON {on_b}) AS i
)"""
