"""Keys on exact sums: every digit of the sums and their labels is compared, nothing
is put on the check grid."""

from __future__ import annotations

from vendorscope.functions.exact_sum import exact_sums
from vendorscope.functions.text import dollar_label, py_float_repr
from vendorscope.plans.context import VendorContext
from vendorscope.plans.oracle_sql import dollar_label_sql, with_views
from vendorscope.plans.registry import register


def nearest_sql(units: str, bits: int) -> str:
    """The nearest double of a HUGEINT count of 2^-bits: 60 leading bits whose last
    one says whether anything follows, one cast, one exact division."""
    cut = f"greatest(0, CAST(floor(log2(CAST(abs({units}) + 1 AS DOUBLE))) AS INTEGER) - 60)"
    unit = f"CAST(pow(2, {cut}) AS HUGEINT)"
    lead = f"(abs({units}) // {unit})"
    odd = f"greatest({lead} % 2, CASE WHEN abs({units}) % {unit} <> 0 THEN 1 ELSE 0 END)"
    return (f"CAST(CAST({lead} - {lead} % 2 + {odd} AS BIGINT) AS DOUBLE) * pow(2, {cut} - {bits})"
            f" * CASE WHEN {units} < 0 THEN -1 ELSE 1 END")


# Amounts are below 2^24 and not below 2^-7, so 60 binary places hold all of their bits.
@register("vendor_sales_exact", with_views(f"""
SELECT VendorNo, CAST(d AS VARCHAR) AS SalesDollars, CAST(t AS VARCHAR) AS ExciseTax, {dollar_label_sql('d')} AS SalesLabel
FROM (SELECT VendorNo, {nearest_sql('du', 60)} AS d, {nearest_sql('tu', 60)} AS t
      FROM (SELECT VendorNo, sum(CAST(SalesDollars * 1152921504606846976.0::DOUBLE AS HUGEINT)) AS du,
                   sum(CAST(ExciseTax * 1152921504606846976.0::DOUBLE AS HUGEINT)) AS tu FROM sales GROUP BY VendorNo) AS u) AS s"""))
def vendor_sales_exact(ctx: VendorContext):
    sums = exact_sums(ctx.sources.sales, ["VendorNo"], {"d": "SalesDollars", "t": "ExciseTax"})
    return sums.select("VendorNo", py_float_repr("d").alias("SalesDollars"), py_float_repr("t").alias("ExciseTax"),
                       dollar_label("d").alias("SalesLabel"))
