"""The analysis context: sources, the materialised mart, and its clean subset.

Every business question reads the same materialised ``vendor_sales_summary``
(as the original reads one stored table). Materialising once means quantile
thresholds and the rows compared against them come from the same stored
doubles, and a lost executor re-reads Parquet instead of redoing the joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vendorscope.operators.inventory import final_frame
from vendorscope.operators.rankings import brand_performance_stored
from vendorscope.operators.summary import clean_summary_columns, consistent_rows, freight_summary, vendor_summary_raw
from vendorscope.session import materialize
from vendorscope.sources.fixtures import VendorSources, edge_sources, vendor_sources


@dataclass
class VendorContext:
    spark: SparkSession
    sources: VendorSources
    _raw: DataFrame | None = field(default=None, repr=False)
    _summary: DataFrame | None = field(default=None, repr=False)
    _analysis: DataFrame | None = field(default=None, repr=False)
    _brands: DataFrame | None = field(default=None, repr=False)
    _edge: "VendorContext | None" = field(default=None, repr=False)

    def _raw_rows(self) -> DataFrame:
        """The raw columns as a plan over the extracts; only the freight per
        vendor is stored, so its size is known to the planner."""
        s = self.sources
        freight = s.freight_totals if s.freight_totals is not None else freight_summary(s.vendor_invoice)
        return vendor_summary_raw(s.purchases, s.purchase_prices, s.vendor_invoice, s.sales, totals=s.purchase_totals,
                                  freight=materialize(freight, "freight_by_vendor"))

    @property
    def summary_raw(self) -> DataFrame:
        """The 14 raw columns before cleaning (materialised on first use)."""
        if self._raw is None:
            self._raw = materialize(self._raw_rows(), "vendor_summary_raw")
        return self._raw

    @property
    def summary(self) -> DataFrame:
        """The 18-column cleaned mart, all rows (materialised on first use, from
        the raw columns if they are stored; they are not stored for it)."""
        if self._summary is None:
            raw = self._raw if self._raw is not None else self._raw_rows()
            self._summary = materialize(clean_summary_columns(raw), "vendor_sales_summary")
        return self._summary

    @property
    def clean(self) -> DataFrame:
        """the consistent rows all later questions analyse."""
        return consistent_rows(self.summary)

    @property
    def analysis(self) -> DataFrame:
        """The clean rows with UnitPurchasePrice, OrderSize and
        UnsoldInventoryValue (the analysed, exported frame), materialised
        once: OrderSize depends on quantile edges of the whole frame, and
        every order-size question then reads stored labels."""
        if self._analysis is None:
            self._analysis = materialize(final_frame(self.clean), "vendor_analysis")
        return self._analysis

    @property
    def edge(self) -> "VendorContext":
        """The analysis over the extracts with edge cases."""
        if self._edge is None:
            self._edge = VendorContext(self.spark, edge_sources(self.sources))
        return self._edge

    @property
    def brands(self) -> DataFrame:
        """Brand performance (A14), stored once for the threshold questions."""
        if self._brands is None:
            self._brands = brand_performance_stored(self.clean)
        return self._brands


_CONTEXTS: dict[tuple[int, str], VendorContext] = {}


def context_for(spark: SparkSession, sf_dir: str) -> VendorContext:
    """One context per (session, data folder): the mart is built once and
    every registered query of that session reads it. A folder whose tables
    change needs ``forget`` before the next query."""
    key = (id(spark), sf_dir.rstrip("/"))
    ctx = _CONTEXTS.get(key)
    if ctx is not None and (ctx.spark is not spark or spark.sparkContext._jsc is None):
        ctx = None                       # a stopped or replaced session: rebuild
    if ctx is None:
        ctx = VendorContext(spark, vendor_sources(spark, sf_dir))
        _CONTEXTS[key] = ctx
    return ctx


def forget(sf_dir: str | None = None) -> None:
    """Drop the contexts of a folder (or all): the next query reads its
    tables as they are then. Stored tables stay where they are."""
    for key in [k for k in _CONTEXTS if sf_dir is None or k[1] == sf_dir.rstrip("/")]:
        del _CONTEXTS[key]
