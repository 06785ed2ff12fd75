"""The public API: one object per analysis, one method per business question.

    spark = vendorscope.get_session()
    va = VendorAnalytics.from_tables(spark, "/data/tables")     # ingested extracts
    va.build_mart("/data/tables/vendor_sales_summary")          # B1, stored
    va.top_vendors().show(); va.margin_confidence_intervals().show()

Every method returns a DataFrame. ``summary``, ``clean`` and what builds on
the stored mart, brand table or analysed frame write those tables on first
use; questions that need exact quantiles run their aggregates when called (a
few numbers per column reach the driver). ``export`` writes files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vendorscope.operators import distributions as D
from vendorscope.operators import explore as X
from vendorscope.operators import inventory as I
from vendorscope.operators import quality as QL
from vendorscope.operators import rankings as R
from vendorscope.operators import stats as ST
from vendorscope.operators import summary as S
from vendorscope.plans.context import VendorContext
from vendorscope.session import materialize
from vendorscope.sources.csv_ingest import write_table
from vendorscope.sources.export import export_csv, export_csv_file
from vendorscope.sources.fixtures import VendorSources, vendor_sources


class VendorAnalytics:
    def __init__(self, spark: SparkSession, sources: VendorSources):
        self.spark = spark
        self.ctx = VendorContext(spark, sources)

    # ------------------------------------------------------------ inputs --
    @classmethod
    def from_tables(cls, spark: SparkSession, tables_dir: str) -> "VendorAnalytics":
        """The four extracts as stored by ``ingest_directory``."""
        def t(name: str) -> DataFrame:
            return spark.read.parquet(f"{tables_dir.rstrip('/')}/{name}")
        return cls(spark, VendorSources(t("purchases"), t("purchase_prices"), t("vendor_invoice"), t("sales")))

    @classmethod
    def from_star_schema(cls, spark: SparkSession, sf_dir: str) -> "VendorAnalytics":
        """The extracts derived from the star-schema test tables."""
        return cls(spark, vendor_sources(spark, sf_dir))

    # ---------------------------------------------------------------- B1 --
    def build_mart(self, path: str | None = None, exact: bool = False) -> DataFrame:
        """B1: build the vendor x brand summary and store it (at ``path``, or
        under the session's checkpoint folder); later questions read it.
        ``exact``: sums that do not depend on how the extracts are partitioned."""
        if exact:
            s = self.ctx.sources
            self.ctx._raw = materialize(S.vendor_summary_raw(
                s.purchases, s.purchase_prices, s.vendor_invoice, s.sales, exact=True), "vendor_summary_exact")
            self.ctx._summary = self.ctx._brands = self.ctx._analysis = None
        if path is None:
            return self.ctx.summary
        write_table(S.clean_summary_columns(self.ctx.summary_raw), path)
        self.ctx._summary = self.spark.read.parquet(path)
        self.ctx._brands = self.ctx._analysis = None       # derived from the old mart
        return self.ctx._summary

    @property
    def summary(self) -> DataFrame:
        return self.ctx.summary

    @property
    def clean(self) -> DataFrame:
        return self.ctx.clean

    # ----------------------------------------------------------- B2 - B8 --
    def brand_thresholds(self, low_sales_q: float = 0.15, high_margin_q: float = 0.85) -> DataFrame:
        return R.brand_thresholds(self.ctx.brands, low_sales_q, high_margin_q)

    def brand_targets(self, low_sales_q: float = 0.15, high_margin_q: float = 0.85) -> DataFrame:
        return R.target_brands(self.clean, low_sales_q, high_margin_q, brands=self.ctx.brands)

    def brand_scatter(self, max_sales: float = 10_000.0) -> DataFrame:
        return R.brand_scatter(self.clean, max_sales, brands=self.ctx.brands)

    def top_vendors(self, k: int = 10) -> DataFrame:
        return R.top_vendors_by_sales(self.clean, k)

    def top_brands(self, k: int = 10) -> DataFrame:
        return R.top_brands_by_sales(self.clean, k)

    def purchase_pareto(self, k: int = 10) -> DataFrame:
        return R.vendor_pareto(self.clean, k)

    def vendor_dependency(self, k: int = 10) -> DataFrame:
        return R.vendor_dependency(self.clean, k)

    def bulk_purchase_effect(self) -> DataFrame:
        return I.unit_price_by_order_size(self.clean, self.ctx.analysis)

    def bulk_purchase_boxplot(self) -> DataFrame:
        return D.boxplot_stats(self.ctx.analysis, ["UnitPurchasePrice"], by=["OrderSize"])

    def slow_vendors(self, k: int = 10) -> DataFrame:
        return I.slow_vendors(self.clean, k)

    def unsold_capital(self) -> DataFrame:
        return I.unsold_total(self.clean)

    def unsold_by_vendor(self, k: int = 10) -> DataFrame:
        return I.unsold_by_vendor(self.clean, k)

    # ---------------------------------------------------------- B9, B10 --
    def margin_confidence_intervals(self, confidence: float = 0.95) -> DataFrame:
        return ST.margin_confidence_intervals(self.clean, confidence)

    def margin_welch_test(self, alpha: float = 0.05) -> DataFrame:
        return ST.welch_test(self.clean, alpha)

    # --------------------------------------------------------------- B11 --
    def profile(self) -> dict[str, DataFrame]:
        """The first profile, over the whole mart."""
        return self._profile(self.summary)

    def profile_consistent(self) -> dict[str, DataFrame]:
        """The second profile, over the consistent rows, with the correlations."""
        return self._profile(self.clean) | {"correlation": ST.correlation_matrix(self.clean)}

    @staticmethod
    def _profile(df: DataFrame) -> dict[str, DataFrame]:
        return {"describe": ST.describe(df), "histogram": D.histogram(df), "kde": D.kde(df),
                "boxplot": D.boxplot_stats(df), "categories": D.category_counts(df)}

    # --------------------------------------------------------------- B12 --
    def tables(self) -> DataFrame:
        """The source tables with their row and column counts."""
        return X.table_profile(self.ctx.sources.as_dict())

    def preview(self, table: str, n: int = 5) -> DataFrame:
        """``n`` rows of a source table."""
        return X.preview(self.ctx.sources.as_dict()[table], n)

    def explore_vendor(self, vendor=None) -> dict[str, DataFrame]:
        """One vendor across the four extracts (default: the busiest vendor
        present in the price list), with its per-brand rollups."""
        s = self.ctx.sources
        v = vendor if vendor is not None else X.most_active_vendor(s.purchases, s.purchase_prices)
        rows = {name: X.vendor_rows(df, name, v) for name, df in s.as_dict().items()}
        rows["purchases_by_brand_price"] = X.purchases_by_brand_price(rows["purchases"], by_vendor=False)
        rows["sales_by_brand"] = X.sales_by_brand(rows["sales"], by_vendor=False)
        rows["distinct_po"] = X.distinct_po(rows["vendor_invoice"], by_vendor=False)
        return rows

    def quality(self) -> dict[str, DataFrame]:
        s = self.ctx.sources
        return {"anomalies": QL.anomaly_profile(self.summary),
                "keys": QL.key_uniqueness({
                    "purchase_prices": (s.purchase_prices, ["VendorNumber", "Brand"]),
                    "vendor_invoice": (s.vendor_invoice, ["VendorNumber", "PONumber"]),
                    "vendor_sales_summary": (self.summary, ["VendorNumber", "Brand"])}),
                "tables": self.tables()}

    # --------------------------------------------------------------- B13 --
    def export(self, path: str, one_file: bool = False) -> None:
        """The analysed frame (21 columns) as UTF-8 CSV with a BOM: a folder of
        parts, or one file by vendor and brand in a folder that all machines share."""
        if one_file:
            export_csv_file(self.ctx.analysis, path, ["VendorNumber", "Brand", "VendorName", "Description"])
        else:
            export_csv(self.ctx.analysis, path)
