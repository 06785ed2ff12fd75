"""The public facade: a full run from CSV extracts on disk to the export."""

import glob
import os

from pyspark.sql import functions as F

from tests.conftest import SF001
from vendorscope.plans.analytics import VendorAnalytics
from vendorscope.sources.csv_ingest import ingest_directory
from vendorscope.sources.export import export_csv
from vendorscope.sources.fixtures import vendor_sources


def test_csv_to_answers_round_trip(spark, tmp_dir):
    # write the four extracts as CSV (one file per table), ingest, analyse
    data = os.path.join(tmp_dir, "data")
    for name, df in vendor_sources(spark, SF001).as_dict().items():
        export_csv(df.coalesce(1), os.path.join(tmp_dir, "csv", name), bom=False)
        part = glob.glob(os.path.join(tmp_dir, "csv", name, "part-*.csv"))[0]
        os.makedirs(data, exist_ok=True)
        os.link(part, os.path.join(data, f"{name}.csv"))
    report = ingest_directory(spark, data, os.path.join(tmp_dir, "tables"))
    assert report.count() == 4
    va = VendorAnalytics.from_tables(spark, os.path.join(tmp_dir, "tables"))
    mart = va.build_mart(os.path.join(tmp_dir, "tables", "vendor_sales_summary"))
    assert mart.count() == 925
    assert va.clean.count() == 404
    assert va.brand_targets().count() == 6
    th = va.brand_thresholds().first()
    assert abs(th.LowSalesThreshold - 311643.385) < 1e-3 and abs(th.HighMarginThreshold - 59.630863) < 1e-5
    assert {r.OrderSize for r in va.bulk_purchase_boxplot().collect()} == {"Small", "Medium", "Large"}
    assert va.top_vendors(1).first().VendorName == "Supplier#000000005"
    ci = {r.segment: r for r in va.margin_confidence_intervals().collect()}
    assert abs(ci["top"].lower - 45.382562) < 1e-5
    assert va.margin_welch_test().first().reject_h0 is False
    assert va.bulk_purchase_effect().agg(F.sum("Rows")).first()[0] == 404
    parts = {"describe", "histogram", "kde", "boxplot", "categories"}
    assert set(va.profile()) == parts and set(va.profile_consistent()) == parts | {"correlation"}
    count = {r.column_name: r["count"] for r in va.profile_consistent()["describe"].collect()}
    assert count["ProfitMargin"] == 404
    assert {r.table_name for r in va.tables().collect()} == {"purchases", "purchase_prices", "vendor_invoice", "sales"}
    assert va.preview("sales").count() == 5 and va.preview("purchase_prices", 2).count() == 2
    v = va.explore_vendor()
    assert v["purchases"].select("VendorNumber").distinct().count() == 1
    va.export(os.path.join(tmp_dir, "final_csv"))
    assert glob.glob(os.path.join(tmp_dir, "final_csv", "part-*.csv"))
