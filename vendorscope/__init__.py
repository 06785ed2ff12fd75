"""vendorscope: vendor and inventory analytics as lazy Spark DataFrame jobs.

Layout
------
sources/    explicit schemas, CSV directory ingest, catalog profile, exports,
            and the test-data views built from the star-schema tables
functions/  column expressions (IEEE division, Python-compatible strip,
            rounding and labels), exact bounded quantiles, Student t
operators/  the relational and statistical operators, grouped by question
plans/      business questions composed from operators, and the query
            registry used by ``__spark_entry__``
streaming/  incremental (file-stream) variant of the directory ingest
"""

from vendorscope.plans.analytics import VendorAnalytics
from vendorscope.session import checkpoint_root, get_session, materialize

__all__ = ["VendorAnalytics", "checkpoint_root", "get_session", "materialize"]
