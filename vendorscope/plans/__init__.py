"""Business questions composed from operators: the ``VendorAnalytics``
facade, the analysis context (stored mart), and the query registry with its
DuckDB oracles."""
