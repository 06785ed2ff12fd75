"""Schemas, CSV directory ingest, exports and declared tables, and the
test-data views derived from the star-schema tables."""
