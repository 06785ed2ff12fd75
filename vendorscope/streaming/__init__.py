"""Structured Streaming variant of the extract ingest (the original has no
streaming; this is the incremental form of its directory ingest)."""
