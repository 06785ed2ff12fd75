"""Relational and statistical operators, grouped by business question:
summary (the mart), rankings, inventory, stats, distributions, explore,
quality. Every function takes and returns DataFrames."""
