"""Global order as a column (O1, O2, O7): every row's place in the whole table,
without a window over all rows in one task.

Rows are range partitioned by the order (the sort's sampled bounds; tie-breaking
columns are part of it, so many rows of one sort key still spread), sorted
within their partitions and stored with their place there. A running sum over
the partitions' sizes, one row a partition, then turns places into ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorscope.session import materialize

#: ``monotonically_increasing_id`` keeps the place within a partition in its low bits.
PLACE_BITS = 33


def with_rank(df: DataFrame, order: Sequence[Column], ties: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1 for the first row by ``order``, then by the
    ``ties`` columns. Rows equal in all of these take neighbouring ranks in
    any order; an empty table stays empty."""
    placed = df.orderBy(*order, *[F.col(f"`{c}`").asc_nulls_first() for c in ties]).withColumn(
        "_at", F.monotonically_increasing_id())
    stored = materialize(placed, "ranked").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition of the sort
    sizes = (stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (stored.join(F.broadcast(sizes), "_part")
            .withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before"))
