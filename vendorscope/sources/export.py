"""Sinks: the declared summary table (S7), materialising the mart (S8) and
the CSV export of the analysed frame (S9), as a folder of parts or as one file."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StructType

from vendorscope.functions.text import py_float_repr
from vendorscope.sources.csv_ingest import write_table
from vendorscope.session import materialize
from vendorscope.sources.schemas import VENDOR_SALES_SUMMARY, ddl

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOM = "\ufeff"
BLOCK_BYTES = 4 << 20


def create_summary_table(spark: SparkSession, name: str, location: str,
                         schema: StructType = VENDOR_SALES_SUMMARY) -> DataFrame:
    """Declare the 18-column target table (Parquet at ``location``).
    Key columns are declared only; uniqueness is checked by Q3."""
    # the session catalog's Parquet tables cannot be REPLACEd: drop, then create
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({ddl(schema)}) USING parquet LOCATION '{location}'")
    return spark.table(name)


def save_summary(summary: DataFrame, path: str) -> DataFrame:
    """Store the mart (replace) and return the stored table."""
    write_table(summary, path)
    return summary.sparkSession.read.parquet(path)


def pandas_text(df: DataFrame) -> DataFrame:
    """Format every column as ``DataFrame.to_csv`` writes it: floats as
    Python ``str`` (``-inf``, ``1e-05``), booleans as True/False, NULL empty."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(py_float_repr(c))
        elif isinstance(f.dataType, BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        else:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """The UTF-8 CSV export with a byte-order mark, header, no index.

    Written in parallel as one file per partition under ``path``; each part is
    a complete CSV (header and BOM included), so no single task ever holds
    the whole frame. Quotes are doubled, fields are never trimmed, an empty
    string stays empty."""
    text = pandas_text(df)
    first = text.columns[0]
    if bom:
        text = text.withColumnRenamed(first, BOM + first)
    (text.write.mode("overwrite")
         .option("header", True).option("quote", '"').option("escape", '"')
         .option("emptyValue", "").option("nullValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("encoding", "UTF-8").csv(path))


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: each row as ``DataFrame.to_csv`` writes it, with
    quotes only around fields that need them and a line feed at the end."""
    text = pandas_text(df)
    fields = []
    for name in text.columns:
        c = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        fields.append(F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
                      .otherwise(c))
    if len(fields) == 1:                                     # a lone empty field is quoted
        fields = [F.when(fields[0] == "", F.lit('""')).otherwise(fields[0])]
    return text.select(F.concat(F.concat_ws(",", *fields), F.lit("\n")).alias("line"))


def header_line(names: Sequence[str], bom: bool) -> bytes:
    quoted = ['"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\n\r') else n for n in names]
    return ((BOM if bom else "") + ",".join(quoted) + "\n").encode("utf-8")


def blocks_of(block_bytes: int):
    """mapInArrow body: lines -> (part, block, size, data), the task's lines in
    their order, put together to about ``block_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([b"".join(held)], pa.binary())], ["part", "block", "size", "data"])
        for b in batches:
            for line in b.column(0).cast(pa.binary()).to_pylist():
                held.append(line)
                size += len(line)
                if size >= block_bytes:
                    yield out()
                    held, size, block = [], 0, block + 1
        if held:
            yield out()
    return run


def put_blocks(path: str):
    """mapInArrow body: (place, data) -> bytes written at their places of ``path``.
    A task that runs twice writes the same bytes at the same places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for b in batches:
                for place, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    f.seek(place)
                    f.write(data)
                    done += len(data)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])
    return run


def export_csv_file(df: DataFrame, path: str, order: Sequence[str] = (), bom: bool = True,
                    block_bytes: int = BLOCK_BYTES) -> int:
    """S9 as one file: one header, one byte-order mark, all rows, byte for byte
    what ``DataFrame.to_csv(index=False)`` writes; returns its size in bytes.

    Rows come in the order of the columns ``order`` (range partitions), or in
    the order of ``df``'s partitions without. Tasks make blocks of lines; a
    running sum over the sizes (parts first, then blocks within a part) gives
    each block its place, and tasks write them there in parallel. The file has a
    temporary name until all bytes are in it and replaces ``path`` in one rename,
    so readers see the old file or the whole new one. ``path`` must lie in a
    folder that driver and executors share (``file:`` or a plain path); for
    object stores use ``export_csv``."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"one CSV file needs a shared folder, not {path}; export_csv writes parts")
    target = os.path.abspath(path.removeprefix("file:").replace("//", "/"))
    rows = df
    if order:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = materialize(csv_lines(rows).mapInArrow(
        blocks_of(block_bytes), "part int, block long, size long, data binary"), "csv-blocks")
    sizes = made.select("part", "block", "size")
    head = header_line(df.columns, bom)
    # one row a partition of the export
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("part").agg(F.sum("size").alias("all")).select(
        "part", (F.coalesce(F.sum("all").over(before), F.lit(0)) + len(head)).alias("start"))
    places = (sizes.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "part")
              .select("part", "block", (F.col("start") + F.col("at")).alias("place")))
    total = len(head) + (sizes.agg(F.sum("size").alias("n")).first()["n"] or 0)
    unfinished = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with open(unfinished, "wb") as f:
            f.write(head)
            f.truncate(total)
        done = (made.select("part", "block", "data").join(places, ["part", "block"]).select("place", "data")
                .mapInArrow(put_blocks(unfinished), "done long").agg(F.sum("done").alias("n")).first()["n"] or 0)
        if len(head) + done != total:
            raise RuntimeError(f"{len(head) + done} of {total} bytes were written to {unfinished}")
        os.replace(unfinished, target)
    finally:
        if os.path.exists(unfinished):
            os.remove(unfinished)
    return total
