"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorscope.session import materialize


def by_value(module: str) -> None:
    """Pickle a module's functions by value: executors then need only the
    third-party packages, not this one, on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of an Arrow batch while a table is stored: whole texts, so fewer than
#: the default, which bounds what a Python worker holds.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch_rows: int | None = BATCH_ROWS) -> DataFrame:
    """Write once under the shared checkpoint folder, read back (lineage cut)."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH_CONF)
    if batch_rows:
        spark.conf.set(_BATCH_CONF, str(min(int(before), batch_rows) if int(before) > 0 else batch_rows))
    try:
        return materialize(df, f"llm-{name}")
    finally:
        spark.conf.set(_BATCH_CONF, before)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_number() -> int:
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx is not None else 0


def worker_kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time in this Python worker: Spark reuses
    workers, so a table that is costly to build serves all of a worker's tasks.
    One table is kept, that of the last key. Only for caches: a fresh worker
    builds its own and gets the same results."""
    module = sys.modules.setdefault("_vendorscope_worker", ModuleType("_vendorscope_worker"))
    if getattr(module, "key", None) != key:
        module.key = module.value = None
        module.value = make()
        module.key = key
    return module.value


def free_worker() -> None:
    """Give up what ``worker_kept`` holds; other operators' first passes call
    it, so a table does not outlive its operator in a reused worker."""
    sys.modules.pop("_vendorscope_worker", None)
    trim_memory()


def trim_memory() -> None:
    """Give freed memory back to the system, where the C library has a call for
    that: a reused worker otherwise keeps the most it ever held."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
