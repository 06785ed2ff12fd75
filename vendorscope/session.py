"""Session helpers: local session for tests/bench, shared checkpoint folder,
and materialisation of intermediate tables.

On a cluster the checkpoint folder is the shared path the cluster names in
``spark.checkpoint.dir`` (a ``file:`` path there must be a mount that all
machines share); it is only invented here (under /tmp) when the session runs in
local mode and nobody has set it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                app_name: str = "vendorscope") -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables.

    Read from the session's ``spark.checkpoint.dir`` (which a remote session
    has too) or, without it, the context's checkpoint folder. Only a local-mode
    session without either gets a fresh folder under /tmp; a cluster session
    without one is an error, because executor-local temporary folders do not
    survive executor loss.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vendorscope-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing
    the joins), fixes every floating-point sum once so thresholds and rows come
    from the same values, and gives the planner exact sizes for later joins.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
