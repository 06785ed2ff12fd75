"""Directory ingest of CSV extracts.

Each ``<table>.csv`` in a folder becomes a Parquet table ``<table>`` (replace
semantics). Files are listed with Spark's ``binaryFile`` source (metadata
only, any Hadoop file system), read with a header and all-string columns,
the pandas missing-value tokens are mapped to NULL, and columns are cast to
the explicit schema when the table is known, or to the type pandas would
infer (one aggregate pass) when it is not. Every table is one distributed
read + write; the driver only sees file names and a per-table report.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vendorscope.sources.csv_records import csv_records
from vendorscope.sources.schemas import SOURCE_SCHEMAS

# The strings pandas' read_csv treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Boolean spellings pandas recognises.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


#: RFC 4180 as pandas reads and writes it, for Spark's CSV reader.
DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
           "nullValue": "", "emptyValue": ""}


def list_csv_files(spark: SparkSession, data_dir: str) -> list[tuple[str, str]]:
    """(table name, path) for each ``*.csv`` directly inside ``data_dir``
    (a true suffix test: ``a.csv.bak`` is not an extract), sorted by name."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "false").load(data_dir).select("path"))
    out = []
    for row in files.collect():          # file names only, never file content
        name = row.path.rstrip("/").rsplit("/", 1)[-1]
        out.append((name[:-len(".csv")], row.path))
    return sorted(out)


def na_to_null(c: Column, tokens=NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


# Text that pandas reads as a number (a decimal number with an
# optional exponent, or an infinity; surrounding blanks are allowed).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def read_csv_strings(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Header row, every column as text, pandas' NA tokens as NULL.

    Quoting follows RFC 4180, as pandas and ``export_csv`` write it: a quote
    inside a quoted field is doubled, a backslash is an ordinary character.
    Short rows are filled with NULL; a row with more fields than the header
    fails the job. Line breaks inside quotes are found by a first scan and such
    files are read by splits like others (``csv_records``). ``multiline=True``
    reads with Spark's own reader instead, one task a file; with ``False`` the first
    scan is saved, and a field still open at the end of a line fails the job.
    """
    records = csv_records(spark, path) if multiline is None else None

    def reader():
        whole = multiline or records is not None
        return (spark.read.options(**DIALECT).option("header", True).option("inferSchema", False)
                .option("multiLine", whole))
    columns = reader().csv(path).columns
    bad = "_corrupt_line"
    while bad in columns:
        bad = "_" + bad
    schema = StructType([*[StructField(c, StringType()) for c in columns], StructField(bad, StringType())])
    permissive = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    if records is not None:
        raw = records.select(F.from_csv("record", schema.toDDL(), DIALECT | permissive).alias("r")).select("r.*")
    else:
        raw = reader().options(**permissive).option("enforceSchema", True).schema(schema).csv(path)
    line = F.col(f"`{bad}`")
    # a short row is corrupt to the reader too; what it may not be is too long, or open-ended
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    unquoted = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    fault = (F.when(quotes % 2 == 1, F.concat(F.lit("a quoted field is open at the end of a line "
                                                    "(line breaks inside quotes need multiline=None or True): "), line))
             .when(fields > len(columns), F.concat(F.lit(f"more than {len(columns)} fields: "), line)))
    checked = raw.withColumn(bad, F.when(fault.isNotNull(), F.raise_error(fault).cast("string")))
    # the check rides on the first column, so column pruning cannot drop it
    first, rest = columns[0], columns[1:]
    kept = F.when(F.col(f"`{bad}`").isNull(), F.col(f"`{first}`"))
    return checked.select(na_to_null(kept).alias(first), *[na_to_null(F.col(f"`{c}`")).alias(c) for c in rest])


def cast_to_schema(df: DataFrame, schema: StructType, lenient: bool = False) -> DataFrame:
    """Cast text columns to ``schema`` (missing columns become NULL). Strict
    casts fail the job on bad text, as pandas' ``astype`` raises;
    ``lenient`` turns bad text into NULL instead (``try_cast``)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f"`{f.name}`")
            cols.append((c.try_cast(f.dataType) if lenient else c.cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def infer_pandas_types(df: DataFrame) -> DataFrame:
    """pandas' default column typing, from one aggregate pass: integers
    (float if any value is missing), floats, booleans, else text."""
    if not df.columns:
        return df
    checks = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        checks += [
            F.count_if(v.isNotNull() & (~v.rlike(INTEGER_PATTERN) | v.try_cast("bigint").isNull())).alias(f"notint_{i}"),
            F.count_if(v.isNotNull() & ~v.rlike(NUMBER_PATTERN)).alias(f"notnum_{i}"),
            F.count_if(v.isNotNull() & ~v.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"notbool_{i}"),
            F.count_if(v.isNull()).alias(f"nulls_{i}"),
            F.count(v).alias(f"vals_{i}"),
        ]
    stats = df.agg(*checks).first()      # one row of counters
    cols = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        if stats[f"vals_{i}"] == 0:
            cols.append(v.cast("double").alias(c))          # all missing: float NaN column
        elif stats[f"notint_{i}"] == 0:
            cols.append(v.cast("bigint" if stats[f"nulls_{i}"] == 0 else "double").alias(c))
        elif stats[f"notnum_{i}"] == 0:
            cols.append(v.cast("double").alias(c))
        elif stats[f"notbool_{i}"] == 0 and stats[f"nulls_{i}"] == 0:
            cols.append(v.isin(*TRUE_TOKENS).alias(c))
        else:
            cols.append(v.alias(c))
    return df.select(*cols)


def read_extract(spark: SparkSession, path: str, schema: StructType | None = None,
                 lenient: bool = False, multiline: bool | None = None) -> DataFrame:
    """One CSV extract as a typed DataFrame."""
    text = read_csv_strings(spark, path, multiline)
    return cast_to_schema(text, schema, lenient) if schema is not None else infer_pandas_types(text)


def _norm_path(p: str) -> str:
    """'file:///a/b/' and '/a/b' compare equal; other schemes keep theirs."""
    if p.startswith("file:"):
        p = "/" + p[len("file:"):].lstrip("/")
    return p.rstrip("/")


def _scan_roots(df: DataFrame) -> list[str]:
    """Root paths of the file scans under ``df`` (one entry a scan, however
    many files it reads)."""
    if not hasattr(df, "_jdf"):
        return df.inputFiles()                      # a remote session has no plan to look into
    roots = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                roots += [paths.apply(k).toString() for k in range(paths.size())]
    return roots


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Have ``write`` fill a new folder beside ``path`` and, once it is whole, put
    it in the place of ``path`` by two renames. Both the new folder and the one
    put aside have names that readers of the parent folder pass over.

    If ``write`` fails, or the driver dies in it, ``path`` is what it was. A folder
    that a driver's death between the renames left aside is put back by the
    next call. One writer at a time; where a rename copies (object stores) the
    swap takes that long. A remote session, which cannot rename, has ``write``
    go to ``path`` itself."""
    if not hasattr(spark, "_jvm"):
        write(path)
        return
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(path_of(path))
    parent, name = target.getParent(), target.getName()
    new = path_of(parent, f"_{name}.{uuid.uuid4().hex}.new")
    aside = path_of(parent, f"_{name}.replaced")
    if fs.exists(aside) and not fs.exists(target) and not fs.rename(aside, target):
        raise OSError(f"cannot put {aside} back to {target}")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    if fs.exists(aside):                             # left by a driver that died after both renames
        fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot put {target} aside; the new table is in {new}")
    if not fs.rename(new, target):
        fs.rename(aside, target)
        raise OSError(f"cannot rename {new} to {target}")
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def write_table(df: DataFrame, path: str, table: str | None = None) -> None:
    """Replace the table at ``path`` (Parquet); with ``table``, also
    register it in the catalog under that name. Refuses to overwrite a table
    the DataFrame is still reading from. A job that fails leaves the table as it was."""
    target = _norm_path(path)
    if any(_norm_path(f) == target or _norm_path(f).startswith(target + "/") or target.startswith(_norm_path(f) + "/")
           for f in _scan_roots(df)):
        raise ValueError(f"refusing to overwrite {path}: the DataFrame reads from it")
    spark = df.sparkSession
    replace_folder(spark, path, df.write.mode("overwrite").parquet)
    if table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, path=path, source="parquet")


def ingest_directory(spark: SparkSession, data_dir: str, out_dir: str,
                     schemas: Mapping[str, StructType] = SOURCE_SCHEMAS,
                     lenient: bool = False, multiline: bool | None = None, register: bool = False) -> DataFrame:
    """S1 + S10: ingest every extract in ``data_dir`` into ``out_dir/<table>``
    and return the run report (table, file, rows, seconds, total minutes).
    ``register`` also makes every table a catalog table of its name (S3, S5)."""
    report = []
    t_all = time.time()
    for table, path in list_csv_files(spark, data_dir):
        t0 = time.time()
        obs = Observation(f"ingest_{table}")
        df = read_extract(spark, path, schemas.get(table), lenient, multiline).observe(
            obs, F.count(F.lit(1)).alias("rows"))
        write_table(df, f"{out_dir.rstrip('/')}/{table}", f"`{table}`" if register else None)
        report.append((table, path, int(obs.get["rows"]), round(time.time() - t0, 3)))
    total_min = (time.time() - t_all) / 60.0
    return spark.createDataFrame(
        [(t, p, r, s, total_min) for t, p, r, s in report],
        "table_name string, file string, rows long, seconds double, total_minutes double")
