"""Sources and sinks: CSV extract typing and NA tokens (Fixture §6), the
directory ingest report, the declared table, the BOM CSV export, and the
incremental file-stream ingest."""

import glob
import io
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vendorscope.operators.explore import catalog_profile
from vendorscope.sources import csv_ingest as CI
from vendorscope.sources import export as EX
from vendorscope.sources import schemas
from vendorscope.streaming.csv_stream import start_extract_stream

FIXTURE_CSV = 'a,b,c\n1,NA,x\n2,,NULL\n3,2.5," y "\n'


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_na_tokens_and_typing_match_read_csv(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    write(path, FIXTURE_CSV)
    df = CI.read_extract(spark, path)
    exp = pd.read_csv(io.StringIO(FIXTURE_CSV))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    rows = df.orderBy("a").collect()
    assert [r.b for r in rows] == [None, None, 2.5]
    assert [r.c for r in rows] == [None if pd.isna(v) else v for v in exp["c"]] == ["x", None, " y "]


def test_explicit_schema_strict_and_lenient(spark, tmp_dir):
    path = os.path.join(tmp_dir, "purchase_prices.csv")
    write(path, "VendorNumber,Brand,Price,Volume\n1,10,9.5,750\n2,20,bad,NA\n")
    strict = CI.read_extract(spark, path, schemas.PURCHASE_PRICES)
    try:
        strict.collect()
        raised = False
    except Exception:  # noqa: BLE001 - ANSI cast error, as astype raises
        raised = True
    assert raised
    lenient = CI.read_extract(spark, path, schemas.PURCHASE_PRICES, lenient=True).orderBy("VendorNumber").collect()
    assert [r.Price for r in lenient] == [9.5, None]
    assert lenient[1].Volume is None and lenient[0].Description is None


def test_ingest_directory_report(spark, tmp_dir):
    data = os.path.join(tmp_dir, "data")
    os.makedirs(data)
    write(os.path.join(data, "sales.csv"),
          "VendorNo,Brand,SalesQuantity,SalesDollars,SalesPrice,ExciseTax\n1,10,2,20.0,10.0,0.5\n1,11,1,5,5,NA\n")
    write(os.path.join(data, "extra.csv"), FIXTURE_CSV)
    write(os.path.join(data, "notes.csv.bak"), "x\n1\n")
    out = os.path.join(tmp_dir, "tables")
    report = {r.table_name: r for r in CI.ingest_directory(spark, data, out).collect()}
    assert set(report) == {"extra", "sales"}
    assert report["sales"].rows == 2 and report["extra"].rows == 3
    sales = spark.read.parquet(os.path.join(out, "sales"))
    assert [(f.name, f.dataType) for f in sales.schema] == [(f.name, f.dataType) for f in schemas.SALES]
    assert sales.agg(F.sum("SalesDollars")).first()[0] == 25.0


def test_write_table_refuses_to_overwrite_its_input(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    spark.range(3).write.parquet(path)
    df = spark.read.parquet(path)
    try:
        CI.write_table(df, path)
        ok = False
    except ValueError:
        ok = True
    assert ok


def test_replaced_tables_are_old_or_new(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tables", "t")
    ids = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    CI.write_table(spark.range(3), path)
    held = spark.read.parquet(path)
    with pytest.raises(Exception):                                      # some tasks wrote, one failed
        CI.write_table(spark.range(40).selectExpr("if(id = 33, raise_error('x'), id) AS id"), path)
    assert ids() == [0, 1, 2] and held.count() == 3
    CI.write_table(spark.range(5), path)
    assert ids() == [0, 1, 2, 3, 4] and spark.read.parquet(path).count() == 5
    assert os.listdir(os.path.dirname(path)) == ["t"]
    aside = os.path.join(os.path.dirname(path), "_t.replaced")          # as if the driver died between the renames
    os.rename(path, aside)
    with pytest.raises(Exception):
        CI.write_table(spark.range(9).selectExpr("if(id = 3, raise_error('x'), id) AS id"), path)
    assert ids() == [0, 1, 2, 3, 4] and os.listdir(os.path.dirname(path)) == ["t"]


def test_declared_table(spark, tmp_dir):
    t = EX.create_summary_table(spark, "vendor_sales_summary_decl", os.path.join(tmp_dir, "decl"))
    assert [f.name for f in t.schema] == [f.name for f in schemas.VENDOR_SALES_SUMMARY]
    spark.sql("DROP TABLE IF EXISTS vendor_sales_summary_decl")


def test_export_csv_round_trip_with_bom(spark, tmp_dir):
    df = spark.createDataFrame(
        [(1, "A, Inc", float("-inf"), 1e-05, True), (2, 'say "hi"', None, 500.0, False), (3, "", 2.5, -12345678.5, None)],
        "id long, name string, margin double, x double, flag boolean")
    out = os.path.join(tmp_dir, "export")
    EX.export_csv(df, out)
    parts = sorted(glob.glob(os.path.join(out, "part-*.csv")))
    frames = []
    for p in parts:
        raw = open(p, "rb").read()
        if not raw:
            continue
        assert raw.startswith("\ufeff".encode("utf-8") + b"id,")
        frames.append(pd.read_csv(p, encoding="utf-8-sig", keep_default_na=False, dtype=str))
    got = pd.concat(frames).sort_values("id")
    exp = pd.DataFrame({"id": [1, 2, 3], "name": ["A, Inc", 'say "hi"', ""],
                        "margin": [float("-inf"), None, 2.5], "x": [1e-05, 500.0, -12345678.5],
                        "flag": [True, False, None]})
    buf = io.StringIO()
    exp.to_csv(buf, index=False)
    want = pd.read_csv(io.StringIO(buf.getvalue()), keep_default_na=False, dtype=str)
    assert got.reset_index(drop=True).equals(want)


def test_incremental_stream_ingest(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    out, ckpt = os.path.join(tmp_dir, "stream_out"), os.path.join(tmp_dir, "stream_ckpt")
    header = "VendorNumber,PONumber,Quantity,Dollars,Freight\n"
    write(os.path.join(src, "vendor_invoice_1.csv"), header + "1,100,5,50.0,1.5\n2,200,1,NA,0.5\n")
    q = start_extract_stream(spark, src, schemas.VENDOR_INVOICE, out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    write(os.path.join(src, "vendor_invoice_2.csv"), header + "3,300,2,20.0,1.0\n")
    q = start_extract_stream(spark, src, schemas.VENDOR_INVOICE, out, ckpt)
    q.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 3                           # each file exactly once
    assert df.filter(F.col("Dollars").isNull()).count() == 1


def test_catalog_profile_lists_tables(spark, tmp_dir):
    from vendorscope.operators.explore import catalog_profile, preview
    loc = os.path.join(tmp_dir, "decl2")
    t = EX.create_summary_table(spark, "vendor_sales_summary_cat", loc)
    spark.range(3).createOrReplaceTempView("not_a_table")       # temporary views are skipped
    prof = {r.table_name: r for r in catalog_profile(spark).collect()}
    assert "vendor_sales_summary_cat" in prof and "not_a_table" not in prof
    assert prof["vendor_sales_summary_cat"].row_count == 0
    assert prof["vendor_sales_summary_cat"].column_count == len(schemas.VENDOR_SALES_SUMMARY.fields)
    assert preview(spark.range(10)).count() == 5 and t is not None
    spark.sql("DROP TABLE IF EXISTS vendor_sales_summary_cat")


CSV_VECTORS = [
    ('a,b,c\n1,"say ""hi""",5\n2,"a ""b"", c",6\n', False),            # doubled quotes, a comma inside
    ('a,b,c\n1,"end\\",5\n2,"c:\\dir\\",6\n', False),              # a backslash before the closing quote
    ('a,b,c\n1,"two\nlines",5\n2,x,6\n', True),                      # a line break inside quotes
    ('id,x,y\n1,2\n2,3,4\n', False),                                 # a short row
    ('a,b\n1,1D\n2,2F\n', False),                                    # codes that Java reads as numbers
    ('a,b\n1,0x1p3\n2,1_000\n', False),
    ('a,b\n1, 2.5 \n2,-3e2\n3,inf\n', False),
    ('a,b\n"1",""\n2,"NA"\n', False),
]


@pytest.mark.parametrize("text, multiline", CSV_VECTORS)
def test_csv_dialect_as_pandas(spark, tmp_dir, text, multiline):
    path = os.path.join(tmp_dir, "t.csv")
    write(path, text)
    want = pd.read_csv(io.StringIO(text))
    kinds = {"i": "bigint", "f": "double", "O": "string", "b": "boolean"}
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    for way in (multiline, None):
        got = CI.read_extract(spark, path, multiline=way)
        assert dict(got.dtypes) == {c: kinds.get(want[c].dtype.kind, "string") for c in want.columns}
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("end, split", [("\n", 64), ("\r\n", 64), ("\n", 1000), ("\n", 1 << 20)])
def test_quoted_line_breaks_by_splits(spark, tmp_dir, end, split):
    """Files cut into splits of a few bytes: records across one or many
    splits, splits without a line start or wholly inside quotes."""
    import random
    rng = random.Random(split)
    data = os.path.join(tmp_dir, "data")
    os.makedirs(data)
    want = []
    for f in range(3):
        rows = []
        for i in range(150):
            note = rng.choice(["plain", "", "a, b", 'say "hi"', "two\nlines", "\n\n", '"\n"', 'x""\n,"y', "long\n" * 60, "w" * 300])
            rows.append((f * 1000 + i, note, rng.random()))
        with open(os.path.join(data, f"part{f}.csv"), "w", encoding="utf-8", newline="") as out:
            out.write('id,"no\nte",x'.replace("\n", "") + end)
            for i, note, x in rows:
                quoted = '"' + note.replace('"', '""') + '"' if any(c in note for c in ',"\n') else note
                out.write(f"{i},{quoted},{x!r}{end}" + (end if i % 40 == 0 else ""))
        want += [(i, note or None, x) for i, note, x in rows]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = CI.read_extract(spark, data)
        assert got.columns == ["id", "note", "x"] and got.dtypes[0][1] == "bigint"
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert got.rdd.getNumPartitions() > 1 or split > 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_prefix_scan_of_splits():
    """A record open over two splits; a split that closes one and opens another."""
    from collections import namedtuple

    from vendorscope.sources.csv_records import prefix_scan
    Flags = namedtuple("Flags", "file start odd ends_0 ends_1 open_0 open_1")
    rows = [Flags("a", 20, True, False, True, True, True), Flags("a", 0, True, True, False, True, True),
            Flags("a", 10, False, True, False, False, True), Flags("a", 30, False, True, True, True, True),
            Flags("b", 0, False, True, False, False, True)]
    states, broken = prefix_scan(rows)
    assert broken and states == {("a", 0): (False, 0), ("a", 10): (True, 0), ("a", 20): (True, 0),
                                 ("a", 30): (False, 0), ("b", 0): (False, 0)}


@pytest.mark.parametrize("text, message", [
    ('a,b\n1,"two\nlines"\n', "multiline=None or True"),
    ('a,b\n1,2,3\n', "more than 2 fields"),
])
def test_csv_faults_have_a_message(spark, tmp_dir, text, message):
    path = os.path.join(tmp_dir, "t.csv")
    write(path, text)
    with pytest.raises(Exception, match=message):
        CI.read_extract(spark, path, lenient=True, multiline=False).collect()


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (7, 1), (3, 64)])
def test_one_csv_file_equals_pandas(spark, tmp_dir, parts, block):
    rows = [(i, f"n{i % 7}" + ['', ', "q"', "\n", "\r", " é", "\\"][i % 6], None if i % 5 == 0 else i / 3, i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, `a,b` string, x double, flag boolean").repartition(parts, "x")
    path = os.path.join(tmp_dir, "one.csv")
    write(path, "old")
    size = EX.export_csv_file(df, path, ["id"], block_bytes=block)
    want = pd.DataFrame(rows, columns=["id", "a,b", "x", "flag"]).to_csv(index=False).encode("utf-8-sig")
    with open(path, "rb") as f:
        assert f.read() == want
    assert size == len(want) and os.listdir(tmp_dir).count("one.csv") == 1
    assert not [x for x in os.listdir(tmp_dir) if x.endswith(".part")]


def test_one_csv_file_of_no_rows_and_of_one_column(spark, tmp_dir):
    path = os.path.join(tmp_dir, "few.csv")
    EX.export_csv_file(spark.createDataFrame([], "a long, b string"), path)
    assert open(path, "rb").read() == "\ufeffa,b\n".encode("utf-8")
    EX.export_csv_file(spark.createDataFrame([("",), (None,), ("x",)], "a string").coalesce(1), "file://" + path, bom=False)
    assert open(path, "rb").read() == b'a\n""\n""\nx\n'
    with pytest.raises(ValueError):
        EX.export_csv_file(spark.range(1), "s3://bucket/few.csv")


def test_one_csv_file_stays_when_the_job_fails(spark, tmp_dir):
    path = os.path.join(tmp_dir, "kept.csv")
    write(path, "old")
    with pytest.raises(Exception):
        EX.export_csv_file(spark.range(10).selectExpr("if(id = 7, raise_error('x'), id) AS a"), path)
    assert open(path).read() == "old" and os.listdir(tmp_dir).count("kept.csv") == 1
    assert not [x for x in os.listdir(tmp_dir) if x.endswith(".part")]


def test_export_is_read_back(spark, tmp_dir):
    rows = [(1, 'say "hi", she said', 1.5), (2, "end\\", None), (3, "plain", -2.0), (4, ' pad ', 0.0), (5, 'a""b', 7.25)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    EX.export_csv(df, os.path.join(tmp_dir, "out"))
    back = CI.read_extract(spark, os.path.join(tmp_dir, "out"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_ingest_registers_catalog_tables(spark, tmp_dir):
    data = os.path.join(tmp_dir, "data")
    os.makedirs(data)
    write(os.path.join(data, "ingest_probe.csv"), "a,b\n1,x\n2,y\n")
    for _ in range(2):                                                  # replace semantics
        CI.ingest_directory(spark, data, os.path.join(tmp_dir, "tables"), register=True)
    assert sorted(tuple(r) for r in spark.table("ingest_probe").collect()) == [(1, "x"), (2, "y")]
    assert "ingest_probe" in {r.table_name for r in catalog_profile(spark).collect()}
    spark.sql("DROP TABLE ingest_probe")


def test_stream_reads_the_batch_dialect(spark, tmp_dir):
    from pyspark.sql.types import StructType

    from vendorscope.streaming.csv_stream import start_extract_stream
    data = os.path.join(tmp_dir, "in")
    os.makedirs(data)
    write(os.path.join(data, "a.csv"), 'id,name\n1,"say ""hi"", she"\n2,"end\\"\n3, pad \n')
    schema = StructType.fromDDL("id long, name string")
    q = start_extract_stream(spark, data, schema, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    assert got == sorted(tuple(r) for r in CI.read_extract(spark, data, schema).collect())
    assert got == [(1, 'say "hi", she'), (2, "end\\"), (3, " pad ")]
