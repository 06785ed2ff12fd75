"""Deterministic sharded WARC writer and its reader.

Write: payload digests first; of equal payloads the smallest id is written as
``response``, the others as ``revisit`` records that refer to it (one
aggregate per digest, joined back; AQE splits a hot digest). Records are
range-sorted by (run, id block, id, ...): a block is ``block_ids`` consecutive ids,
a run the blocks whose payload bytes, added up in id order, reach ``run_bytes``
together. So what a run's files hold depends on the rows alone, never on partitions.
A task streams its runs in order and rolls to a new file when a run ends
or the file's compressed size reaches ``roll_bytes``. Every record is its own
gzip member with fixed timestamps, headers and digests made again from the
payload, record ids derived from the content. A file is written under a
temporary name, then renamed; equal input gives equal names and bytes, so a
task that runs twice (lost executor, speculation) replaces a file by itself.
The manifest (file, bytes, records, sha256) is a Parquet table that commits the
archive: readers open the files it lists and nothing else. A listed file that is
missing, or whose size, sha256 or number of records differs, fails the read.

Files go through ``pyarrow.fs`` to the URI of the archive folder (file, hdfs,
s3, gs), one file at a time in a task, when writing and when reading.

Defined cases: null payload counts as empty; null ids sort first, in blocks by
payload digest (many null ids spread over runs), and are written without an id
header; a null URL has no target header; line breaks in a URL become %0D / %0A;
repeated rows are repeated records, the first of them the response; rows of one
id stay in one block; a payload of any length is one record (a file may pass
``roll_bytes`` by its last record); columns besides the three named ones are not
read, whatever their names; an empty table gives a manifest without files and
an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, shuffle_partitions, stored
from vendorscope.session import checkpoint_root

by_value(__name__)

BLOCK_IDS = 1024
#: Null ids take ``NULL_BLOCKS`` blocks from here, by their payload's digest.
NULL_BLOCK = -(1 << 62)
NULL_BLOCKS = 4096
#: Blocks a first step of the running sum covers.
STRIDE = 4096
ROLL_BYTES = 16 << 20
#: Payload bytes of a run, in files: text pages shrink to about a quarter.
RUN_FILES = 4
HEAD_BYTES = 600
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long, sha256 string"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    digest = base32_sha1(payload)
    name = hashlib.sha256(f"{page_id}|{url}|{digest}|{revisit}".encode("utf-8", "surrogatepass")).digest()[:16]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=name, version=4)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"X-Payload-Bytes: {len(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file; each byte is read once."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, out = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("truncated archive")
            piece = view[at:at + chunk]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, in order; block digests are checked."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[:int(headers["Content-Length"])]
        if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest differs in {headers['WARC-Record-ID']}")
        yield headers, block


def block_runs(sizes: DataFrame, run_bytes: int) -> DataFrame:
    """(block, run) of the (block, size) rows: blocks in order, a run ends with the
    block that brings the running sum past a multiple of ``run_bytes``; a run is
    named by its first block. The sum has two steps, so no task sees all blocks."""
    strides = sizes.withColumn("stride", F.floor(F.col("block") / STRIDE))
    before = strides.groupBy("stride").agg(F.sum("size").alias("whole")).select(
        "stride", (F.sum("whole").over(Window.orderBy("stride")) - F.col("whole")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("stride").orderBy("block")) - F.col("size")
    placed = strides.withColumn("inside", inside).join(before, "stride").select(
        "block", F.floor((F.col("before") + F.col("inside")) / run_bytes).alias("number"))
    return placed.select("block", F.min("block").over(Window.partitionBy("number")).alias("run"))


def write_runs(root: str, roll_bytes: int):
    """mapInArrow body over sorted rows: writes files, returns manifest rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int, str]] = []
        state = {"run": None, "part": 0, "data": bytearray(), "n": 0, "last": None}

        def close():
            if state["n"]:
                name = f"{run_name(state['run'])}-{state['part']:05d}.warc.gz"
                held = f"{base}/_tmp-{uuid.uuid4().hex}"
                with store.open_output_stream(held, compression=None) as out:
                    out.write(bytes(state["data"]))
                store.move(held, f"{base}/{name}")
                done.append((name, len(state["data"]), state["n"], hashlib.sha256(state["data"]).hexdigest()))
                state["part"] += 1
            state["data"], state["n"] = bytearray(), 0

        for b in batches:
            frame = {c: b.column(c).to_pylist() for c in b.schema.names}
            for run_, page_id, url, payload, grouped, keeper, same in zip(
                    *(frame[c] for c in ("run", "id", "url", "payload", "grouped", "keeper", "same"))):
                if run_ != state["run"]:
                    close()
                    state["run"], state["part"], state["last"] = run_, 0, None
                # of rows equal to the keeping row, the first in order is the response
                row = (page_id, url, payload) if same else None
                revisit = grouped and not (same and row != state["last"])
                state["last"] = row
                raw = record_bytes(page_id, url, payload, keeper, revisit)
                state["data"] += gzip.compress(raw, 6, mtime=0)
                state["n"] += 1
                if len(state["data"]) >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                ["file", "bytes", "records", "sha256"])
    return run


def run_name(first_block: int) -> str:
    null = first_block - NULL_BLOCK
    return f"null-{null:04d}" if 0 <= null < NULL_BLOCKS else format(first_block, "016d")


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_revisit_bytes: int = 0, block_ids: int = BLOCK_IDS,
               roll_bytes: int = ROLL_BYTES, run_bytes: int | None = None) -> DataFrame:
    """Write the archive under ``root``; returns its manifest (a stored table).
    ``run_bytes``: payload bytes after which a new run of files begins
    (``RUN_FILES`` times ``roll_bytes`` where not given)."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    # smallest id of each payload (nulls are smallest); of repeated ids the url decides
    entry = F.struct(F.col("id"), F.col("url"))
    # stored, so the planner knows its size: few repeated payloads need no
    # shuffle of the pages, many get an equi-join
    keepers = stored(rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("content").agg(
        F.min(entry).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payload-keepers")
    joined = rows.join(keepers, "content", "left")
    # rows are told apart by their own blocks: the sizes need neither keepers nor a second shuffle of pages
    null_block = F.lit(NULL_BLOCK) + F.pmod(F.xxhash64("payload"), F.lit(NULL_BLOCKS))
    block = F.coalesce(F.floor(F.col("id") / F.lit(block_ids)).cast("long"), null_block)
    sizes = stored(rows.groupBy(block.alias("block")).agg(
        F.sum(F.length("payload") + F.lit(HEAD_BYTES)).alias("size")), "warc-sizes")
    runs = stored(block_runs(sizes, run_bytes or RUN_FILES * roll_bytes), "warc-runs")
    ranged = (joined.select(
        "id", "url", "payload", F.col("first").isNotNull().alias("grouped"), F.col("first.id").alias("keeper"),
        F.coalesce(entry.eqNullSafe(F.col("first")), F.lit(False)).alias("same"), block.alias("block"))
        .join(runs, "block")
        .repartitionByRange(shuffle_partitions(spark), "run")
        .sortWithinPartitions("run", "block", "id", "url", "payload"))
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    return stored(ranged.mapInArrow(write_runs(root, roll_bytes), MANIFEST), "warc-manifest")


def read_files(root: str, with_payload: bool):
    """mapInArrow body: manifest rows -> the records of their files, checked."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name, size, count, sha in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:   # a missing file raises here
                    data = f.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} differs from the manifest")
                rows = [read_record(name, headers, block, with_payload) for headers, block in parse_records(data)]
                if len(rows) != count:
                    raise ValueError(f"{name} holds {len(rows)} records, the manifest says {count}")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                                 [c.split()[0] for c in RECORDS.split(", ")])
    return run


def read_record(name: str, headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    payload = block.partition(b"\r\n\r\n")[2]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']} of {name}")
    return (number(headers.get("X-Page-ID")), headers.get("WARC-Target-URI"), int(headers["X-Payload-Bytes"]), digest,
            headers["WARC-Type"], number(headers.get("X-Refers-To-Page")), payload if with_payload else None)


def number(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_warc(spark: SparkSession, root: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists, and of no others; raises
    where a file is missing or is not what the manifest says."""
    listed = manifest.select("file", "bytes", "records", "sha256").repartition(shuffle_partitions(spark), "file")
    return listed.mapInArrow(read_files(root, with_payload), RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archive back: one row per page."""
    spark = pages.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(pages, root)
    return read_warc(spark, root, manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
