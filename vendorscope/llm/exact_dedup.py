"""Exact deduplication by Grace hashing over complete contents.

1. Each task keeps an open-addressing table of the contents it has seen (reset
   when ``memory_bytes`` of text are held) and tags every row with the first
   row of the same content. This is the pre-aggregation: a text that a third
   of all rows share leaves each task once. The tagged table is stored.
2. Only those first rows are shuffled, by bits of their content hash (Grace
   partitioning; the shuffle files are the first level of spill files). A task
   inserts its records into an open-addressing table that compares complete
   contents; once the table holds ``memory_bytes``, records with contents not
   in it go to spill files by the next hash bits, and each file is handled
   the same way. Copies of a content already held never spill, so each level
   ends. The files are anonymous, live inside the task and vanish with it; a
   lost executor replays the task from the shuffle.
3. Ids, sizes and survivors are plain aggregates over the row keys.

Defined cases: a null text counts as empty; a null id is smaller than any id;
of rows that tie in content and id, the one met first in the stored table
stays; an empty table gives an empty result; other columns are carried in one
struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorscope.llm.common import by_value, free_worker, shuffle_partitions, stored, task_number

by_value(__name__)

MEMORY_BYTES = 64 << 20
FANOUT_BITS = 4
RECORD = "<qI"


class ContentTable:
    """Open addressing with linear probing; equality is of the whole content."""

    def __init__(self, bits: int = 10):
        self.mask = (1 << bits) - 1
        self.slots = [-1] * (1 << bits)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[int] = []
        self.held = 0

    def find(self, h: int, content: bytes) -> int:
        """Entry of the content, or -1 - (the free slot) when it is new."""
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & self.mask
        return -1 - i

    def insert(self, slot: int, h: int, content: bytes, value: int) -> None:
        self.slots[slot] = len(self.values)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.held += len(content) + 64
        if 2 * len(self.values) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def content_hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def tag_rows(text_at: int, memory_bytes: int):
    """mapInArrow body: (row) -> (row_key, rep_key, digest, row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        key, table = task_number() << 40, ContentTable()
        for b in batches:
            rows = b.column(0)
            keys, reps, digests = [], [], []
            for text in rows.field(text_at).cast(pa.binary()).to_pylist():
                content = text or b""
                digest = hashlib.sha256(content).digest()
                h = content_hash(digest)
                e = table.find(h, content)
                if e < 0:
                    if table.held > memory_bytes:
                        table = ContentTable()
                        e = table.find(h, content)
                    table.insert(-1 - e, h, content, key)
                    reps.append(key)
                else:
                    reps.append(table.values[e])
                keys.append(key)
                digests.append(digest)
                key += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(reps, pa.int64()),
                 pa.array(digests, pa.binary()), rows], ["row_key", "rep_key", "digest", "row"])
    return run


def grace(memory_bytes: int):
    """mapInArrow body: (rep_key, content) -> (rep_key, group_key)."""
    def level(records: Iterator[tuple[int, bytes]], shift: int) -> Iterator[tuple[int, int]]:
        table, spill = ContentTable(), None
        for key, content in records:
            h = content_hash(hashlib.sha256(content).digest())
            e = table.find(h, content)
            if e >= 0:
                yield key, table.values[e]
            elif table.held <= memory_bytes:
                table.insert(-1 - e, h, content, key)
                yield key, key
            else:
                if spill is None:
                    spill = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
                # high bits, which neither the shuffle nor the slots use
                f = spill[(h >> (60 - shift)) & ((1 << FANOUT_BITS) - 1)]
                f.write(struct.pack(RECORD, key, len(content)))
                f.write(content)
        del table
        for f in spill or ():
            f.seek(0)
            yield from level(read_spill(f), (shift + FANOUT_BITS) % 60)
            f.close()

    def read_spill(f) -> Iterator[tuple[int, bytes]]:
        while head := f.read(struct.calcsize(RECORD)):
            key, size = struct.unpack(RECORD, head)
            yield key, f.read(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                # one row at a time: a batch's contents are not copied as a whole
                keys, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
                for i, key in enumerate(keys):
                    yield key, texts[i].as_py() or b""

        out: list[tuple[int, int]] = []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([g for _, g in out], pa.int64())],
                ["rep_key", "group_key"])
        for pair in level(records(), 0):
            out.append(pair)
            if len(out) >= 20_000:
                yield flush()
                out = []
        if out:
            yield flush()
    return run


def tagged(docs: DataFrame, text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The stored table of (row_key, rep_key, digest, row)."""
    schema = T.StructType([
        T.StructField("row_key", T.LongType()), T.StructField("rep_key", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("row", docs.schema)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return stored(rows.mapInArrow(tag_rows(docs.columns.index(text_col), memory_bytes), schema), "tagged")


def groups(tags: DataFrame, text_col: str = "text", id_col: str = "doc_id",
           memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """(rep_key, keep_id, keep_key, group_size): one row per first row."""
    spark = tags.sparkSession
    firsts = (tags.filter(F.col("row_key") == F.col("rep_key"))
              .select("rep_key", F.col("row")[text_col].alias("content"),
                      F.substring("digest", 9, 4).alias("bits")))
    linked = (firsts.repartition(shuffle_partitions(spark), "bits").select("rep_key", "content")
              .mapInArrow(grace(memory_bytes), "rep_key long, group_key long"))
    linked = stored(linked, "linked")
    local = tags.groupBy("rep_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col("row")[id_col].alias("id"), (-F.col("row_key")).alias("k"))).alias("best"))
    known = linked.join(local, "rep_key")
    whole = known.groupBy("group_key").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    return linked.join(whole, "group_key").select(
        "rep_key", F.col("best.id").alias("keep_id"), (-F.col("best.k")).alias("keep_key"), "group_size")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    tags = tagged(docs.select(id_col, text_col), text_col, memory_bytes)
    decided = groups(tags, text_col, id_col, memory_bytes)
    return (tags.select("row_key", "rep_key", "digest", F.col("row")[id_col].alias(id_col))
            .join(decided, "rep_key")
            .select(id_col, "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    tags = tagged(docs, text_col, memory_bytes)
    decided = groups(tags, text_col, id_col, memory_bytes)
    lost = (tags.select("row_key", "rep_key").join(decided, "rep_key")
            .filter(F.col("row_key") != F.col("keep_key")).select("row_key"))
    return tags.join(lost, "row_key", "left_anti").select("row.*")
