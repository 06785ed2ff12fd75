"""Records of CSV files whose quoted fields hold line breaks, read by splits.

Whether a line break ends a record depends on the number of quotes before it in
the whole file, so a task that starts inside a file cannot tell. Two scans can:

1. Every split (a file's part that one task reads as text lines) is parsed under
   both assumptions, outside and inside quotes at its start. It reports a few
   flags: the state at its end, whether a record ends in it, whether a line ends
   inside quotes.
2. A prefix scan over the splits of a file (a few flags a split; the only thing the
   driver holds) decides which assumption holds for each, and which earlier split
   opened the record that a split starts in.
3. The second scan joins lines to records. What a split holds of a record that
   another split opens or closes goes out as a fragment; fragments of one record
   are put together by a small aggregate.

Files stay splittable at any size; no task reads more than its split, and only
records across splits are shuffled. Records end at line feeds; a carriage return
before one is dropped, blank lines are skipped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = ("file", "start", "value")
FLAGS = "file string, start long, odd boolean, ends_0 boolean, ends_1 boolean, open_0 boolean, open_1 boolean"
PIECES = "file string, owner long, start long, whole boolean, header boolean, record string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], np.ndarray]]:
    """(split, lines, whether each holds an odd number of quotes), in order."""
    for b in batches:
        if not b.num_rows:
            continue
        files, starts = b.column(0).dictionary_encode(), b.column(1).to_numpy()
        code = files.indices.to_numpy()
        odd = pc.count_substring(b.column(2), '"').to_numpy(zero_copy_only=False) % 2 == 1
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1
        lines = b.column(2).to_pylist()
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            yield (files.dictionary[int(code[lo])].as_py(), int(starts[lo])), lines[lo:hi], odd[lo:hi]


def split_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: lines -> one row of flags a split."""
    found: dict[tuple[str, int], list[bool]] = {}
    for split, _, odd in by_split(batches):
        flags = found.setdefault(split, [False] * 5)            # odd, ends_0, ends_1, open_0, open_1
        inside = np.cumsum(odd) % 2 == 1
        some, others = bool(inside.any()), bool((~inside).any())
        if flags[0]:
            some, others = others, some
        # lines that end inside under the first assumption end records under the second
        flags[1] |= others
        flags[2] |= some
        flags[3] |= some
        flags[4] |= others
        flags[0] ^= bool(inside[-1])
    rows = [(*split, *flags) for split, flags in found.items()]
    if rows:
        types = [pa.string(), pa.int64()] + [pa.bool_()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                         ["file", "start", "odd", "ends_0", "ends_1", "open_0", "open_1"])


def prefix_scan(flags: list) -> tuple[dict[tuple[str, int], tuple[bool, int]], bool]:
    """Split -> (starts inside quotes, start of the split that opened that
    record), and whether any line ends inside quotes."""
    states, broken = {}, False
    file, inside, owner = None, False, 0
    for r in sorted(flags, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, inside, owner = r.file, False, 0
        states[r.file, r.start] = (inside, owner)
        broken |= r.open_1 if inside else r.open_0
        ends = r.ends_1 if inside else r.ends_0
        after = inside != r.odd
        if after and (ends or not inside):
            owner = r.start
        inside = after
    return states, broken


def split_records(states):
    """mapInArrow body: lines -> records of a split, and fragments of records
    that it shares with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = states.value
        out: list[tuple] = []
        split, held, inside, whole, first, owner = None, [], False, True, False, 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              ["file", "owner", "start", "whole", "header", "record"])

        def close(complete: bool) -> None:
            if held:
                out.append((split[0], owner, split[1], whole and complete, first, "\n".join(held)))
                held.clear()
        for now, lines, odd in by_split(batches):
            if now != split:
                close(False)
                split = now
                inside, owner = known[now]
                whole, first = not inside, now[1] == 0
                owner = owner if inside else now[1]
            for line, flips in zip(lines, odd.tolist()):
                held.append(line)
                inside ^= flips
                if not inside:
                    close(True)
                    whole, first, owner = True, False, now[1]
            if len(out) > 20_000:
                yield batch()
                out = []
        close(False)
        if out:
            yield batch()
    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per record of the files (column ``record``, headers left out),
    or None where no line break is inside quotes, so that lines are records."""
    lines = text_lines(spark, path)
    states, broken = prefix_scan(lines.mapInArrow(split_flags, FLAGS).collect())
    if not broken:
        return None
    pieces = lines.mapInArrow(split_records(spark.sparkContext.broadcast(states)), PIECES)
    shared = (pieces.filter("not whole").groupBy("file", "owner")
              .agg(F.array_sort(F.collect_list(F.struct("start", "record", "header"))).alias("parts"))
              .select(F.exists("parts", lambda p: p["header"]).alias("header"),
                      F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    both = pieces.filter("whole").select("header", "record").unionByName(shared)
    record = F.regexp_replace("record", r"\r\z", "")
    return both.filter("not header").select(record.alias("record")).filter("record <> ''")
