"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item (an item of fewer
words is one window of its own length m). Over the k-grams of a text, k being
half the window, winnowing keeps the least k-gram hash of every window (the
rightmost of equals) once for the run of windows it is the least of: its
fingerprint. A window's least k-gram depends on the window's words alone, so
a shared span of ``length`` words always shares a fingerprint.

1. Items give (m, fingerprint, window) hashes, stored. Their fingerprints are
   also marked in a bit map of bounded size.
2. One pass over the documents winnows each whole text; a fingerprint that the
   bit map may hold is extended to the run of windows it stands for. Only these
   candidates leave the pass, as numbers; no text is shuffled.
3. Candidates join the items' windows on (m, fingerprint, window): 128 bits of
   hash, so two different windows meet with a chance of about 2**-100. Each
   candidate meets one distinct window at most, whatever number of items holds
   it. Hit words are the union of the windows found, by one ordered window
   function a document.
4. Windows of the same set of items form a class; documents hit by the same
   classes share one combination, and item ids are looked up once a combination.

Broadcast: the bit map (32 MB at most) and the items' windows while they are
``BROADCAST_WINDOWS`` at most; beyond, Spark picks the join. A passage that a
third of the documents holds is one window class there. Gathered in one group:
the windows of one document, and the item ids of one combination (the digest
needs them in one string).

Defined cases: null or empty texts, or texts without a word, have no words and
no windows; the longest text is winnowed whole; ties of hashes take the
rightmost k-gram; repeated documents are judged row by row; items that repeat an
id count once, a null item id is the empty string; an empty table on either side
leaves every document clean; only the id and text columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorscope.llm.common import by_value, free_worker, stored, task_number, trim_memory
from vendorscope.llm.shingles import Shingler, byte_slices, mix

by_value(__name__)

WINDOW_WORDS = 10
#: Bytes of texts winnowed at once: a worker holds about 30 times that in arrays.
SLICE_BYTES = 500_000
#: Items' windows that one executor may hold as a broadcast (about 60 bytes each).
BROADCAST_WINDOWS = 1_000_000
MIN_BITS, MAX_BITS, BITS_PER_PRINT = 16, 28, 32
WORD_FACTORS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


class Winnower(Shingler):
    """Fingerprints and windows of texts. Words are runs of digits, letters a-z
    (A-Z lower-cased) and all bytes from 0x80 on."""

    def __init__(self):
        super().__init__()
        byte = np.arange(256)
        self.space = ~(((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A))
                       | ((byte >= 0x41) & (byte <= 0x5A)) | (byte >= 0x80))

    @staticmethod
    def grams(w: np.ndarray, k: int, kind: int) -> np.ndarray:
        """Hash of every k consecutive words (one hash family a kind)."""
        n, step = max(0, len(w) - k + 1), np.uint64(WORD_FACTORS[kind])
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * step + w[j:j + n]
        return mix(h)

    def windows(self, w: np.ndarray, first: np.ndarray, m: int, wanted=None) -> tuple[np.ndarray, ...]:
        """(start, fingerprint, window hash) of every window of m words within
        a text, words being those of several texts with their first words.
        With ``wanted`` only the runs whose fingerprint it accepts."""
        k = (m + 1) // 2
        n = max(0, len(w) - m + 1)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        g = self.grams(w, k, 0)
        least, at = g[m - k:m - k + n], np.full(n, m - k, np.int64)
        for j in range(m - k - 1, -1, -1):
            less = g[j:j + n] < least
            least, at = np.where(less, g[j:j + n], least), np.where(less, j, at)
        ends = np.repeat(first[1:], np.diff(first))[:n]
        start = np.flatnonzero(np.arange(n) + m <= ends)
        place = start + at[start]
        run = np.flatnonzero(np.diff(place, prepend=-1))          # one fingerprint a run of windows
        prints = least[start[run]]
        if wanted is not None:
            sizes = np.diff(run, append=len(start))
            start = start[np.repeat(wanted(prints), sizes)]
        spans = self.grams(w, m, 1) if len(start) * 8 > n else None
        if spans is None:
            h, step = np.full(len(start), m, np.uint64), np.uint64(WORD_FACTORS[1])
            for j in range(m):
                h = h * step + w[start + j]
            spans = mix(h)
        else:
            spans = spans[start]
        return start, least[start], spans


def utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def item_windows(length: int):
    """mapInArrow body: (item, text) -> (m, fp, win, item), once an item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        tool = Winnower()
        for b in batches:
            items, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for text, item in zip(texts, items):
                w, first = tool.word_hashes([text])
                m = min(length, len(w))
                if not m:
                    continue
                _, fp, win = tool.windows(w, first, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), m, np.int32)), pa.array(fp.view(np.int64)),
                     pa.array(win.view(np.int64)), pa.array([item] * len(fp), pa.string())],
                    ["m", "fp", "win", "item"])
        trim_memory()
    return run


def doc_candidates(bits, sizes: Sequence[int], id_type: pa.DataType):
    """mapInArrow body: (id, text) -> (row_key, id, n_words, start, m, fp, win)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        tool, table = Winnower(), bits.value
        mask = np.uint64(len(table) * 8 - 1)

        def wanted(fp: np.ndarray) -> np.ndarray:
            bit = fp & mask
            return (table[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

        key = task_number() << 40
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                w, first = tool.word_hashes(texts[lo:hi])
                found = [(m, *tool.windows(w, first, m, wanted)) for m in sizes]
                start = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                order = np.argsort(start, kind="stable")
                start = start[order]
                m = np.repeat(np.array(sizes, np.int32), [len(f[1]) for f in found])[order]
                fp = np.concatenate([f[2] for f in found])[order] if found else np.zeros(0, np.uint64)
                win = np.concatenate([f[3] for f in found])[order] if found else np.zeros(0, np.uint64)
                offsets = np.searchsorted(start, first)
                own = start - np.repeat(first[:-1], np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + hi - lo)), b.column(0).slice(lo, hi - lo).cast(id_type),
                     pa.array(np.diff(first)), lists(own.astype(np.int32), offsets), lists(m, offsets),
                     lists(fp.view(np.int64), offsets), lists(win.view(np.int64), offsets)],
                    ["row_key", "id", "n_words", "start", "m", "fp", "win"])
                key += hi - lo
        trim_memory()
    return run


def bit_map(prints: DataFrame) -> np.ndarray:
    """Bits of the fingerprints, packed on the executors; the driver gets one
    number per 64 bits in use (at most 2**22 of them)."""
    n = prints.count()
    bits = min(max((n * BITS_PER_PRINT).bit_length(), MIN_BITS), MAX_BITS)
    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = (prints.select(F.shiftright(at, 6).alias("slot"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["slot"].to_numpy()] = words["word"].to_numpy()
    return table.astype("<i8").view(np.uint8)


def winnowed_items(benchmark: DataFrame, text_col: str, id_col: str, length: int) -> DataFrame:
    """Stored (m, fp, win, item): every distinct window of every item."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             F.col(text_col).alias("text"))
    rows = items.mapInArrow(item_windows(length), "m int, fp long, win long, item string")
    return stored(rows.distinct(), "bench-windows")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                       item_text: str = "text", item_id: str = "item_id", length: int = WINDOW_WORDS,
                       broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(documents, items). Documents: row_key, id, n_words, spans (array of
    struct(start, end) of hit words, end exclusive, in order) and combo (a key
    of its set of items; null: none), one row per document. Items: (combo, item)."""
    spark = docs.sparkSession
    windows = winnowed_items(benchmark, item_text, item_id, length)
    sizes = sorted(r.m for r in windows.select("m").distinct().collect())       # at most ``length`` numbers
    bits = spark.sparkContext.broadcast(bit_map(windows.select("fp").distinct()))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("row_key", T.LongType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
        *(T.StructField(c, T.ArrayType(t)) for c, t in (("start", T.IntegerType()), ("m", T.IntegerType()),
                                                       ("fp", T.LongType()), ("win", T.LongType())))])
    from pyspark.sql.pandas.types import to_arrow_type
    found = stored(docs.select(F.col(id_col), F.col(text_col))
                   .mapInArrow(doc_candidates(bits, sizes, to_arrow_type(id_type)), schema), "bench-candidates")
    bits.destroy()

    key = ["m", "fp", "win"]
    classes = stored(windows.groupBy(*key).agg(
        F.struct(F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b"),
                 F.count(F.lit(1)).alias("n")).alias("cls")), "bench-classes")
    small = classes.count() <= broadcast_windows
    hits = (found.selectExpr("row_key", "inline(arrays_zip(start, m, fp, win))")
            .join(F.broadcast(classes) if small else classes, key)
            .select("row_key", "start", (F.col("start") + F.col("m")).alias("end"), "cls"))
    place = Window.partitionBy("row_key").orderBy("start", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    spans = (hits.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
             .withColumn("span", F.sum("opens").over(place))
             .groupBy("row_key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                             F.collect_set("cls").alias("cls")))
    per = stored(spans.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("cls")))).alias("cls"))
        .withColumn("combo", F.sha2(F.to_json("cls"), 256)), "bench-hits")

    stands = classes.groupBy("cls").agg(F.min(F.struct(*key)).alias("w")).select("cls", "w.*")
    members = windows.join(stands, key).select("cls", "item")
    items = (per.groupBy("combo").agg(F.first("cls").alias("cls")).select("combo", F.explode("cls").alias("cls"))
             .join(members, "cls").select("combo", "item").distinct())
    return found.select("row_key", "id", "n_words").join(per.drop("cls"), "row_key", "left"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", length: int = WINDOW_WORDS,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256,
    contaminated and the spans of hit words."""
    marked, items = contaminated_spans(docs, benchmark, text_col, id_col, item_text, item_id, length,
                                       broadcast_windows)
    named = items.groupBy("combo").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))
    return marked.join(named, "combo", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"), "spans")
