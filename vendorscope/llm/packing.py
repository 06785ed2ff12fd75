"""Best-fit packing after Martello-Toth dominance reduction.

Only lengths matter for which pieces share a sequence, and there are at most
``capacity`` lengths. So the pieces are tokenised once and stored with a rank
among the pieces of their length; the packing itself runs on the histogram of
lengths (``capacity`` numbers, whatever the input), and yields bin patterns
with multiplicities. A pattern's slot takes consecutive ranks of its length,
so every piece finds its sequence and offset from (length, rank) alone.

Reduction: for the longest length first, a set is fixed for good if it
dominates every other set that holds this length: the length alone where
nothing fits beside it; with a partner that fills the sequence exactly; with
the longest partner that fits, where no two others fit beside it, or where no
two others that fit add up to more than that partner and no three fit. Fixing
goes on until nothing more can be fixed. Best-fit decreasing packs the rest.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed like any other row; an empty table gives an empty result. ``start`` and
``piece`` count within a document, so rows with equal ids stay apart only by
their place in the packing.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, stored, task_number, text_or_empty, trim_memory, worker_kept
from vendorscope.llm.pretokens import WordTable, by_spaces, slices, stretch

by_value(__name__)

CAPACITY = 1024
END_ID = 2


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


#: Latin letters end here: a closing mark after one is a pre-token of its own.
LATIN_END = "\u0250"


class StretchEncoder:
    """Token ids, as bytes, of stretches of text (see ``by_spaces``)."""

    def __init__(self, tokenizer: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.coder = Tokenizer.from_str(tokenizer)
        self.coder.encode_special_tokens = True     # their strings in a text are ordinary text
        vocabulary = self.coder.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)              # one character of a byte-level token per byte
        self.table: WordTable | None = None
        self.marks = {c: little(self.coder.encode(c, add_special_tokens=False).ids) for c in ",.;:!?"}

    def words(self, words: list[str]) -> list[bytes]:
        """Many words in a call; where each ends follows from the bytes its tokens stand for."""
        lists = [words[a:a + 1000] for a in range(0, len(words), 1000)]
        out: list[bytes] = []
        for a in range(0, len(lists), 20):
            coded = self.coder.encode_batch_fast(lists[a:a + 20], is_pretokenized=True, add_special_tokens=False)
            for part, x in zip(lists[a:a + 20], coded):
                ids = x.ids
                ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in part])
                cuts = 4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")
                raw, cuts = little(ids), cuts.tolist()
                out.extend([raw[i:j] for i, j in zip([0, *cuts], cuts)])
        return out

    def __call__(self, keys: list) -> list[bytes]:
        """A word is encoded once with and without a closing mark."""
        cores: dict[str, int] = {}
        out: list = []
        later: list[tuple[int, int, bytes]] = []
        known, values = self.table.numbers.get, self.table.values
        for i, k in enumerate(keys):
            w, tail = stretch(k), b""
            if w[-1:] in self.marks:
                core = w[:-1]
                if core.lstrip(" ").isalpha() and (core.isascii() or max(core) < LATIN_END):
                    w, tail = core, self.marks[w[-1]]
                    n = known(core[1:]) if core[0] == " " else None      # the word alone, met before
                    if n is not None and n < len(values):
                        out.append(values[n] + tail)
                        continue
            later.append((i, cores.setdefault(w, len(cores)), tail))
            out.append(None)
        coded = self.words(list(cores))
        for i, n, tail in later:
            out[i] = coded[n] + tail
        return out


def stretch_table(tokenizer: str) -> WordTable:
    encoder = StretchEncoder(tokenizer)
    encoder.table = WordTable(by_spaces, encoder)
    return encoder.table


def piece_batches(tokenizer, capacity: int, end_id: int, with_ids: bool):
    """mapInArrow body: (id, text) -> one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition = tokenizer.value
        table = worker_kept(("stretches", definition), lambda: stretch_table(definition))
        part, seen, end = task_number(), [0] * (capacity + 1), little([end_id])
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows: list[list] = [[] for _ in range(7)]
            blobs: list[bytes] = []
            for first, last in slices(texts):
                for i, words in enumerate(table.encode_texts(texts[first:last]), first):
                    coded = b"".join(words) + end
                    n, start, piece = len(coded) // 4, 0, 0
                    size = n % capacity or capacity
                    while start < n:
                        blob = coded[4 * start:4 * (start + size)]
                        for col, x in zip(rows, (i, piece, start, size, zlib.crc32(blob), part, seen[size])):
                            col.append(x)
                        if with_ids:
                            blobs.append(blob)
                        seen[size] += 1
                        start, piece, size = start + size, piece + 1, capacity
            at = pa.array(rows[0], pa.int64())
            out = [ids.take(at), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            yield pa.RecordBatch.from_arrays(
                out + ([pa.array(blobs, pa.binary())] if with_ids else []),
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids)
        trim_memory()
    return run


def reduce_lengths(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Fixed patterns with multiplicities, and the counts that remain."""
    counts = {k: n for k, n in counts.items() if n}
    fixed: list[tuple[list[int], int]] = []

    def take(pattern: list[int], times: int) -> None:
        fixed.append((pattern, times))
        for x in pattern:
            counts[x] -= times
            if not counts[x]:
                del counts[x]

    changed = True
    while changed:
        changed = False
        for length in sorted(counts, reverse=True):
            while counts.get(length):
                best = dominating(counts, length, capacity)
                if best is None:
                    break
                take(*best)
                changed = True
    return fixed, counts


def dominating(counts: dict[int, int], length: int, capacity: int) -> tuple[list[int], int] | None:
    """A set with ``length`` that dominates all others with it, and how often
    it can be fixed: what makes it dominate stays true as pieces leave."""
    room, own = capacity - length, counts[length]

    def left(x: int) -> int:
        return counts[x] - (x == length)
    fit = [x for x in sorted(counts) if x <= room and left(x) > 0]
    if not fit:
        return [length], own
    partner = fit[-1]
    times = own // 2 if partner == length else min(own, counts[partner])
    if partner < room:
        few: list[int] = []
        for x in fit:
            few += [x] * min(3 - len(few), left(x))
        pair_fits = len(few) > 1 and few[0] + few[1] <= room
        three_fit = len(few) > 2 and sum(few) <= room
        if three_fit or (pair_fits and largest_pair(fit, left, room) > partner):
            return None
    return [length, partner], times


def largest_pair(fit: list[int], left, room: int) -> int:
    """Largest sum of two of the lengths that fits."""
    i, j, best = 0, len(fit) - 1, 0
    while i <= j:
        total = fit[i] + fit[j]
        if total > room or (i == j and left(fit[i]) < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: patterns with multiplicities."""
    rooms: list[int] = []                                # rooms that some bins have, sorted
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def add(pattern: list[tuple[int, int]], room: int, times: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, [], n
            each = min(room // length, n)
            used = min(times, n // each)
            if times > used and pattern:
                add(pattern, room, times - used)
            add([*pattern, (length, each)], room - each * length, used)
            n -= used * each
    return [(pattern, times) for held in bins.values() for pattern, times in held]


def slot_rows(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """(length, first rank, how many in one bin, first bin, offset) and the
    number of bins."""
    fixed, rest = reduce_lengths(dict(counts), capacity)
    patterns = [([(x, 1) for x in p], t) for p, t in fixed] + best_fit(rest, capacity)
    used: dict[int, int] = {}
    slots, bins = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            slots.append((length, first, each, bins, offset))
            used[length] = first + each * times
            offset += length * each
        bins += times
    return slots, bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset (and the ids as little-endian 32-bit numbers, if asked for)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())   # the size of the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long"
              + ", ids binary" * with_ids)
    pieces = stored(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col))
                    .mapInArrow(piece_batches(tokenizer, capacity, end_id, with_ids), schema), "pieces")
    by_part = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = slot_rows(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    frame = spark.createDataFrame(slots, "length long, first long, each long, bin long, at long")
    per_length = frame.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first", "each", "bin", "at"))).alias("slots"))
    ranked = pieces.join(shifts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("shift"))
    # at most ``capacity`` rows: bounded whatever the input
    placed = ranked.join(F.broadcast(per_length), "length").withColumn(
        "slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    k = F.col("rank") - F.col("slot.first")
    each = F.col("slot.each")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.bin") + F.floor(k / each)).cast("long").alias("sequence_id"),
        (F.col("slot.at") + (k % each) * F.col("length")).alias("offset"),
        *["ids"] * with_ids)
