"""Phrase collocations by stripes.

A prefix (one word, or two) keys an associative counter of the words that
follow it within a piece: its stripe. Tasks count stripes of a slice of texts,
and stripes of one prefix are merged elementwise. A merged stripe gives the
prefix's extensions and their counts, the prefix's total (the ends of pieces are
counted in it too) and the largest extension, which is the subsumption maximum.

1. Stripes of one word: totals are f(word), entries f(w1 w2).
2. Stripes of two words, counted only where both inner pairs may be frequent (a
   phrase is never more frequent than its parts): a bit map of bounded size holds
   the frequent pairs; what it lets pass by chance is counted and found rare.
3. Scores, cuts, subsumption and ranks are relational steps over the frequent
   phrases, in exact decimals.

Skew: stripes of a prefix that holds more than a quarter of a partition's share
of all counts are split into blocks by a hash of the next word (as many as the
share needs); totals and maxima of blocks add up. Stripes arrive sorted by prefix
and are merged in bounded chunks, so a task holds a chunk and one block, and
Spark's sort spills. A stripe travels as two values (its words joined by spaces,
its counts as 32-bit numbers), not as nested arrays.
A language's best ``top`` are ranked in two steps, so no task sorts a language.

Sent to the driver: the bit map (2**22 numbers at most); broadcast: it and the
heavy prefixes (4 a partition at most).

Defined cases: A-Z are lower-cased, pieces end at ``.,;:!?`` and 0x0A-0x0D, words
are runs of other characters than space and tab; a null text counts as empty,
null, empty and blank texts have no words; a null lang is ``und`` (and shares it);
very long texts are one slice of their own; repeated rows count each time; ties
in score go by count, then by the phrase's UTF-8 bytes; an empty table has no
phrases; only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, free_worker, shuffle_partitions, stored
from vendorscope.llm.pretokens import Numbers
from vendorscope.llm.shingles import byte_slices, mix

by_value(__name__)

MIN_COUNT = 10
TOP = 2000
SLICE_BYTES = 8_000_000
#: Heavy prefixes hold more than 1 / (HEAVY * partitions) of all counts.
HEAVY = 4
MIN_BITS, MAX_BITS, BITS_PER_PAIR = 16, 28, 16
END = b"\xff"                                       # not a byte of UTF-8
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + ENDS, bytes(range(97, 123)) + b" " + END * len(ENDS))
STRIPES = "lang string, prefix string, total long, nexts string, counts binary"
CHUNK = 1_000_000                                   # entries merged at once


class Words:
    """The words of texts as numbers; 0 ends a piece."""

    def __init__(self, texts: list[bytes]):
        data = END.join(texts).translate(FOLD) + END
        numbers = Numbers({END: 0})
        tokens = data.replace(END, b" " + END + b" ").split()
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(numbers)
        self.names = pa.array(self.words, pa.binary()).view(pa.string())

    def pair_prints(self, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        return pair_print(lang, own[first], own[second])


def pair_print(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second + salt))


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) in slices of about ``SLICE_BYTES``; the languages together
    hold twice that at most (and one batch)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
        while sizes and (max(sizes.values()) >= SLICE_BYTES or sum(sizes.values()) >= 2 * SLICE_BYTES):
            lang = max(sizes, key=sizes.get)
            del sizes[lang]
            own = held.pop(lang)
            for lo, hi in byte_slices(own, SLICE_BYTES):
                yield lang, own[lo:hi]
    yield from held.items()


def packed(words: pa.Array, counts: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The entries between offsets as two values a row. A stripe's counts are
    those of one slice or block, so they fit 32 bits; larger ones are an error."""
    if len(counts) and counts.max() >= 1 << 32:
        raise OverflowError("a stripe's count exceeds 32 bits")
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    raw = pa.py_buffer(np.ascontiguousarray(counts, "<u4"))
    return (pc.binary_join(lists, " "),
            pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), raw]))


def unpacked(nexts: pa.Array, counts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words and counts of all rows in a row, and each row's number of entries."""
    sizes = pc.binary_length(counts).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    words = pc.split_pattern(nexts.filter(pa.array(sizes > 0)), " ").flatten()
    return words, np.frombuffer(b"".join(counts.to_pylist()), "<u4").astype(np.int64), sizes


def stripe_batch(lang: str, prefixes: pa.Array, codes: np.ndarray, counts: np.ndarray, names: pa.Array):
    """Stripes of sorted codes (prefix number << 32 | next word's number)."""
    own = codes >> 32
    first = np.flatnonzero(np.diff(own, prepend=-1))
    totals = np.add.reduceat(counts, first) if len(first) else counts
    real = (codes & 0xFFFFFFFF) != 0
    offsets = np.concatenate(([0], np.cumsum(real)))[np.append(first, len(codes))]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(first), pa.string()), prefixes.take(pa.array(own[first])), pa.array(totals),
         *packed(names.take(pa.array(codes[real] & 0xFFFFFFFF)), counts[real], offsets)],
        ["lang", "prefix", "total", "nexts", "counts"])


def word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (lang, text) -> stripes of one word."""
    free_worker()
    for lang, texts in by_lang(batches):
        w = Words(texts)
        at = np.flatnonzero(w.ids[:-1])
        if len(at):
            codes, counts = np.unique(w.ids[at] << 32 | w.ids[at + 1], return_counts=True)
            yield stripe_batch(lang, w.names, codes, counts, w.names)


def pair_stripes(bits):
    """mapInArrow body: (lang, text) -> stripes of two words whose pairs, and
    the pairs that they form with the next word, may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        table = bits.value
        mask = np.uint64(len(table) * 8 - 1)
        for lang, texts in by_lang(batches):
            w = Words(texts)
            at = np.flatnonzero((w.ids[:-1] != 0) & (w.ids[1:] != 0))
            pairs, inverse = np.unique(w.ids[at] << 32 | w.ids[at + 1], return_inverse=True)
            first, second = pairs >> 32, pairs & 0xFFFFFFFF
            bit = w.pair_prints(lang, first, second) & mask
            may = (table[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            number = np.full(len(w.ids), -1)
            number[at] = np.where(may, np.arange(len(pairs)), -1)[inverse]
            at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
            if len(at):
                codes, counts = np.unique(number[at] << 32 | w.ids[at + 2], return_counts=True)
                names = pc.binary_join_element_wise(w.names.take(pa.array(first)), w.names.take(pa.array(second)), " ")
                yield stripe_batch(lang, names, codes, counts, w.names)
    return run


def in_blocks():
    """mapInArrow body: heavy prefixes' stripes with their number of blocks ->
    stripes split by their next words, with a block number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in batches:
            if not split.num_rows:
                continue
            words, counts, sizes = unpacked(split.column(3), split.column(4))
            coded, dealt = words.dictionary_encode(), split.column(5).to_numpy()
            sums = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            block = sums[coded.indices.to_numpy()] % dealt[row] if len(row) else row
            key = row << 32 | block
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            own = row[order][first]
            # the total goes with a row's first block
            totals = np.where(np.diff(own, prepend=-1) != 0, split.column(2).to_numpy()[own], 0)
            yield pa.RecordBatch.from_arrays(
                [split.column(0).take(pa.array(own)), split.column(1).take(pa.array(own)), pa.array(totals),
                 *packed(words.take(pa.array(order)), counts[order], np.append(first, len(key))),
                 pa.array((key[first] & 0xFFFFFFFF).astype(np.int32))],
                ["lang", "prefix", "total", "nexts", "counts", "block"])
    return run


def merge(min_count: int):
    """mapInArrow body: stripes sorted by (lang, prefix, block) -> one row a
    key: total, largest entry, and the entries of at least ``min_count``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        entries, rest, limit = 0, None, CHUNK
        for b in batches:
            held.append(b)
            entries += b.column(4).nbytes // 4
            if entries >= limit:
                done, rest = merge_chunk(held, rest, min_count, False)
                yield done
                held, entries = [], 0
                limit = max(CHUNK, 2 * len(rest[2]))        # an open stripe is merged again less and less often
        if held or rest is not None:
            yield merge_chunk(held, rest, min_count, True)[0]
    return run


def merge_chunk(held: list[pa.RecordBatch], rest, min_count: int, last: bool):
    """Merged stripes of all keys but the last one, which may go on (with
    ``last`` of that one too), and the open stripe: (key, total, words, counts)."""
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns] if held else None
    keys = [pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int32())]
    totals, words = np.zeros(0, np.int64), pa.array([], pa.string())
    counts, sizes = totals, totals
    if held:
        keys = [columns[0], columns[1], columns[5]]
        totals = columns[2].to_numpy()
        words, counts, sizes = unpacked(columns[3], columns[4])
    if rest is not None:
        keys = [pa.concat_arrays([pa.array([k], x.type), x]) for k, x in zip(rest[0], keys)]
        totals = np.append(rest[1], totals)
        words = pa.concat_arrays([rest[2], words])
        counts, sizes = np.concatenate((rest[3], counts)), np.append(len(rest[2]), sizes)
    rows = len(totals)
    new = np.ones(rows, bool)
    if rows > 1:
        new[1:] = np.any([pc.not_equal(k.slice(1), k.slice(0, rows - 1)).to_numpy(zero_copy_only=False) for k in keys], axis=0)
    first = np.flatnonzero(new)
    key = np.repeat(np.cumsum(new) - 1, sizes)
    coded = words.dictionary_encode()
    width = max(1, len(coded.dictionary))
    code = key * width + coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.diff(code, prepend=-1))
    code = code[at]
    counts = np.add.reduceat(counts[order], at) if len(at) else counts
    key, word = code // width, code % width
    totals = np.add.reduceat(totals, first) if rows else totals
    rest = None
    n = len(first)
    if not last and n:
        n -= 1
        own = key == n
        rest = ([k[int(first[n])].as_py() for k in keys], totals[n], coded.dictionary.take(pa.array(word[own])), counts[own])
        key, word, counts = key[~own], word[~own], counts[~own]
    best = np.zeros(n, np.int64)
    np.maximum.at(best, key, counts)
    often = counts >= min_count
    offsets = pa.array(np.searchsorted(key[often], np.arange(n + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [keys[0].take(pa.array(first[:n])), keys[1].take(pa.array(first[:n])), pa.array(totals[:n]), pa.array(best),
         pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(word[often]))),
         pa.ListArray.from_arrays(offsets, pa.array(counts[often]))],
        ["lang", "prefix", "total", "best", "nexts", "counts"]), rest


def merged(stripes: DataFrame, min_count: int, name: str) -> DataFrame:
    """Stored merged stripes (lang, prefix, total, best, nexts, counts); a
    heavy prefix has a row a block."""
    spark, parts = stripes.sparkSession, shuffle_partitions(stripes.sparkSession)
    whole = stripes.agg(F.sum("total")).first()[0] or 0
    heavy = (stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("total"))
             .filter(F.col("total") * HEAVY * parts > whole)
             .selectExpr("lang", "prefix", f"1 + total * {HEAVY * parts} div {max(whole, 1)} as blocks"))
    heavy = F.broadcast(stored(heavy, "heavy"))                                  # HEAVY * parts rows at most
    # a stripe without a next word (only ends of pieces) has nothing to split
    dealt = stripes.join(heavy, ["lang", "prefix"], "left").withColumn("split", F.expr("blocks is not null and nexts <> ''"))
    columns = ["lang", "prefix", "total", "nexts", "counts"]
    rows = (dealt.filter("not split").select(*columns, F.lit(0).alias("block"))
            .unionByName(dealt.filter("split").select(*columns, "blocks").mapInArrow(in_blocks(), STRIPES + ", block int"))
            # a hash first: the sort's first eight bytes then tell nearly all keys apart
            .withColumn("h", F.xxhash64("lang", "prefix", "block"))
            .repartition(parts, "h").sortWithinPartitions("h", "lang", "prefix", "block").drop("h")
            .mapInArrow(merge(min_count), "lang string, prefix string, total long, best long, "
                                          "nexts array<string>, counts array<long>"))
    return stored(rows, name)


def frequent_map(pairs: DataFrame) -> np.ndarray:
    """Bits of (lang, w1, w2), packed on the executors."""
    bits = min(max((pairs.count() * BITS_PER_PAIR).bit_length(), MIN_BITS), MAX_BITS)
    mask = np.uint64((1 << bits) - 1)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, one, two = (c.to_pylist() for c in b.columns)
            own = [np.array([xxhash.xxh64_intdigest(w) for w in c], np.uint64) for c in (one, two)]
            bit = np.zeros(len(lang), np.uint64)
            for name in set(lang):
                at = np.array([x == name for x in lang])
                bit[at] = pair_print(name, own[0][at], own[1][at]) & mask
            yield pa.RecordBatch.from_arrays(
                [pa.array((bit >> np.uint64(6)).view(np.int64)),
                 pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["slot", "word"])

    words = (pairs.select("lang", "w1", "w2").mapInArrow(marks, "slot long, word long")
             .groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["slot"].to_numpy()] = words["word"].to_numpy()
    return table.astype("<i8").view(np.uint8)


def entries(stripes: DataFrame) -> DataFrame:
    """(lang, prefix, next, a): the frequent entries of merged stripes."""
    return stripes.selectExpr("lang", "prefix", "inline(arrays_zip(nexts, counts))").selectExpr(
        "lang", "prefix", "nexts as next", "counts as a")


def score(left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), in decimals of 38 digits."""
    a, x, y = (f"cast({c} as decimal(19,0))" for c in ("a", left, right))
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {a} * {a}) div ({x} * {y})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 share: int = 50, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of two or three words a language: lang, rank,
    phrase, a, l, r, n, score. ``share``: per cent of a phrase's count that a
    longer candidate must reach to drop it."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).alias("text"))
    ones = merged(stored(texts.mapInArrow(word_stripes, STRIPES), "stripes-1"), min_count, "merged-1")
    words = stored(ones.groupBy("lang", F.col("prefix").alias("word")).agg(F.sum("total").alias("f")), "words")
    pairs = stored(entries(ones).selectExpr("lang", "prefix as w1", "next as w2", "a"), "pairs")
    bits = spark.sparkContext.broadcast(frequent_map(pairs))
    stripes = stored(texts.mapInArrow(pair_stripes(bits), STRIPES), "stripes-2")
    bits.destroy()
    twos = merged(stripes, min_count, "merged-2")
    triples = (entries(twos).withColumn("w", F.split("prefix", " "))
               .select("lang", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.col("next").alias("w3"), "a"))

    frequent = words.filter(F.col("f") >= min_count)
    word_f = {k: frequent.select("lang", F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2, 3)}
    # the largest extension on either side
    right = (twos.filter(F.col("best") >= min_count).withColumn("w", F.split("prefix", " "))
             .select("lang", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), "best"))
    left = triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("best"))
    within = right.unionByName(left).groupBy("lang", "w1", "w2").agg(F.max("best").alias("best"))
    two = (pairs.join(within, ["lang", "w1", "w2"], "left")
           .filter(F.col("best").isNull() | (100 * F.col("best") < share * F.col("a")))
           .join(word_f[1], ["lang", "w1"]).join(word_f[2], ["lang", "w2"])
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a",
                   F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score")))
    f12 = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"))
    f23 = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = (triples.join(f12, ["lang", "w1", "w2"]).join(f23, ["lang", "w2", "w3"])
             .join(word_f[1], ["lang", "w1"]).join(word_f[3], ["lang", "w3"])
             .withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3"))
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                     F.when(F.col("s1") <= F.col("s2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
                     F.when(F.col("s1") <= F.col("s2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
                     F.least("s1", "s2").alias("score")))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(spark)))
    some = (two.unionByName(three).withColumn("part", dealt)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
            .filter(F.col("rank") <= top).drop("part", "rank"))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
            .filter(F.col("rank") <= top).join(n, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
