"""Exact n-gram Jaccard join with a token-group matrix.

Each text becomes its set of distinct word shingles; equal sets are one node
(their smallest id). Two sets link when ``den * intersection >= num * union``.

1. One pass stores, per row, the set's size, a 128-bit digest and its
   group, and counts all shingles in a fixed-size table of buckets.
2. Similar sets are partitioned into groups: sets of one size band with the
   same least hash. The token-group matrix holds (token, group) for every token that could
   decide a link: a set that links with Q shares one of Q's ``n - ceil(t n) +
   1`` rarest tokens (rarity: the bucket counts, ties by hash; any fixed order
   is right). A group's tokens are the union over its members, each once.
3. Two groups can hold a linked pair only if they share such a token (the
   bound on the overlap is otherwise below what a link needs) and their size
   ranges are compatible. First every group is opened with itself, and per
   token and size band one group (by a hash of a few salts) with the others of
   its band and the next: as many pairs as the matrix has rows, however large a
   group of near copies is. The links found give components. Then every other
   pair of groups that share a token is opened, but for pairs whose members all
   lie in one component already (no link there could change the result) and those
   whose outlines forbid a link: a group's outline is the range of its sizes and
   the parity bits (below) that all and that any of its sets have, which bounds
   how many bits two members differ in from below. Only groups with a partner of
   their own or a neighbouring band that the first opening left out are listed
   for that. Those of an undecided token meet in blocks of ``MEET``, no list of
   pairs is joined; the comparisons of outlines still grow with the square of a
   token's undecided groups, the rows only with that over the block size. Groups over ``BLOCK``
   sets open block by block, small ones together, so a unit of work holds about
   two blocks.
4. An opened unit first sees its members' sizes and parity bitmaps (one bit a
   bucket, flipped by every token): two bitmaps differ in no more bits than the
   sets differ in tokens, so pairs that differ in too many cannot link. Texts
   travel for members that still have a partner; the unit computes whole sets
   again, counts all intersections at once (incidence matrices over the shared
   tokens) and returns a spanning forest of the links it found; every link
   between different sets is checked and none is lost. Components follow.

Defined cases: null and empty texts, and those without words, have size 0 and
link with nothing; with fewer words than a shingle, the whole sequence counts
as one; rows with a null id have no component and link with nothing; rows
with equal ids lie in one component, whatever their texts; texts of any length
are whole sets; other columns are not looked at, so their names cannot clash;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vendorscope.llm.common import by_value, free_worker, shuffle_partitions, stored, trim_memory
from vendorscope.llm.components import components
from vendorscope.llm.shingles import Shingler, mix

by_value(__name__)

UNIT_SQL = "struct<host: bigint, i: int, bundle: int, other: int>"
UNIT = pa.struct([("host", pa.int64()), ("i", pa.int32()), ("bundle", pa.int32()), ("other", pa.int32())])
BUCKET_BITS = 20
CHUNK_BITS = 14
BLOCK = 64
STARS = 4
MEET = 1024
COLUMNS = 8192
MARK_BITS = 1024
MOST_ID_BITS = 1 << 27
MOST_BROADCAST = 100_000


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def first_pass(words: int, bits: int, num: int, den: int):
    """mapInArrow body: (id, text) -> set rows, then the task's bucket counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        shingler, counts = Shingler(words), np.zeros(1 << bits, np.int64)
        names = ["id", "n", "digest", "least", "marks", "chunk", "counts"]
        kind = None
        for b in batches:
            texts, kind = utf8(b.column(1)), b.column(0).type
            sizes, digests, least, marks = [], [], [], []
            held: list[np.ndarray] = []
            for tokens in shingler.sets(texts):
                sizes.append(len(tokens))
                digests.append(digest_of(tokens) if len(tokens) else None)
                least.append(int(group_of(tokens, num, den)[0]) if len(tokens) else None)
                marks.append(parity(tokens) if len(tokens) else None)
                held.append(tokens >> np.uint64(64 - bits))
                if len(held) == 4096:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(least, pa.int64()), pa.array(marks, pa.binary()), none.cast(pa.int32()),
                 none.cast(pa.binary())], names)
        if kind is not None:
            parts = counts.astype(np.uint32).reshape(-1, 1 << min(bits, CHUNK_BITS))
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind), none.cast(pa.int64()), none.cast(pa.binary()),
                 none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)
    return run


def add_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over rows of some chunks: sums by chunk."""
    total: dict[int, np.ndarray] = {}
    for b in frames:
        for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(data, np.uint32).astype(np.int64)
            total[chunk] = total[chunk] + part if chunk in total else part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())],
            ["chunk", "counts"])


def bucket_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """The summed table: 2**bits numbers, whatever the input."""
    chunks = rows.filter("chunk is not null").select("chunk", "counts")
    summed = chunks.repartition(1 << max(0, bits - CHUNK_BITS), "chunk").mapInArrow(
        add_counts, "chunk int, counts binary").collect()
    out = np.zeros((1 << max(0, bits - CHUNK_BITS), 1 << min(bits, CHUNK_BITS)), np.uint32)
    for r in summed:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def parity(tokens: np.ndarray) -> bytes:
    """One bit a bucket: whether an odd number of tokens fall into it."""
    at = ((tokens >> np.uint64(17)) % np.uint64(MARK_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=MARK_BITS) & 1).astype(np.uint8)).tobytes()


def band_of(n: int, num: int, den: int) -> int:
    """Size band; the sizes of linked sets lie in one band or in neighbours."""
    # a little wider than the largest ratio, so rounding cannot part two bands
    return int(0.999 * np.log(n) / np.log(den / num)) if num < den else n


def group_of(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Group of a set (sorted tokens): its least hash and its size band."""
    return mix(tokens[:1] + np.uint64(band_of(len(tokens), num, den))).view(np.int64)


def prefix_size(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1


def token_groups(words: int, bits: int, counts, num: int, den: int):
    """mapInArrow body: (text) -> distinct (token, group, band) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(words), np.frombuffer(counts.value, np.uint32)
        for b in batches:
            out: list[np.ndarray] = []
            for tokens in shingler.sets(utf8(b.column(0))):
                n = len(tokens)
                if not n:
                    continue
                order = np.lexsort((tokens, table[tokens >> np.uint64(64 - bits)]))
                rare = tokens[order[:prefix_size(n, num, den)]]
                pair = np.empty((len(rare), 3), np.uint64)
                pair[:, 0], pair[:, 1] = rare, group_of(tokens, num, den).view(np.uint64)[0]
                pair[:, 2] = band_of(n, num, den)
                out.append(pair)
            if out:
                pairs = np.concatenate(out)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(3)], ["token", "least", "band"])
    return run


def token_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (token, band, group), all rows of a token and band
    together: rows (null, a, b) for the first group of a token and band with the
    others of its band and those of the next, and rows (token, group, band)
    for tokens of three groups or more. Three rows are held between batches."""
    held = np.empty((0, 3), np.int64)
    for b in batches:
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
        if not len(rows):
            continue
        new = np.arange(len(held) + len(rows)) >= len(held)
        rows = np.concatenate([held, rows])
        keep = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        rows, new = rows[keep], new[keep]
        at = np.arange(len(rows))
        first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        runs = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        before = runs[np.maximum(run - 1, 0)]
        near = (rows[before, 0] == rows[:, 0]) & (rows[before, 1] == rows[:, 1] - 1) & (run > 0)
        other = new & (runs[run] != at)
        pairs = np.concatenate([rows[np.stack([at[other], runs[run][other]], 1), 2],
                                rows[np.stack([at[new & near], before[new & near]], 1), 2]])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        token = np.concatenate(([0], np.cumsum(rows[1:, 0] != rows[:-1, 0])))
        size = np.bincount(token)
        size[-1] = 3                                         # goes on in the next batch, perhaps
        size[0] += 3 * (len(held) > 0)                       # began in the last one, where it was listed
        lists = rows[new & (size[token] >= 3)]
        held = rows[[before[-1], runs[-1], len(rows) - 1] if near[-1] else [runs[-1], len(rows) - 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(np.ascontiguousarray(lists[:, 0]))]),
             pa.array(np.concatenate([pairs[:, 0], lists[:, 2]])), pa.array(np.concatenate([pairs[:, 1], lists[:, 1]]))],
            ["token", "a", "b"])


def unmet_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over the rows of ``token_stars``: the pairs, and of the
    rows (token, group, band) those with a partner they have not met. Two groups
    of a band are such partners if neither is the first, groups of neighbouring
    bands if the one of the lower band is not. Six rows are held between batches."""
    held, sent = np.empty((0, 3), np.int64), np.empty(0, bool)           # (token, band, group)
    for b in batches:
        listed = b.column(0).is_valid()
        yield b.filter(b.column(0).is_null())
        rows = np.stack([b.filter(listed).column(k).to_numpy() for k in (0, 2, 1)], 1)
        if not len(rows):
            continue
        rows, sent = np.concatenate([held, rows]), np.concatenate([sent, np.zeros(len(rows), bool)])
        at = np.arange(len(rows))
        runs = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        size = np.diff(np.append(runs, len(rows)))
        run = np.repeat(np.arange(len(runs)), size)
        follows = np.concatenate(([False], (rows[runs[1:], 0] == rows[runs[:-1], 0])
                                  & (rows[runs[1:], 1] == rows[runs[:-1], 1] + 1)))
        under = follows & (np.concatenate(([0], size[:-1])) > 1)         # the run below has more than its first
        over = np.append(follows[1:], False)
        keep = under[run] | ((at != runs[run]) & ((size > 2) | over)[run])
        out = rows[keep & ~sent]
        sent |= keep
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in (0, 2, 1)], ["token", "a", "b"])
        place = at - runs[run]                                           # three rows of a run stand for all of them
        last = (run >= len(runs) - 2) & (place < 3)
        held, sent = rows[last], sent[last]


def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (least, low, high, every, some): one row per group
    of a batch: the range of its sizes, the bits that all and that any of its
    sets have."""
    for b in batches:
        if not b.num_rows:
            continue
        least, low, high = (b.column(k).to_numpy() for k in range(3))
        order = np.argsort(least, kind="stable")
        every, some = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(len(least), -1)[order]
                       for k in (3, 4))
        least, low, high = least[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[first]), pa.array(np.minimum.reduceat(low, first)), pa.array(np.maximum.reduceat(high, first)),
             pa.array([x.tobytes() for x in np.bitwise_and.reduceat(every, first)], pa.binary()),
             pa.array([x.tobytes() for x in np.bitwise_or.reduceat(some, first)], pa.binary())],
            ["least", "low", "high", "every", "some"])


def may_link(num: int, den: int):
    """mapInArrow body over (unit, block, least, band, whole, own, low, high,
    every, some) sorted by unit: the pairs of groups of its two blocks that are
    of different kinds and whose outlines allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(10)))

        for unit, members in groupby(records(), key=lambda r: r[0]):
            rows = list(members)
            block, least, band, whole, own, low, high = (np.array([r[k] for r in rows]) for k in range(1, 8))
            every, some = (np.frombuffer(b"".join(r[k] for r in rows), np.uint64).reshape(len(rows), -1) for k in (8, 9))
            right, found = np.flatnonzero(block == unit["j"]), []
            for x in np.flatnonzero(block == unit["i"]).tolist():
                y = right[right > x] if unit["i"] == unit["j"] else right
                y = y[((own[y] != own[x]) | (whole[y] != whole[x])) & (np.abs(band[y] - band[x]) <= 1)
                      & (low[y] * num <= high[x] * den) & (low[x] * num <= high[y] * den)]
                apart = (np.bitwise_count(every[x] & ~some[y]).sum(axis=1, dtype=np.int64)
                         + np.bitwise_count(every[y] & ~some[x]).sum(axis=1, dtype=np.int64))
                y = y[apart * (den + num) <= (high[x] + high[y]) * (den - num)]
                found.append(np.stack([np.minimum(least[x], least[y]), np.maximum(least[x], least[y])], 1))
            if sum(map(len, found)):
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], ["a", "b"])
    return run


def pairs_left(stars: DataFrame, nodes: DataFrame, found: DataFrame, num: int, den: int, meet: int = MEET) -> DataFrame:
    """Pairs of groups that share a token, are not among the stars' pairs, whose
    members do not all lie in one component and whose outlines allow a link. The
    groups of a token meet in blocks of about ``meet``; those of its most
    common kind meet the others only."""
    parts = shuffle_partitions(nodes.sparkSession)
    home = (nodes.join(found, "node", "left").withColumn("own", F.coalesce("component", "node"))
            .groupBy("least").agg(F.min("own").alias("own"), F.max("own").alias("last")))
    kind = F.struct((F.col("own") == F.col("last")).alias("whole"),
                    F.when(F.col("own") == F.col("last"), F.col("own")).otherwise(F.col("least")).alias("own"))
    lists = (stars.filter("token is not null").select("token", F.col("a").alias("least"), F.col("b").alias("band"))
             .join(home.select("least", kind.alias("kind")), "least"))
    lists = stored(lists.distinct(), "join-lists")
    mixed = lists.groupBy("token").agg(F.min("kind").alias("x"), F.max("kind").alias("y")).filter("x < y")
    lists = stored(lists.join(mixed.select("token"), "token", "left_semi"), "join-undecided")
    blocks = lambda n: F.ceil(n / meet).cast("int")
    sizes = (lists.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("token").agg(F.max(F.struct("n", "kind")).alias("top"), F.sum("n").alias("n"))
             .select("token", F.col("top.kind").alias("main"), blocks(F.col("top.n")).alias("mains"),
                     blocks(F.col("n") - F.col("top.n")).alias("rests")))
    inside = lambda n: F.pmod(F.xxhash64("least"), n).cast("int")
    main, last = F.col("kind") == F.col("main"), F.col("mains") + F.col("rests") - 1
    dealt = lists.join(sizes, "token").select(
        "token", "least", "band", "kind", F.when(main, inside(F.col("mains")))
        .otherwise(F.col("mains") + inside(F.col("rests"))).alias("block"),
        F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), last)).alias("other"))
    shapes = (nodes.join(lists.select("least").distinct(), "least", "left_semi")
              .select("least", F.col("n").alias("low"), F.col("n").alias("high"), F.col("marks").alias("every"),
                      F.col("marks").alias("some")))
    schema = "least long, low long, high long, every binary, some binary"
    shapes = (shapes.mapInArrow(outlines, schema).repartition(parts, "least").sortWithinPartitions("least")
              .mapInArrow(outlines, schema))
    unit = F.struct("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = (dealt.join(shapes, "least")
             .select(unit.alias("unit"), "block", "least", "band", "kind.whole", "kind.own", "low", "high", "every", "some")
             .repartition(parts, "unit").sortWithinPartitions("unit")
             .mapInArrow(may_link(num, den), "a long, b long").distinct())
    return pairs.join(stars.filter("token is null").select("a", "b").distinct(), ["a", "b"], "left_anti")


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Compressed UTF-8, for texts on their way to a unit."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([pack((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


class UnionFind:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def qualify(num: int, den: int):
    """mapInArrow body over (unit, side, node, digest, n, marks) sorted by
    unit: the members that can link with one of the other side, each with the
    least member it is joined to by such pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(6)))

        for _, members in groupby(records(), key=lambda r: r[0]):
            rows = list({r[1:4]: r for r in members}.values())
            side = np.array([r[1] for r in rows])
            n = np.array([r[4] for r in rows])
            marks = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            if not len(left) or (right is left and len(left) < 2):
                continue
            apart = np.stack([np.bitwise_count(marks[i] ^ marks[right]).sum(axis=1) for i in left])
            total = n[left][:, None] + n[right][None, :]
            ok = apart * (den + num) <= total * (den - num)
            if right is left:
                np.fill_diagonal(ok, False)
            kept = np.union1d(left[ok.any(axis=1)], right[ok.any(axis=0)])
            if len(kept):
                forest = UnionFind()
                for i, j in zip(*np.nonzero(ok)):
                    forest.join(rows[left[i]][2], rows[right[j]][2])
                own = [rows[i] for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in own], UNIT), pa.array([r[1] for r in own], pa.int32()),
                     pa.array([r[2] for r in own], pa.int64()), pa.array([r[3] for r in own], pa.binary()),
                     pa.array([forest.find(r[2]) for r in own], pa.int64())],
                    ["unit", "side", "node", "digest", "root"])
    return run


def id_bits(ids: DataFrame, most: int = MOST_ID_BITS) -> tuple[bytes, int]:
    """A bitmap over hashed ids, of about 8 bits an id and at most ``most``
    bits: with more ids it lets more through, never less."""
    n = ids.count()
    bits = 1 << 19
    while bits < min(most, 8 * n):
        bits *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at = (b.column(k).to_numpy() for k in (0, 1))
            for c in np.unique(chunk).tolist():
                held.setdefault(c, np.zeros(1 << 19, bool))[at[chunk == c]] = True
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())],
                ["chunk", "bits"])
    place = F.pmod(F.xxhash64("node", F.lit(41)), F.lit(bits))
    rows = ids.select(F.floor(place / (1 << 19)).alias("chunk"), (place % (1 << 19)).alias("at"))
    out = np.zeros((bits >> 19, 1 << 16), np.uint8)
    for r in rows.repartition(max(1, bits >> 19), "chunk").mapInArrow(build, "chunk long, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes(), bits


def maybe_in(bits):
    """Column function over hashed places: whether the bit is set."""
    @F.pandas_udf("boolean")
    def check(place: pd.Series) -> pd.Series:
        table = np.frombuffer(bits.value, np.uint8)
        at = place.to_numpy()
        return pd.Series((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
    return check


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices over shared tokens."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for a in range(0, len(shared), COLUMNS):
        part = shared[a:a + COLUMNS]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, own)
                m[i, at[part[at] == own]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def verify_units(words: int, num: int, den: int):
    """mapInArrow body over (unit, side, id, digest, packed text) sorted by
    unit: spanning edges of the links between (or within) the unit's sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unpack = Shingler(words), zstandard.ZstdDecompressor().decompress

        def records():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(5)))

        for _, members in groupby(records(), key=lambda r: r[0]):
            sides: dict[int, dict[tuple[int, bytes], np.ndarray]] = {0: {}, 1: {}}
            keys = list({r[1:] for r in members})
            texts = [unpack(x[3]) for x in keys]
            for (side, node, digest, _), tokens in zip(keys, shingler.sets(texts)):
                if digest_of(tokens) == digest:          # another row of this id may have other text
                    sides[side][node, digest] = tokens
            left = sides[0]
            right = sides[1] or left
            if not left or (right is left and len(left) < 2):
                continue
            a, b = list(left), list(right)
            common = intersections(list(left.values()), list(right.values())).astype(np.int64)
            na = np.array([len(left[x]) for x in a])[:, None]
            nb = np.array([len(right[x]) for x in b])[None, :]
            forest = UnionFind()
            for i, j in zip(*np.nonzero(den * common >= num * (na + nb - common))):
                forest.join(a[i][0], b[j][0])
            if edges := forest.edges():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())],
                    ["u", "v"])
    return run


def units_of(groups: DataFrame, pairs: DataFrame, num: int, den: int, block: int, alone: bool) -> DataFrame:
    """(unit, side, least, block): blocks of groups to open together. Of two
    groups the larger is host; a host's blocks each meet its guests in bundles
    of about ``block`` sets, so a large group is not sent out once per guest.
    With ``alone`` every group also meets itself."""
    a, b = (groups.select(F.col("least").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "blocks", "low", "high")])
            for x in ("a", "b"))
    opened = (pairs.distinct().join(a, "a").join(b, "b")
              .filter((F.col("low_a") * num <= F.col("high_b") * den) & (F.col("low_b") * num <= F.col("high_a") * den)))
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    side = lambda c, one, two: F.when(first, F.col(f"{c}{one}")).otherwise(F.col(f"{c}{two}"))
    met = opened.select(side("", "a", "b").alias("host"), side("blocks_", "a", "b").alias("host_blocks"),
                        side("", "b", "a").alias("guest"), side("blocks_", "b", "a").alias("guest_blocks"),
                        side("n_", "b", "a").alias("guests"))
    bundles = met.groupBy("host").agg(F.ceil(F.sum("guests") / block).cast("int").alias("bundles"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    met = met.join(bundles, "host").select("host", "host_blocks", "bundles", "guest", upto("guest_blocks").alias("j"))
    met = met.withColumn("bundle", F.pmod(F.xxhash64("guest", "j"), F.col("bundles")).cast("int"))
    unit = F.struct("host", "i", "bundle", F.lit(-1).alias("other")).alias("unit")
    guests = met.withColumn("i", upto("host_blocks")).select(
        unit, F.lit(1).alias("side"), F.col("guest").alias("least"), F.col("j").alias("block"))
    hosts = met.select("host", "host_blocks", "bundle").distinct().withColumn("i", upto("host_blocks")).select(
        unit, F.lit(0).alias("side"), F.col("host").alias("least"), F.col("i").alias("block"))
    if not alone:
        return guests.unionByName(hosts)
    own = (groups.filter("n > 1").select(F.col("least").alias("host"), "blocks", upto("blocks").alias("i"))
           .withColumn("other", upto("blocks")).filter("i <= other"))
    own_unit = F.struct("host", "i", F.lit(-1).alias("bundle"), "other").alias("unit")
    one = F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))
    two = F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")),
                  F.struct(F.lit(1).alias("side"), F.col("other").alias("block")))
    selves = (own.select(own_unit, F.col("host").alias("least"),
                         F.explode(F.when(F.col("i") == F.col("other"), one).otherwise(two)).alias("s"))
              .select("unit", "s.side", "least", "s.block"))
    return guests.unionByName(hosts).unionByName(selves)


def gathered(met: DataFrame, block: int) -> DataFrame:
    """(unit, side, node, digest): where members meet for the exact check. Those
    that possible pairs join into a set of up to two blocks meet once, in a
    unit of their own; larger sets stay in the units they came from."""
    found = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")), "join-possible")
    placed = (met.join(found.withColumnRenamed("node", "u"), met["node"] == F.col("u"), "left")
              .withColumn("own", F.coalesce("component", "node")).drop("u", "component"))
    sizes = placed.groupBy("own").agg(F.count_distinct("node").alias("members"))
    placed = placed.join(sizes, "own")
    small = F.col("members") <= 2 * block
    alone = F.struct(F.col("own").alias("host"), F.lit(0).alias("i"), F.lit(-2).alias("bundle"), F.lit(-2).alias("other"))
    return placed.select(F.when(small, alone).otherwise(F.col("unit")).alias("unit"),
                         F.when(small, F.lit(0)).otherwise(F.col("side")).alias("side"), "node", "digest").distinct()


def links(texts: DataFrame, placed: DataFrame, units: DataFrame, words: int, num: int, den: int, block: int,
          most_broadcast: int) -> DataFrame:
    """(u, v): edges that join the nodes which links inside the units join."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    members = placed.join(units, ["least", "block"]).select("unit", "side", "node", "digest", "n", "marks")
    met = stored(members.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(
        qualify(num, den), f"unit {UNIT_SQL}, side int, node long, digest binary, root long"), "join-met")
    wanted = stored(gathered(met, block), "join-members")
    known, some, bits = texts.filter("id is not null"), wanted, None
    if wanted.count() <= most_broadcast:                 # stored and counted: small enough to send to every task
        some = F.broadcast(wanted)
    else:
        # most texts have no partner: a bitmap of bounded size keeps them out of the shuffle
        table, size = id_bits(wanted.select("node").distinct())
        bits = spark.sparkContext.broadcast(table)
        known = known.withColumn("place", F.pmod(F.xxhash64("id", F.lit(41)), F.lit(size)))
        known = known.filter(maybe_in(bits)("place"))
    opened = known.join(some, known["id"] == some["node"]).select(
        "unit", "side", "node", "digest", packed("text").alias("text"))
    edges = stored(opened.repartition(parts, "unit").sortWithinPartitions("unit")
                   .mapInArrow(verify_units(words, num, den), "u long, v long"), "join-links")
    if bits is not None:
        bits.destroy()
    return edges


def same_ids(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the id of rows with different sets, with each set's node."""
    several = (sets.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
               .filter("x < y").select("id"))
    return (sets.select("id", "digest").join(several, "id").join(nodes.select("digest", "node"), "digest")
            .select(F.col("id").alias("u"), F.col("node").alias("v")))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text", bits: int = BUCKET_BITS, block: int = BLOCK,
                       most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row: id, n_shingles, component_id."""
    spark = docs.sparkSession
    trim_memory()                                        # the driver's, of whatever ran before
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, digest binary, least long, marks binary, chunk int, counts binary"
    rows = stored(texts.mapInArrow(first_pass(words, bits, num, den), schema), "shingle-sets")
    counts = spark.sparkContext.broadcast(bucket_counts(rows, bits).tobytes())
    sets = rows.filter("chunk is null").select("id", "n", "digest", "least", "marks")
    named = sets.filter("digest is not null and id is not null")
    nodes = stored(named.groupBy("digest").agg(
        F.min("id").alias("node"), F.first("n").alias("n"), F.first("least").alias("least"),
        F.first("marks").alias("marks")), "join-nodes")
    groups = nodes.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("low"), F.max("n").alias("high"))
    groups = stored(groups.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "join-groups")
    matrix = texts.select("text").mapInArrow(token_groups(words, bits, counts, num, den),
                                              "token long, least long, band long").select("token", "band", "least")
    order = F.xxhash64("least", F.col("token").bitwiseAND(F.lit(STARS - 1)))
    stars = stored(matrix.repartition(shuffle_partitions(spark), "token")
                   .sortWithinPartitions("token", "band", order, "least")
                   .mapInArrow(lambda rows: unmet_groups(token_stars(rows)), "token long, a long, b long"), "join-stars", None)
    counts.destroy()
    # members of the groups that are opened, each with its block
    placed = nodes.join(groups.select("least", "blocks"), "least").withColumn(
        "block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    units = stored(units_of(groups, stars.filter("token is null").select("a", "b"), num, den, block, True), "join-units")
    edges = links(texts, placed, units, words, num, den, block, most_broadcast).unionByName(same_ids(named, nodes))
    found = components(edges, "join-edges")
    trim_memory()
    left = stored(pairs_left(stars, nodes, found, num, den), "join-left")
    if not left.isEmpty():
        units = stored(units_of(groups, left, num, den, block, False), "join-units")
        edges = links(texts, placed, units, words, num, den, block, most_broadcast)
        found = components(edges.unionByName(found.toDF("u", "v")), "join-edges")
    # copies follow their set's node; a row without links is its own component
    home = nodes.select("digest", "node").join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return (sets.join(home, "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest; rows without
    an id stay."""
    found = jaccard_components(docs, id_col=id_col, **options)
    lost = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_lost_id")).distinct()
    return docs.join(lost, docs[id_col] == lost["_lost_id"], "left_anti")
