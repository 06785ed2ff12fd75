"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE (``tokenizers`` file), B a BPE over pieces with byte
fallback (``sentencepiece`` model). Both encode space + text. Byte offsets where
tokens of both end cut the text into groups.

Groups come from diagonal run skipping: both token sequences are arrays of end
offsets. At index shift s (B's index less A's) the aligner probes blocks of
doubling size for equal ends, closes in on the end of the run by halving, and
jumps it whole: its tokens are one to one. At an end that differs, the group is
walked token by token until both end together, which gives the next shift.

1. One pass: a slice's texts are split at spaces after a non-space, which neither
   tokenizer's tokens cross, so its ends are common; a stretch is encoded and
   aligned once in a worker, and texts' groups and links are those of their
   stretches in a row. Per document its counts, group digest, distinct linked
   id pairs and how often each is linked are stored.
2. Documents a pair (pre-aggregated in every task), and the highest number of an A id.
3. Sums over links: pairs and counts are broadcast while they are ``BROADCAST_PAIRS``
   at most (16 bytes each), else pairs are joined, Spark picking how.

Defined cases: null and empty texts, and those whose tokens of A or B do not spell
space + text in bytes (as where B maps U+2581 to a space), have no tokens: zeros
and an empty digest; the longest text is one slice; ties for an A id's highest count all are
best; repeated rows are documents of their own; an empty table gives an empty
result; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorscope.llm.common import by_value, free_worker, stored, task_number, trim_memory, worker_kept
from vendorscope.llm.pretokens import Numbers, slices

by_value(__name__)

BROADCAST_PAIRS = 4_000_000
SLICE_CHARS = 700_000
MAX_STRETCHES = 600_000
SPLIT = re.compile(r"(?<=\S)(?= )")
LOOSE = re.compile(r"\s ")
SPACE = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def run_length(a: bytes, b: bytes, i: int, j: int, most: int) -> int:
    """How many of the next ``most`` 4-byte ends are equal from a's i-th and
    b's j-th on, by probing doubling blocks and closing in by halves."""
    done, step = 0, 1
    while done + step <= most and a[4 * (i + done):4 * (i + done + step)] == b[4 * (j + done):4 * (j + done + step)]:
        done += step
        step *= 2
    while step > 1:
        step //= 2
        if done + step <= most and a[4 * (i + done):4 * (i + done + step)] == b[4 * (j + done):4 * (j + done + step)]:
            done += step
    return done


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """The groups that are not one to one as (first a, end a, first b, end b),
    and the index pairs linked in them. Ends ascend; the last ones are equal."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = (np.ascontiguousarray(e, "<u4").tobytes() for e in (ends_a, ends_b))
    groups, link_a, link_b = [], [], []
    i = shift = 0
    n, m = len(a), len(b)
    while i < n:
        i += run_length(raw_a, raw_b, i, i + shift, min(n - i, m - i - shift))
        if i == n:
            break
        first, j = i, i + shift
        start = j
        x, y = a[i], b[j]
        link_a.append(i)
        link_b.append(j)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            link_a.append(i)
            link_b.append(j)
        i, j = i + 1, j + 1
        groups.append((first, i, start, j))
        shift = j - i
    return groups, link_a, link_b


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(printable)]
    return {chr(x): x for x in printable} | {chr(0x100 + k): x for k, x in enumerate(others)}


def split(text: str) -> list[str]:
    """The stretches of space + text, without the space that each starts with."""
    whole = " " + text
    return [s[1:] for s in SPLIT.split(whole)] if LOOSE.search(whole) else text.split(" ")


class Pair:
    """Both tokenizers, and the stretches that they encoded so far, aligned."""

    def __init__(self, definition: str, model: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.one = Tokenizer.from_str(definition)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_proto=model)
        stand = byte_level()
        tokens = [self.one.id_to_token(k) for k in range(self.one.get_vocab_size())]
        self.bytes_a = [bytes(stand[c] for c in t) if all(c in stand for c in t) else t.encode() for t in tokens]
        self.bytes_b = []
        for k in range(self.two.get_piece_size()):
            piece = self.two.id_to_piece(k)
            as_byte = BYTE.match(piece) if self.two.is_byte(k) else None
            self.bytes_b.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace(SPACE, " ").encode())
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.only_space = [self.two.piece_to_id(SPACE)]
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.vocab = (n, m)
        # decimal ids with what follows them: within and at the end of a group's part
        self.decimals = [f"{k}{end}" for size, ends in ((n, ",|"), (m, ",;")) for end in ends for k in range(size)]
        self.widths = np.array([len(x) for x in self.decimals], np.int64)
        self.reset()

    def reset(self) -> None:
        self.numbers = Numbers()
        self.counts = tuple(array("q") for _ in range(3))       # n_a, n_b, n_groups of every stretch
        self.links, self.offsets = array("q"), array("q", [0])  # linked id pairs, and where each stretch's begin
        self.lines: list[str] = []
        self.spelt = array("b")

    def encode(self, keys: list[str]) -> None:
        for lo in range(0, len(keys), 2000):
            some = keys[lo:lo + 2000]
            first = [e.ids for e in self.one.encode_batch([" " + k for k in some], add_special_tokens=False)]
            second = self.two.encode(some, num_threads=1)
            second = [y or self.only_space for y in second]
            raw = [b" " + key.encode() for key in some]
            ends, whole, spelt = np.cumsum([len(r) for r in raw]), b"".join(raw), True
            flat, counts = [], []
            for own, sizes, table in zip((first, second), self.sizes, (self.bytes_a, self.bytes_b)):
                counts.append(np.array([len(x) for x in own], np.int64))
                total = np.cumsum(counts[-1])
                flat.append(np.fromiter(chain.from_iterable(own), np.int64, total[-1]))
                # all keys are spelt when their bytes in a row are, and end where theirs do
                spelt = (spelt and b"".join(map(table.__getitem__, flat[-1].tolist())) == whole
                         and np.array_equal(np.concatenate(([0], np.cumsum(sizes[flat[-1]])))[total], ends))
            ok = np.array([spelt or (b"".join([self.bytes_a[k] for k in x]) == r and b"".join([self.bytes_b[k] for k in y]) == r)
                           for x, y, r in zip(first, second, raw)], bool)
            if not ok.all():                                    # the others' tokens are not aligned
                flat, counts = [f[np.repeat(ok, c)] for f, c in zip(flat, counts)], [c * ok for c in counts]
            self.align(*flat, *counts)
            self.spelt.frombytes(ok.astype(np.int8).tobytes())

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Keep the groups and links of stretches, whose tokens come in a row."""
        groups, link_a, link_b = align(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)     # the last token of its group's part
        one_a, one_b = np.ones(len(a), bool), np.ones(len(b), bool)       # in a group of one to one
        if groups:
            g = np.array(groups)
            for one, last, lo, hi in ((one_a, last_a, g[:, 0], g[:, 1]), (one_b, last_b, g[:, 2], g[:, 3])):
                step = np.zeros(len(one) + 1, np.int64)
                step[lo] += 1
                step[hi] -= 1
                one[:] = np.cumsum(step[:-1]) == 0
                last[:] = one
                last[hi - 1] = True
        i = np.concatenate((np.flatnonzero(one_a), np.array(link_a, np.int64)))
        j = np.concatenate((np.flatnonzero(one_b), np.array(link_b, np.int64)))
        key = np.repeat(np.arange(len(n_a)), n_a)
        order = np.argsort(key[i], kind="stable")
        self.links.frombytes((a[i] * self.vocab[1] + b[j])[order].tobytes())
        self.offsets.frombytes((self.offsets[-1] + np.cumsum(np.bincount(key[i], minlength=len(n_a)))).tobytes())
        for own, n in zip(self.counts, (n_a, n_b, np.bincount(key[last_a], minlength=len(n_a)))):
            own.frombytes(n.astype(np.int64).tobytes())

        # A's and B's tokens of every group in turn, as numbers of decimals
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], stop_b))[group_a]] = a + last_a * self.vocab[0]
        order[np.arange(len(b)) + stop_a[group_b]] = b + last_b * self.vocab[1] + 2 * self.vocab[0]
        line = "".join(map(self.decimals.__getitem__, order.tolist()))
        cuts = np.concatenate(([0], np.cumsum(self.widths[order])))[np.cumsum(n_a + n_b)].tolist()
        self.lines += [line[x:y] for x, y in zip([0, *cuts], cuts)]

    def stretches(self, texts: Sequence[str | None]) -> list[array]:
        """The numbers of every text's stretches, none for those without tokens."""
        if len(self.numbers) > MAX_STRETCHES:
            self.reset()
        known, number = len(self.numbers), self.numbers.__getitem__
        rows = [array("q", map(number, split(t))) if t else array("q") for t in texts]
        new = list(islice(self.numbers, known, None))
        if new:
            self.encode(new)
        spelt = np.frombuffer(self.spelt, np.int8) if len(self.spelt) else np.zeros(0, np.int8)
        return [r if len(r) and spelt[np.frombuffer(r, np.int64)].all() else array("q") for r in rows]


def aligned_batches(files, id_type: pa.DataType):
    """mapInArrow body: (id, text) -> one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, model = files.value
        pair = worker_kept(("pair", definition, hashlib.sha256(model).digest()), lambda: Pair(definition, model))
        key = task_number() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + hi - lo)), b.column(0).slice(lo, hi - lo).cast(id_type),
                     *documents(pair, texts[lo:hi])],
                    ["row_key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                key += hi - lo
        trim_memory()
    return run


def documents(pair: Pair, texts: Sequence[str | None]) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of texts."""
    def view(own: array) -> np.ndarray:
        # the tables of a worker are far larger than a slice
        return np.frombuffer(own, np.int64) if len(own) else np.zeros(0, np.int64)

    rows, n = pair.stretches(texts), len(texts)
    flat = np.concatenate([view(r) for r in rows])
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    sums = [np.diff(np.concatenate(([0], np.cumsum(view(c)[flat])))[ends]) for c in pair.counts]
    at = view(pair.offsets)
    first, count = at[flat], at[flat + 1] - at[flat]
    total = np.concatenate(([0], np.cumsum(count)))
    n_links = np.diff(total[ends])
    linked = view(pair.links)[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
    codes = np.int64(pair.vocab[0] * pair.vocab[1])
    keys, times = np.unique(np.repeat(np.arange(n), n_links) * codes + linked, return_counts=True)
    offsets = np.searchsorted(keys, np.arange(n + 1) * codes)
    line, shas = pair.lines.__getitem__, []
    for row in rows:
        text = "".join(map(line, row))[:-1]
        shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
    return [*(pa.array(x) for x in (*sums, n_links)), pa.array(shas, pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys % codes)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times, pa.int32()))]


def sum_links(table):
    """mapInArrow body: documents -> documents with n_best and count_sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        codes, docs, best = table.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(codes, pairs.flatten().to_numpy(zero_copy_only=False))
            bounds = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))))
            sums = [np.concatenate(([0], np.cumsum(times * x[at])))[bounds] for x in (best, docs)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")),
                 *(pa.array(np.diff(s).astype(np.int64)) for s in sums), b.column("groups_sha256")],
                ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str, text_col: str = "text",
            id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """Stored documents (row_key, id, n_a, n_b, n_groups, n_links, groups_sha256,
    pairs, times) and the size of B's vocabulary: a pair is a * size + b."""
    from pyspark.sql.pandas.types import to_arrow_type
    import sentencepiece
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:
        definition, model = f.read(), g.read()
    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    files = docs.sparkSession.sparkContext.broadcast((definition, model))
    id_type = docs.schema[id_col].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("id", id_type), *longs,
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.ArrayType(T.LongType())),
                           T.StructField("times", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        aligned_batches(files, to_arrow_type(id_type)), schema)
    rows = stored(rows, "aligned")
    files.destroy()
    return rows, size_b


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """Stored (pair, docs, best): documents that hold the pair, and whether no
    other pair of its A id is held by more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")),
                    "pair-counts")
    a = F.floor(F.col("pair") / F.lit(size_b)).alias("a")
    most = counts.groupBy(a).agg(F.max("docs").alias("most"))
    return stored(counts.withColumn("a", a).join(most, "a")
                  .select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), "pair-best")


def align_tokenizers(docs: DataFrame, byte_bpe: str, piece_bpe: str, text_col: str = "text", id_col: str = "doc_id",
                     broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    rows, size_b = aligned(docs, byte_bpe, piece_bpe, text_col, id_col)
    counts = pair_counts(rows, size_b)
    head = ["n_a", "n_b", "n_groups", "n_links"]
    if counts.count() > broadcast_pairs:
        sums = (rows.selectExpr("row_key", "inline(arrays_zip(pairs, times))").withColumnRenamed("pairs", "pair")
                .join(counts, "pair").groupBy("row_key")
                .agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                     F.sum(F.col("times") * F.col("docs")).alias("count_sum")))
        return rows.join(sums, "row_key", "left").select(
            F.col("id").alias(id_col), *head,
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
    table = counts.orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           *(T.StructField(c, T.LongType()) for c in (*head, "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])
    return rows.mapInArrow(sum_links(shared), schema).withColumnRenamed("id", id_col)
