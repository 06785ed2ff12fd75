"""Language-model scoring with a hierarchical Pitman-Yor process.

Model: a root restaurant over all token types (base: uniform over the V known
types and one unknown) and one context restaurant per distinct previous token
(its 64-bit hash; START before a text), all with the root as parent.
P(w | u) = (c_uw - d t_uw) / (s + c_u) + (s + d t_u) / (s + c_u) P(w).

Seating: how many tables t serve each dish is sampled by Gibbs, one (context,
dish) block at a time given all others: its customers are seated in turn, the
i-th opens a table with probability a / (a + i - d t), a = (s + d t_u) P(w).
(Up to i / 64 customers in a row are drawn as one binomial, so a dish with very
many customers takes a number of steps that grows as the logarithm.) Then the
dish's tables are seated in the root the same way, which gives the next P(w).
A dish's blocks lie together, so child and root seatings alternate inside a
task; the tables of a context and the root's totals come from the job before.
One job starts from the types, one burns in, one draws the samples whose
predictive probabilities are averaged; its own totals normalise the result.

Data flow (tokens are 64-bit hashes): texts become stored batches of token
numbers with the batch's distinct words. Batches send their distinct (word,
previous word) pairs with training counts once to buckets of words; buckets merge
them and keep, per batch, the places of its words and pairs (steps of a byte or
so); they run the sweeps and answer the batches by these places; batches add up
their texts. The tables of a context lie in many buckets: each bucket sends its sums by
context to the context's bucket, which adds them up and answers the buckets that
seat there (a pair seen once has one table, so only contexts of pairs seen more
often are sent again after a job). A context's customers are its own count as a
word. No word list or model passes through the driver: it holds a few totals.
What one word can send is bounded by the distinct words of each batch, and what
its bucket holds by the distinct words of the corpus, however frequent it is; a
frequent context is one number a bucket.

Defined cases: a null or empty text is its end token alone; without training
texts every token is unknown with probability 1; repeated rows are scored (and
learned) like any other row; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, crc_mod, free_worker, shuffle_partitions, stored, task_number
from vendorscope.llm.shingles import Shingler, length_slices

by_value(__name__)

SLICE_BYTES = 12_000_000
SMALL_BYTES = 2_000_000
BUCKET_TOKENS = 2_000_000
SPOOL_BYTES = 32_000_000
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
#: Hashes of the end token and of the context before a text (no word's but by chance).
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in byte planes (every number's first byte, then every second one
    and so on), ascending 64-bit ones as differences: short when packed."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        kind, ascending = a.dtype.str, a.dtype == np.uint64 and bool((a[1:] >= a[:-1]).all())
        if ascending:
            a = np.diff(a, prepend=np.uint64(0))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        out += [(kind + "+" * ascending).ljust(4).encode(), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        mark, n = data[at:at + 4].decode(), int.from_bytes(data[at + 4:at + 12], "little")
        kind, at = np.dtype(mark[:3]), at + 12
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out.append(np.cumsum(a, dtype=kind) if mark[3] == "+" else a)
        at += n * kind.itemsize
    return out


def pack_tokens(at: np.ndarray, n_words: int) -> bytes:
    """Token numbers, as ranks by frequency in byte planes (short when packed)."""
    counts = np.bincount(at, minlength=n_words)
    rank = np.empty(n_words, np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(n_words, dtype=np.uint32)
    planes = rank[at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return pack(counts.astype(np.uint32), *(np.ascontiguousarray(planes[:, k]) for k in range(4)))


def unpack_tokens(blob: bytes) -> np.ndarray:
    counts, *planes = unpack(blob)
    order = np.argsort(-counts.astype(np.int64), kind="stable")
    rank = np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
    return order[rank]


def pack_contexts(hashes: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes, sorted, and each one's place in them, as differences
    in byte planes (short for sorted runs)."""
    own, at = np.unique(hashes, return_inverse=True)
    planes = (np.diff(at, prepend=0) % max(1, len(own))).astype("<u4").view(np.uint8).reshape(-1, 4)
    return [own, *(np.ascontiguousarray(planes[:, k]) for k in range(4))]


def unpack_contexts(own: np.ndarray, *planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()
    return own, np.cumsum(steps, dtype=np.int64) % max(1, len(own))


def make_batches(kind: pa.DataType):
    """mapInArrow body: (id, held_out, text) -> one row per slice of texts."""
    names = ["batch", "ids", "held", "sizes", "words", "tokens", "total", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        shingler, number = Shingler(1), task_number() << 24
        for b in batches:
            column = b.column(2).cast(pa.binary())
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            held = np.array(b.column(1).to_pylist(), bool)
            for first, last in length_slices(lengths, SLICE_BYTES):
                parts, sizes = [], []
                for s, e in length_slices(lengths[first:last], SMALL_BYTES):
                    # only this part's texts are Python objects at a time
                    texts = [t or b"" for t in column.slice(first + s, e - s).to_pylist()]
                    hashes, starts = shingler.word_hashes(texts)
                    parts.append(hashes)
                    sizes.append(np.diff(starts))
                sizes = np.concatenate(sizes) + 1
                token = np.empty(int(sizes.sum()), np.uint64)
                is_end = np.zeros(len(token), bool)
                is_end[np.cumsum(sizes) - 1] = True
                token[is_end], token[~is_end] = END, np.concatenate(parts)
                words, at = np.unique(token, return_inverse=True)
                own = held[first:last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([b.column(0).slice(first, last - first).to_pylist()], pa.list_(kind)),
                     pa.array([own.tolist()], pa.list_(pa.bool_())), pa.array([pack(sizes.astype(np.int64))], pa.binary()),
                     pa.array([pack(words)], pa.binary()), pa.array([pack_tokens(at, len(words))], pa.binary()),
                     pa.array([len(token)], pa.int64()), pa.array([int((~own).sum())], pa.int64())], names)
                number += 1
    return run


def contexts_of(at: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """Number of the token before each token (``n_words`` at a text's first)."""
    out = np.empty(len(at), np.int64)
    out[1:] = at[:-1]
    out[np.cumsum(sizes) - sizes] = n_words
    return out


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def ranges(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of sorted hashes."""
    own = bucket_of(hashes, n)
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
    return [(int(own[a]), int(a), int(z)) for a, z in zip(begin, np.append(begin[1:], len(own)))]


class Batch:
    """A stored batch: words (or their number only), token numbers and its
    distinct (word, previous word) pairs; START is the context after the last word."""

    def __init__(self, sizes: bytes, words: bytes | None, tokens: bytes, n_words: int = 0):
        (self.sizes,) = unpack(sizes)
        if words is not None:
            (self.words,) = unpack(words)
            n_words = len(self.words)
        self.at = unpack_tokens(tokens)
        code = (self.at << 32) | contexts_of(self.at, self.sizes, n_words)
        self.pairs, self.pair_at = np.unique(code, return_inverse=True)
        self.pair_word = self.pairs >> 32
        self.pair_context = self.pairs & 0xFFFFFFFF

    def buckets(self, n: int) -> list[tuple[int, int, int]]:
        """(bucket, first word, last word): ranges of the words' hashes."""
        return ranges(self.words, n)


def send(n_buckets: int):
    """mapInArrow body over batches: (bucket, batch, blob), all pairs with their
    training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, held, *blobs in zip(*(b.column(k).to_pylist() for k in range(5))):
                batch = Batch(*blobs)
                word, context = batch.pair_word, np.append(batch.words, START)[batch.pair_context]
                train = np.repeat(~np.array(held, bool), batch.sizes)
                counts = np.bincount(batch.pair_at[train], minlength=len(batch.pairs)).astype(np.uint32)
                rows = []
                for bucket, a, z in batch.buckets(n_buckets):
                    i, j = np.searchsorted(word, (a, z))
                    per_word = np.bincount(word[i:j] - a, minlength=z - a).astype(np.uint32)
                    rows.append((bucket, number, pack(batch.words[a:z], per_word, counts[i:j], *pack_contexts(context[i:j]))))
                yield table_rows(rows, ["bucket", "batch", "blob"], [pa.int32(), pa.int64(), pa.binary()])
    return run


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def pack_places(*places: tuple[np.ndarray, np.ndarray]) -> bytes:
    """What ``found`` gave, as steps from place to place (of those there)."""
    out = []
    for at, there in places:
        if len(at):
            at = at[np.maximum.accumulate(np.where(there, np.arange(len(at)), 0))]
        out += [np.diff(at, prepend=0).astype(np.uint32), there.astype(np.uint8)]
    return pack(*out)


def unpack_places(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    parts = unpack(blob)
    return [((np.cumsum(steps, dtype=np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), there > 0)
            for steps, there in zip(parts[::2], parts[1::2])]


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Rows of sorted batches, one tuple each."""
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(width)))


def table_rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


COUNT_COLUMNS = ["bucket", "blob", "many", "words", "tokens", "pairs", "one", "two", "root_one", "root_two", "to", "message",
                 "batch", "places"]
COUNT_TYPES = [pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 7 + [pa.int32(), pa.binary(), pa.int64(), pa.binary()]
COUNT_SCHEMA = ("bucket int, blob binary, many binary, words long, tokens long, pairs long, one long, two long, "
                "root_one long, root_two long, to int, message binary, batch long, places binary")


def merge_counts(n_buckets: int):
    """mapInArrow body over (bucket, batch, blob) sorted by bucket: one merged
    row per bucket of its training pairs, with what the sweeps need of it, its
    messages to the buckets of its contexts: (hashes, types, whether the tables
    are asked for), and per batch the places of its words and pairs in the
    bucket. Blobs are read twice, so they wait in an unnamed file of the task
    where they are more than ``SPOOL_BYTES``."""
    def trained(words, per_word, n, contexts, at) -> list[np.ndarray]:
        """Without what occurs in no training text."""
        some = n > 0
        if some.all():
            return [words, per_word, n, contexts, at]
        left = np.bincount(np.repeat(np.arange(len(words)), per_word)[some], minlength=len(words))
        used, at = np.unique(at[some], return_inverse=True)
        return [words[left > 0], left[left > 0].astype(np.uint32), n[some], contexts[used], at]

    def read(blob: bytes) -> list[np.ndarray]:
        words, per_word, n, *contexts = unpack(blob)
        return [words, per_word, n, *unpack_contexts(*contexts)]

    def merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        word = np.repeat(at, np.concatenate([h[1] for h in held]))
        contexts, place = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
        first = np.cumsum([0] + [len(h[3]) for h in held])
        code = (word.astype(np.int64) << 32) | np.concatenate([place[f + h[4]] for f, h in zip(first, held)])
        pairs, inverse = np.unique(code, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([h[2] for h in held]))
        per_word = np.bincount(pairs >> 32, minlength=len(words))
        return [words, per_word.astype(np.uint32), n.astype(np.uint64), contexts, pairs & 0xFFFFFFFF]

    def row(bucket: int, words, per_word, n, contexts, at) -> pa.RecordBatch:
        word = np.repeat(np.arange(len(words), dtype=np.uint32), per_word)
        many = np.flatnonzero(n > 1)
        asked, place = np.unique(at[many], return_inverse=True)
        single = np.bincount(word[n == 1], minlength=len(words)).astype(np.uint32)
        small = pack(per_word, single, word[many], n[many], contexts[asked], place.astype(np.uint32))
        rows = [(bucket, pack(words, per_word, n), small, len(words), int(n.sum()), len(n), int((n == 1).sum()),
                 int((n == 2).sum()), int((per_word == 1).sum()), int((per_word == 2).sum()), *[None] * 4)]
        types = np.bincount(at, minlength=len(contexts)).astype(np.uint32)
        ask = np.zeros(len(contexts), np.uint8)
        ask[asked] = 1
        rows += [(bucket, *[None] * 9, to, pack(contexts[a:z], types[a:z], ask[a:z]), None, None)
                 for to, a, z in ranges(contexts, n_buckets)]
        return table_rows(rows, COUNT_COLUMNS, COUNT_TYPES)

    def bucket_rows(bucket: int, held: list[list[np.ndarray]], sizes: list[tuple[int, int]], spool) -> Iterator[pa.RecordBatch]:
        words = contexts = np.zeros(0, np.uint64)
        pairs = np.zeros(0, np.int64)
        if held:
            words, per_word, n, contexts, at = merged(held)
            held.clear()
            yield row(bucket, words, per_word, n, contexts, at)
            pairs = (np.repeat(np.arange(len(words)), per_word) << 32) | at
        spool.seek(0)
        for batch, size in sizes:
            asked, per_word, _, own, at = read(spool.read(size))
            word, known = found(words, asked)
            context, seen = found(contexts, own)
            place, there = found(pairs, (np.repeat(word, per_word) << 32) | context[at])
            there &= np.repeat(known, per_word) & seen[at]
            yield table_rows([(bucket, *[None] * 11, batch, pack_places((word, known), (place, there)))],
                             COUNT_COLUMNS, COUNT_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, sizes = None, [], 0, []
        spool = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
        for bucket, batch, blob in runs(batches, 3):
            if bucket != last:
                if sizes:
                    yield from bucket_rows(last, held, sizes, spool)
                last, held, size, sizes = bucket, [], 0, []
                spool.close()
                spool = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
            spool.write(blob)
            sizes.append((batch, len(blob)))
            message = trained(*read(blob))
            if len(message[2]):
                held.append(message)
                size += len(message[2])
            if size > 4_000_000:                   # what is held stays near the bucket's distinct pairs
                held = [merged(held)]
                size = len(held[0][2]) // 2
        if sizes:
            yield from bucket_rows(last, held, sizes, spool)
        spool.close()
    return run


TOTAL_COLUMNS = ["to", "bucket", "blob", "start"]
TOTAL_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.float64()]
TOTAL_SCHEMA = "to int, bucket int, blob binary, start double"


def context_totals(reply: bool):
    """mapInArrow body over (to, bucket, blob) sorted by both (null first: the
    contexts' types, if known): the tables of each context of a bucket, and
    (if asked for) its replies to the messages."""
    def rows_of(to: int, known: list | None, messages: list) -> list[tuple]:
        if known is None:
            hashes, at = np.unique(np.concatenate([m[0] for _, m in messages]), return_inverse=True)
            total = np.zeros(len(hashes))
            asks = [m[0][m[2] > 0] for _, m in messages]
        else:
            hashes, total = known[0], known[1].astype(float)
            asks = [m[0] for _, m in messages]
            at = np.searchsorted(hashes, np.concatenate([np.zeros(0, np.uint64), *asks]))
        if messages:
            total += np.bincount(at, weights=np.concatenate([m[1] for _, m in messages]), minlength=len(hashes))
        out = [(to, None, pack(hashes, total.astype(np.float32)), float(total[hashes == START].sum()))]
        if reply:
            out += [(to, b, pack(total[np.searchsorted(hashes, ask)].astype(np.float32)), None)
                    for (b, _), ask in zip(messages, asks) if len(ask)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, messages = None, None, []
        for to, bucket, blob in runs(batches, 3):
            if to != last:
                if last is not None:
                    yield table_rows(rows_of(last, known, messages), TOTAL_COLUMNS, TOTAL_TYPES)
                last, known, messages = to, None, []
            if bucket is None:
                known = unpack(blob)
            else:
                messages.append((bucket, unpack(blob)))
        if last is not None:
            yield table_rows(rows_of(last, known, messages), TOTAL_COLUMNS, TOTAL_TYPES)
    return run


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of each dish: customers are seated in turn; ``weight`` is that
    of a new table, an old table's is its customers less the discount."""
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order].astype(np.int64), weight[order]
    tables = np.minimum(c, 1).astype(float)
    i, falling = 1, -c
    while (k := int(np.searchsorted(falling, -i))) > 0:
        chance = a[:k] / (a[:k] + i - discount * tables[:k])
        step = max(1, i // 64)
        if step == 1:
            tables[:k] += rng.random(k) < chance
        else:
            tables[:k] += rng.binomial(np.minimum(step, c[:k] - i), chance)
        i += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


SWEEP_COLUMNS = ["bucket", "blob", "root", "root_tables", "to", "message"]
SWEEP_TYPES = [pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.binary()]
SWEEP_SCHEMA = "bucket int, blob binary, root double, root_tables double, to int, message binary"


def sweep(model, burn_in: int, samples: int, answer: bool, n_buckets: int):
    """mapInArrow body over (bucket, part, blob) sorted by both (null first:
    what the sweeps need of the counts, then the tables of the contexts asked
    for): Gibbs sweeps; per bucket the averaged tables and the root's discounted
    counts (if asked for) and the root's totals, then its messages to the
    buckets of its contexts: (hashes, tables beyond one a type)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def swept(bucket: int, counts: list[np.ndarray], tables: list[np.ndarray]) -> pa.RecordBatch:
            per_word, single, word, n, asked, place = counts
            tables = np.concatenate([np.zeros(0), *tables])
            n, per_word = n.astype(np.int64), per_word.astype(np.int64)
            rng = np.random.default_rng([29, bucket, burn_in])
            base = (STRENGTH + m["d0"] * m["root_tables"]) / (m["v"] + 1)
            p = (per_word - m["d0"] + base) / (STRENGTH + m["root"])
            t_mean, root_mean, seat_mean = np.zeros(len(n)), np.zeros(len(per_word)), np.zeros(len(per_word))
            opening = STRENGTH + m["d"] * tables[place]
            for k in range(burn_in + samples):
                t = seat(n, opening * p[word], m["d"], rng)
                root = single + np.bincount(word, weights=t, minlength=len(per_word))
                seats = seat(root, np.full(len(per_word), base), m["d0"], rng)
                p = (root - m["d0"] * seats + base) / (STRENGTH + m["root"])
                if k >= burn_in:
                    t_mean += t / samples
                    root_mean += root / samples
                    seat_mean += seats / samples
            out = pack(t_mean.astype(np.float32), (root_mean - m["d0"] * seat_mean).astype(np.float32)) if answer else None
            more = np.bincount(place, weights=t_mean - 1, minlength=len(asked)).astype(np.float32)
            rows = [(bucket, out, float(root_mean.sum()), float(seat_mean.sum()), None, None)]
            rows += [(bucket, None, None, None, to, pack(asked[a:z], more[a:z])) for to, a, z in ranges(asked, n_buckets)]
            return table_rows(rows, SWEEP_COLUMNS, SWEEP_TYPES)

        own, counts, tables = None, None, []
        for bucket, part, blob in runs(batches, 3):
            if part is None:
                if own is not None:
                    yield swept(own, counts, tables)
                own, counts, tables = bucket, unpack(blob), []
            else:
                tables.append(unpack(blob)[0])
        if own is not None:
            yield swept(own, counts, tables)
    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (bucket, kind, batch, blob) sorted by bucket and
    kind (0 the bucket's dishes, 1 their sweeps, 2 the tables of the bucket's
    words as contexts, 3 places asked for): (batch, bucket, blob) answers."""
    def looked_up(values: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), values.dtype)
        out[ok] = values[at[ok]]
        return out

    own = None
    for bucket, kind, batch, blob in runs(batches, 4):
        if bucket != own:
            own, words, n, total = bucket, *(np.zeros(0, np.uint64) for _ in range(3))
            seats, r, tables = (np.zeros(0, np.float32) for _ in range(3))
        if kind == 0:
            words, per_word, n = unpack(blob)
            word = np.repeat(np.arange(len(words)), per_word)
            total = np.bincount(word, weights=n, minlength=len(words)).astype(np.uint64)
            seats, tables = np.ones(len(n), np.float32), np.zeros(len(words), np.float32)
        elif kind == 1:
            t_mean, r = unpack(blob)
            seats[n > 1] = t_mean
        elif kind == 2:
            hashes, of_context = unpack(blob)
            tables = looked_up(of_context, *found(hashes, words))
        else:
            word, pair = unpack_places(blob)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch], pa.int64()), pa.array([bucket], pa.int32()),
                 pa.array([pack(*(looked_up(x, *word) for x in (total, r, tables)),
                                *(looked_up(x, *pair) for x in (n, seats)))], pa.binary())], ["batch", "bucket", "blob"])


def score_batches(model, kind: pa.DataType):
    """mapInArrow body over (batch, bucket, ids, held, sizes, tokens, blob) sorted by batch and bucket (null first: the batch, then its answers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def scored(ids, held, sizes, tokens, answers) -> pa.RecordBatch:
            c, r, t, n, seats = (np.concatenate([a[k] for a in answers]) for k in range(5))
            batch = Batch(sizes, None, tokens, len(c))
            x = (n.astype(np.int64) - m["d"] * seats.astype(float)).astype(np.float32)
            base = (STRENGTH + m["d0"] * m["root_tables"]) / (m["v"] + 1)
            p = (r.astype(float) + base) / (STRENGTH + m["root"])
            customers = np.append(c.astype(float), m["texts"])[batch.pair_context]
            tables = np.append(t.astype(float), m["start"])[batch.pair_context]
            pair = (x + (STRENGTH + m["d"] * tables) * p[batch.pair_word]) / (STRENGTH + customers)
            begin = np.cumsum(batch.sizes) - batch.sizes
            score = np.add.reduceat(np.log10(pair)[batch.pair_at], begin)
            plain = np.log10((c + 0.1) / (m["n"] + 0.1 * (m["v"] + 1)))
            known = np.add.reduceat((c > 0).astype(np.int64)[batch.at], begin)
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(held, pa.bool_()), pa.array(batch.sizes, pa.int64()),
                 pa.array(known, pa.int64()), pa.array([m["n"]] * n, pa.int64()),
                 pa.array(np.add.reduceat(plain[batch.at], begin)), pa.array(score),
                 pa.array(10.0 ** np.minimum(-score / batch.sizes, 300.0))],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        own, answers = None, []
        for row in runs(batches, 7):
            if row[1] is None:
                if own is not None:
                    yield scored(*own, answers)
                own, answers = row[2:6], []
            else:
                answers.append(unpack(row[6]))
        if own is not None:
            yield scored(*own, answers)
    return run


def discount(one: int, two: int) -> float:
    """The usual estimate from types seen once and twice, kept off 0 and 1."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 10) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10), perplexity."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(kind)
    name = kind.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (crc_mod(id_col, held_mod) == 0).alias("held"),
                       F.col(text_col).alias("text"))
    batches = stored(rows.mapInArrow(
        make_batches(arrow), f"batch long, ids array<{name}>, held array<boolean>, sizes binary, words binary, "
                             "tokens binary, total long, texts long"), "lm-batches", None)
    sums = batches.agg(F.sum("total").alias("n"), F.sum("texts").alias("texts")).first()
    total = sums["n"] or 0
    n_buckets = max(shuffle_partitions(spark), -(-total // BUCKET_TOKENS))
    parts = batches.select("batch", "held", "sizes", "words", "tokens")
    counted = (parts.mapInArrow(send(n_buckets), "bucket int, batch long, blob binary")
               .repartition(n_buckets, "bucket").sortWithinPartitions("bucket"))
    counts = stored(counted.mapInArrow(merge_counts(n_buckets), COUNT_SCHEMA), "lm-counts", None)
    dishes = counts.filter("blob is not null")
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS[3:10]]).first()
    model = {"d": discount(s["one"], s["two"]), "d0": discount(s["root_one"], s["root_two"]), "v": s["words"],
             "n": s["tokens"], "texts": sums["texts"] or 0, "root": float(s["pairs"]), "root_tables": float(s["words"])}

    def messages(rows: DataFrame) -> DataFrame:
        return rows.filter("to is not null").select("to", "bucket", F.col("message").alias("blob"))

    def totals(rows: DataFrame, reply: bool) -> DataFrame:
        """The contexts' tables (bucket null) and the replies."""
        return stored(rows.repartition(n_buckets, "to").sortWithinPartitions("to", F.col("bucket").asc_nulls_first())
                      .mapInArrow(context_totals(reply), TOTAL_SCHEMA), "lm-contexts", None)

    types = totals(messages(counts), True)
    known = types.filter("bucket is null").select("to", "bucket", "blob")

    def swept(replies: DataFrame, burn_in: int, samples: int, give: bool) -> tuple[DataFrame, DataFrame]:
        held = spark.sparkContext.broadcast(model)
        rows = (dishes.select("bucket", F.lit(None).cast("int").alias("part"), F.col("many").alias("blob"))
                .unionByName(replies.filter("bucket is not null").select("bucket", F.col("to").alias("part"), "blob"))
                .repartition(n_buckets, "bucket").sortWithinPartitions("bucket", F.col("part").asc_nulls_first()))
        out = stored(rows.mapInArrow(sweep(held, burn_in, samples, give, n_buckets), SWEEP_SCHEMA), "lm-sweep", None)
        r = out.agg(F.coalesce(F.sum("root"), F.lit(0.0)).alias("a"),
                    F.coalesce(F.sum("root_tables"), F.lit(0.0)).alias("b")).first()
        model.update(root=r["a"], root_tables=r["b"])
        return out, totals(known.unionByName(messages(out)), not give)

    _, burnt = swept(types, BURN_IN, 1, False)
    final, tables = swept(burnt, 1, SAMPLES, True)
    model["start"] = tables.agg(F.coalesce(F.sum("start"), F.lit(0.0)).alias("t")).first()["t"]
    held = spark.sparkContext.broadcast(model)

    def kept(rows: DataFrame, key: str, kind: int) -> DataFrame:
        return rows.select(F.col(key).alias("bucket"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("batch"), "blob")

    served = (kept(dishes, "bucket", 0).unionByName(kept(final.filter("blob is not null"), "bucket", 1))
              .unionByName(kept(tables, "to", 2))
              .unionByName(counts.filter("batch is not null")
                           .select("bucket", F.lit(3).alias("kind"), "batch", F.col("places").alias("blob"))))
    answers = (served.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
               .mapInArrow(answer, "batch long, bucket int, blob binary"))
    none = F.lit(None)
    whole = batches.select("batch", none.cast("int").alias("bucket"), "ids", "held", "sizes", "tokens",
                           none.cast("binary").alias("blob"))
    parts_back = answers.select("batch", "bucket", none.cast(f"array<{name}>").alias("ids"),
                                none.cast("array<boolean>").alias("held"), *[none.cast("binary").alias(c) for c in
                                ("sizes", "tokens")], "blob")
    n_batches = batches.count()
    joined = (whole.unionByName(parts_back).repartition(max(1, min(n_batches, 4 * shuffle_partitions(spark))), "batch")
              .sortWithinPartitions("batch", F.col("bucket").asc_nulls_first()))
    return joined.mapInArrow(score_batches(held, arrow), f"id {name}, held_out boolean, n_tokens long, n_known long, "
                             "train_tokens long, base_score double, score double, perplexity double"
                             ).withColumnRenamed("id", id_col)
