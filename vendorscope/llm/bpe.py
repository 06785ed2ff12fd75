"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens that are encoded together form one doubly linked list of token
ids with barriers between pre-tokens. Every adjacent pair that the vocabulary
can merge stands as a position in the bucket of its merge rank; a two-level
bitmap marks the ranks whose buckets hold something, and find-first-set gives
the next rank. A bucket's positions are checked against the list as it is now:
stale entries (a side was merged meanwhile, or the pair changed) are skipped.
All valid positions of the bucket are merged at once where that equals the
sequential order (lowest rank, then leftmost): overlapping positions take
every other one from the left, and if any new pair would rank at or below the
current rank, only the leftmost position of each pre-token is merged and the
rest goes back. The cost is linear in merges plus a small constant per
visited rank, however long a pre-token is.

Defined cases: a null or empty text has no tokens (both digests are of the
empty string); repeated rows and null ids are encoded like any other row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, text_or_empty, worker_kept
from vendorscope.llm.pretokens import WordTable, by_pattern, slices

by_value(__name__)

WORD_BITS = 256
NONE = 1 << 30


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // WORD_BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = [position]
            self.mark(rank)
        else:
            held.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """A whole bucket that is not there yet."""
        self.buckets[rank] = positions
        self.mark(rank)

    def mark(self, rank: int) -> None:
        w = rank // WORD_BITS
        self.low[w] |= 1 << (rank % WORD_BITS)
        self.top |= 1 << w

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its whole bucket."""
        if not self.top:
            return None
        w = (self.top & -self.top).bit_length() - 1
        word = self.low[w]
        bit = word & -word
        self.low[w] = word ^ bit
        if not self.low[w]:
            self.top ^= 1 << w
        rank = w * WORD_BITS + bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ranks of a tiktoken file with all pairs that merge."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.size = max(self.ranks.values()) + 1
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(rank, np.int64)[order], NONE)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.bytes_of = {str(r): t for t, r in self.ranks.items()}
        self.names = [str(i) for i in range(self.size)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge or a side is missing (-1)."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word (pre-token)."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None and w:
                rest.append(i)
            else:
                out[i] = [whole] if w else []
        if rest:
            for i, ids in zip(rest, self.merge([words[i] for i in rest])):
                out[i] = ids
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words], np.int64)
        # position 0 and every word's end are barriers (token -1)
        n = int(sizes.sum()) + len(words) + 1
        ends = np.cumsum(sizes + 1)
        token = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[ends] = False
        token[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = 0, 0
        queue = RankQueue(self.size)
        ranks = self.pair_ranks(token[:-1], token[1:])
        at = np.flatnonzero(ranks < NONE)
        at = at[np.argsort(ranks[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[at])) + 1
        for part in np.split(at, cuts) if len(at) else ():
            queue.put(int(ranks[part[0]]), part.tolist())
        while (got := queue.pop()) is not None:
            self._merge_bucket(queue, *got, token, after, before, ends)
        alive = np.flatnonzero(token >= 0)
        ids = token[alive].tolist()
        cuts = np.searchsorted(alive, ends).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _merge_bucket(self, queue, rank, positions, token, after, before, ends) -> None:
        p = np.array(positions, np.int64)
        if len(p) > 1:
            p.sort()
            p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        q = after[p]
        ok = (token[p] >= 0) & (self.pair_ranks(token[p], token[q]) == rank)
        if not ok.all():
            p, q = p[ok], q[ok]
            if not len(p):
                return
        if len(p) > 1:
            chained = np.concatenate(([False], q[:-1] == p[1:]))
            if chained.any():
                # place within a chain of overlapping positions: take 0, 2, 4, ...
                at = np.arange(len(p))
                head = np.maximum.accumulate(np.where(chained, 0, at))
                keep = (at - head) % 2 == 0
                taken, taken_q = p[keep], q[keep]
            else:
                taken, taken_q = p, q
        else:
            taken, taken_q = p, q
        made = np.full(len(taken), rank, np.int64)
        if len(p) > 1:
            low = min(int(self.pair_ranks(token[before[taken]], made).min()),
                      int(self.pair_ranks(made, token[after[taken_q]]).min()),
                      int(self.pair_ranks(made[:1], made[:1])[0]))
            if low <= rank:
                word = np.searchsorted(ends, p, side="right")
                first = np.concatenate(([True], word[1:] != word[:-1]))
                queue.put(rank, p[~first].tolist()) if not first.all() else None
                taken, taken_q = p[first], q[first]
                made = made[:1].repeat(len(taken))
        # merge: the left place holds the new token, the right one leaves the list
        token[taken] = rank
        token[taken_q] = -2
        nxt = after[taken_q]
        after[taken] = nxt
        before[nxt] = taken
        prv = before[taken]
        for pos, ranks in ((prv, self.pair_ranks(token[prv], made)), (taken, self.pair_ranks(made, token[nxt]))):
            fresh = ranks < NONE
            if fresh.any():
                for r, x in zip(ranks[fresh].tolist(), pos[fresh].tolist()):
                    queue.push(r, x)

    def decode(self, ids: str) -> bytes:
        """Bytes of ids in decimal, joined by one space."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def encode_batches(data, pattern: str):
    """mapInArrow body: (doc_id, text) -> digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = data.value

        def make() -> tuple[Vocabulary, WordTable]:
            vocabulary = Vocabulary(ranks)
            names = vocabulary.names
            return vocabulary, WordTable(by_pattern(pattern), lambda words: [
                " ".join([names[i] for i in ids]) for ids in vocabulary.encode([w.encode("utf-8") for w in words])])
        vocabulary, table = worker_kept(("bpe", hashlib.sha256(ranks).digest(), pattern), make)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, coded, decoded = [], [], []
            for start, end in slices(texts):
                for parts in table.encode_texts(texts[start:end]):
                    ids = " ".join(parts)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    coded.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def load_ranks(spark: SparkSession, path: str):
    """The rank file, read on the driver and broadcast (its size is that of
    the vocabulary, whatever the input)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = load_ranks(docs.sparkSession, ranks_path)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col))
            .mapInArrow(encode_batches(ranks, pattern),
                        f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
