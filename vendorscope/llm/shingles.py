"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, taken from one
running sum over the whole slice, and mixed; a shingle's hash is a mixed
combination of its words' hashes in order. Two different shingles of one
comparison get the same hash with a chance of about 2**-64."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from vendorscope.llm.common import by_value

by_value(__name__)

BASE = 0x9E3779B97F4A7C15
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
SLICE_BYTES = 2_000_000


def length_slices(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of about ``most`` bytes (one text at least)."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def byte_slices(texts: Sequence[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    return length_slices([len(t) for t in texts], most)


def factor(place: int) -> int:
    """Multiplier of the word at this place of a shingle."""
    return FACTORS[place % 3] + 2 * (place // 3)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of the k-word shingles of texts given as UTF-8 bytes."""

    def __init__(self, words: int = 3):
        self.words = words
        low = np.arange(256, dtype=np.uint64)
        low[65:91] += np.uint64(32)
        self.value = low + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
                steps = np.full(n + n // 4, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def word_hashes(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the first word of each text (one more at
        the end: the number of words)."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._grow(len(data) + 1)
        inside = ~self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[:len(data)], out=total[1:])
        hashes = mix((total[e] - total[s]) * self.inverses[s])
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        return hashes, np.searchsorted(s, begins)

    def rows(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """Per text its shingle hashes in order, repeats included; a text
        with fewer words has its whole sequence as one."""
        k = self.words
        w, first = self.word_hashes(texts)
        n = max(0, len(w) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += w[j:j + n] * np.uint64(factor(j))
        h = mix(h)
        cuts = first.tolist()
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= k:
                yield h[a:b - k + 1]
            elif b > a:
                few = sum(int(x) * factor(j) for j, x in enumerate(w[a:b])) + (b - a)
                yield mix(np.array([few & ((1 << 64) - 1)], np.uint64))
            else:
                yield h[:0]

    def sets(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """Per text its distinct shingle hashes, sorted."""
        for a, b in byte_slices(texts):
            for row in self.rows(texts[a:b]):
                yield np.unique(row)
