"""Texts as numbers of their distinct pre-tokens, in bounded slices.

Pre-tokens repeat (Zipf), so each slice of texts is split once and its
distinct pre-tokens (or stretches of whole pre-tokens) are handed to an
encoder together; a text is then the concatenation of their encodings. The table of distinct pre-tokens
is a cache only: it starts anew when it holds ``MAX_WORDS``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import regex

from vendorscope.llm.common import by_value

by_value(__name__)

SLICE_CHARS = 6_000_000
MAX_WORDS = 1_000_000


def slices(texts: Sequence[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of about ``most`` characters (one text at least)."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


class Numbers(dict):
    """Keys to consecutive numbers, given at the first look."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


class WordTable:
    """encode(new keys) -> one value each; ``split`` gives a text's keys."""

    def __init__(self, split: Callable[[str], list], encode: Callable[[list], list]):
        self.split = split
        self.encode = encode
        self.numbers = Numbers()
        self.values: list = []

    def encode_texts(self, texts: Sequence[str | None]) -> Iterator[list]:
        """Per text the list of its keys' values."""
        if len(self.numbers) > MAX_WORDS:
            self.numbers, self.values = Numbers(), []
        number, known = self.numbers.__getitem__, len(self.values)
        coded = [array("I", map(number, self.split(t))) if t else array("I") for t in texts]
        new = list(islice(self.numbers, known, None))
        if new:
            self.values.extend(self.encode(new))
        value = self.values.__getitem__
        for row in coded:
            yield list(map(value, row))


def by_pattern(pattern: str) -> Callable[[str], list]:
    return regex.compile(pattern).findall


#: A space that does not start a word (unicode white space, or the end, follows).
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
WORD_SPACE = re.compile(r" (?=\S)")


def by_spaces(text: str) -> list:
    """Stretches that start at a space before a non-space: the pre-tokens of a
    text are those of its stretches, since such a space always begins one. The
    first stretch comes as a tuple, the others without their space."""
    parts = WORD_SPACE.split(text) if LOOSE_SPACE.search(text) else text.split(" ")
    parts[0] = (parts[0],)
    return parts


def stretch(key) -> str:
    return key[0] if isinstance(key, tuple) else " " + key
