"""Toxicity with noisy-channel deobfuscation.

A character language model (trigrams over 64 letter classes, interpolated)
is counted over all texts. Stretches that may be disguised - a digit or sign
that can stand for a letter beside letters, a letter three times in a row,
letters or signs (also repeated ones) set apart one by one by any separators,
separators inside a word - become character lattices: a sign may be any of
the letters it can stand for or noise, a repeated letter may be dropped, a
separator may be dropped or end a word, each at a channel cost. Viterbi
decoding under the language model picks the restored letters; a stretch
without these marks has a single path and stays as it is. The restored text is
scored by logistic regression (FTRL, elastic net) on its words and their
prefixes of 4 to 6 letters, weighted by presence.

The classifier is fitted on a bounded sample: about ``per_class`` labelled
documents of each class (all, where there are fewer), chosen by a hash of the
id; of the words and prefixes that speak for the toxic class (chi-squared
against the sample's rate), the ``features`` strongest are kept. The language model and the feature list are of fixed size and broadcast.

Defined cases: a null text counts as empty and scores the model's prior;
without labels of both classes every score is 0; repeated rows get equal
results; of several labels of one id the highest counts, null labels none;
labels of ids without a document are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, crc_mod, free_worker, stored, text_or_empty, trim_memory
from vendorscope.llm.langid import FTRL, letter_table, letters
from vendorscope.llm.pretokens import slices

by_value(__name__)

CLASSES = 64
SLICE = 1_000_000
PER_CLASS = 4000
FEATURES = 20_000
PREFIXES = (4, 5, 6)
CACHE = 100_000
#: What a sign can stand for (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SIGN_COST, INNER_NOISE, EDGE_NOISE, DROP_COST, DOUBLE_COST, JOIN_COST = -1.0, -9.0, -5.0, -0.5, -4.0, -0.3
LEAST_CHI2 = 12.0
_SIGNS = re.escape("".join(STANDS_FOR))
_SEPARATORS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in STANDS_FOR) + "’·•"
_SEP = re.escape(_SEPARATORS)
_OTHER = re.escape("".join(c for c in _SEPARATORS if c not in "._-*"))
#: Stretches to decode: three or more letters or signs (each maybe repeated)
#: set apart by any separators, with a letter among them; or tokens with a sign
#: before a letter, a sign between or after letters, a letter thrice, or
#: separators between letters or signs. All are linear in the text.
SPACED = re.compile(rf"(?<![^\W_])([^\W\d_]|(?<![{_SIGNS}])[{_SIGNS}])\1*+"
                    rf"(?:(?:(?![{_SIGNS}])[\W_])++([^\W\d_]|[{_SIGNS}])\2*+(?![^\W_])){{2,}}")
TOKEN = re.compile(rf"(?:[^\W_]|[{_SIGNS}._\-*])+(?:[{_OTHER}]+(?:[^\W_]|[{_SIGNS}._\-*])+)*")
MARKED = re.compile(rf"[{_SIGNS}][^\W\d_]|[^\W\d_][0-9@€£|+$]|([^\W\d_])\1\1|"
                    rf"[^\W\d_][{_SEP}]+(?:[^\W\d_]|[{_SIGNS}])|[{_SIGNS}][{_SEP}]+[^\W\d_]")
LETTER = re.compile(r"[^\W\d_]")
EDGE = re.compile(r"^[._\-*!|+]+|[._\-*!|+]+$|([$@])\1{2,}$")
MULTIPLIER, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def classes_of(codes: np.ndarray) -> np.ndarray:
    """0 for what is no letter, 1-26 for a-z, 27-63 for other letters."""
    out = np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % 37)
    out[codes == 32] = 0
    return out


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (text) -> (trigram, n) over the text's letter classes."""
    free_worker()
    table, total = letter_table(), np.zeros(CLASSES ** 3, np.int64)
    for b in batches:
        texts = [" " + (t or "") + " " for t in b.column(0).to_pylist()]
        for first, last in slices(texts, SLICE):
            c = classes_of(letters(texts[first:last], table)[0]).astype(np.int64)
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]       # one boundary between words
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])


def character_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log P(c | a, b), interpolated with lower orders."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + weight * p1) / (n2.sum(axis=1, keepdims=True) + weight)
    p3 = (n3 + weight * p2[None]) / (n3.sum(axis=2, keepdims=True) + weight)
    return np.log(p3)


def lattice(stretch: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """Per character what it may be ('' dropped, ' ' a boundary) and its cost."""
    out: list[list[tuple[str, float]]] = []
    runs = [len(m[0]) for m in re.finditer(r"(?s)(.)\1*", stretch) for _ in m[0]]
    for i, c in enumerate(stretch):
        if c.isalpha():
            options = [(c, 0.0)]
            if i and stretch[i - 1] == c:
                options.append(("", DROP_COST if spaced or runs[i] >= 3 else DOUBLE_COST))
        elif c in STANDS_FOR:
            noise = INNER_NOISE if 0 < i < len(stretch) - 1 else EDGE_NOISE
            options = [(x, SIGN_COST) for x in STANDS_FOR[c]] + [("", noise), (" ", noise)]
            if spaced and i and stretch[i - 1] == c:
                options.append(("", DROP_COST))
        elif i and not stretch[i - 1].isalpha() and stretch[i - 1] not in STANDS_FOR and not stretch[i - 1].isdigit():
            options = [("", 0.0)]                              # separators in a row are one
        elif spaced:
            options = [("", JOIN_COST), (" ", 0.0)]
        else:
            options = [("", 2 * SIGN_COST), (" ", SIGN_COST)]
        out.append(options)
    return out


def viterbi(options: list[list[tuple[str, float]]], model: list, symbol) -> str:
    """The likeliest path under the language model, from boundary to boundary."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in options:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            rows = model[a][b]
            for c, cost in choices:
                if c == "":
                    key, total, way = (a, b), score + cost, path
                else:
                    s = symbol(c)
                    key, total, way = (b, s), score + cost + rows[s], (c, path)
                old = new.get(key)
                if old is None or total > old[0]:
                    new[key] = (total, way)
        states = new
    _, path = max(((score + model[a][b][0], path) for (a, b), (score, path) in states.items()),
                  key=lambda x: x[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


class Restorer:
    """Replaces disguised stretches by their likeliest letters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.cache: dict[tuple[str, bool], str] = {}

    @staticmethod
    def symbol(c: str) -> int:
        return 0 if c == " " else int(classes_of(np.array([ord(c)]))[0])

    def decode(self, stretch: str, spaced: bool) -> str:
        key = (stretch, spaced)
        if key not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            known: dict[str, int] = {}

            def symbol(c: str) -> int:
                if c not in known:
                    known[c] = self.symbol(c)
                return known[c]
            self.cache[key] = viterbi(lattice(stretch, spaced), self.model, symbol)
        return self.cache[key]

    def token(self, m: re.Match) -> str:
        text = m[0]
        if not MARKED.search(text):
            return text
        core = EDGE.sub("", text)
        return self.decode(core, False) if MARKED.search(core) else core

    def restore(self, text: str) -> str:
        low = text.lower()
        low = SPACED.sub(lambda m: self.decode(m[0], True) if LETTER.search(m[0]) else m[0], low)
        return TOKEN.sub(self.token, low)


SUSPECT, SEPARATOR = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
SUSPECT[[ord(c) for c in STANDS_FOR]] = True
SEPARATOR[[ord(c) for c in _SEPARATORS]] = True


def suspects(texts: list[str], table: np.ndarray) -> list[bool]:
    """Which texts have a mark at all (a superset, found without a regex)."""
    texts = [f" {t} " for t in texts]                      # no text sees its neighbours
    low, starts = letters(texts, table)
    raw = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
    letter, sign = low != 32, SUSPECT[raw]
    mark = (sign | (raw == ord("2"))) & (np.roll(letter, 1) | np.roll(letter, -1))
    mark |= letter & (low == np.roll(low, 1)) & (low == np.roll(low, 2))
    # runs of letters and signs: first and last place
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter | sign, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2] - 1
    separator = SEPARATOR[raw]
    inner = separator[last[:-1] + 1] & separator[first[1:] - 1] & (letter[last[:-1]] | letter[first[1:]])
    mark[first[1:][inner]] = True
    some = np.concatenate(([0], np.cumsum((low != np.roll(low, 1)) & letter)))
    signs, all_letters = np.concatenate(([0], np.cumsum(sign))), np.concatenate(([0], np.cumsum(letter)))
    alone = (some[last + 1] == some[first + 1]) | (signs[last + 1] > signs[first])
    spoken = all_letters[last + 1] > all_letters[first]
    three = alone[2:] & alone[1:-1] & alone[:-2] & (spoken[2:] | spoken[1:-1] | spoken[:-2])
    mark[first[2:][three]] = True
    total = np.concatenate(([0], np.cumsum(mark)))
    return (total[starts[1:]] > total[starts[:-1]]).tolist()


class WordHashes:
    """64-bit hashes of words and their prefixes, for many texts at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", MULTIPLIER), ("inverses", INVERSE)):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def features(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every word and prefix, in no set order."""
        padded = [t + " " for t in texts]
        low, starts = letters(padded, table)
        self._grow(len(low) + 1)
        letter = low != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * self.powers[:len(low)], dtype=np.uint64)))
        doc = np.searchsorted(starts, s, side="right") - 1
        docs, hashes = [doc], [mixed((total[e] - total[s]) * self.inverses[s], 1)]
        for k in PREFIXES:
            some = e - s >= k
            a = s[some]
            docs.append(doc[some])
            hashes.append(mixed((total[a + k] - total[a]) * self.inverses[a], 2))
        return np.concatenate(docs), np.concatenate(hashes)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def restored_batches(texts: list[str], restorer: Restorer, table: np.ndarray):
    """Restored texts by slices: (first, last, texts)."""
    for first, last in slices(texts, SLICE):
        part = texts[first:last]
        yield first, last, [restorer.restore(t) if odd else t for t, odd in zip(part, suspects(part, table))]


def sample_features(model):
    """mapInArrow body: (id, toxic, text) -> (id, toxic, distinct feature hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table, hasher = Restorer(model.value), letter_table(), WordHashes()
        for b in batches:
            out = []
            for first, last, texts in restored_batches([t or "" for t in b.column(2).to_pylist()], restorer, table):
                doc, h = hasher.features(texts, table)
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(1, last - first))
                out += [np.unique(x) for x in np.split(h[order], cuts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["h", "toxic", "features"])
    return run


def fit(docs: DataFrame, labels: DataFrame, lm, id_col: str, text_col: str, per_class: int = PER_CLASS,
        features: int = FEATURES, epochs: int = 8) -> dict | None:
    """Feature hashes (sorted), their weights and the bias."""
    marks = (labels.filter((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(per_class / counts[1])).otherwise(F.lit(per_class / counts[0]))
    h = F.xxhash64(F.col("doc_id"), F.lit(23))
    picked = marks.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < share * F.lit(float(1 << 20)))
    # about 2 * per_class rows whatever the input
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(picked), "doc_id").select("h", "toxic", "text"))
    rows = stored(rows.mapInArrow(sample_features(lm), "h long, toxic int, features array<long>"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    seen = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    base = n[1] / (n[0] + n[1])
    lift = F.col("t") / F.col("n") - F.lit(base)
    gain = F.col("n") * lift * lift / F.lit(base * (1 - base))
    kept = (seen.withColumn("gain", gain).filter((lift > 0) & (F.col("t") >= 2) & (F.col("gain") >= LEAST_CHI2))
            .orderBy(F.desc("gain"), "f").limit(features).select("f"))
    hashes = np.sort(np.array([r["f"] for r in kept.collect()], np.int64))
    if not len(hashes):
        return None
    chosen = kept_features(rows, hashes)
    data = [(np.searchsorted(hashes, np.array(r["features"], np.int64)), r["toxic"])
            for r in sorted(chosen, key=lambda r: r["h"])]
    model = FTRL(len(hashes), 2, alpha=0.3, l1=0.05, l2=0.02)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, label = data[i]
            model.learn(at, np.ones(len(at)), label)
    w = model.weights()
    margin = w[:, 1] - w[:, 0]
    used = np.flatnonzero(margin[:-1])
    return {"hashes": hashes[used], "weights": margin[:-1][used], "bias": float(margin[-1])}


def kept_features(rows: DataFrame, hashes: np.ndarray) -> list:
    """The sample's rows with the kept features only."""
    held = rows.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x[np.isin(x, held.value)] for x in
                     (np.array(f, np.int64) for f in b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))],
                                             ["h", "toxic", "features"])
    return rows.mapInArrow(run, "h long, toxic int, features array<long>").collect()


def language_model(docs: DataFrame, text_col: str):
    """Trigram counts over all texts, as a broadcast model of fixed size."""
    counted = (docs.select(text_col).mapInArrow(count_trigrams, "trigram int, n long")
               .groupBy("trigram").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(CLASSES ** 3, np.int64)
    counts[counted["trigram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return docs.sparkSession.sparkContext.broadcast(character_model(counts).astype(np.float32))


def score_batches(lm, model):
    """mapInArrow body: (row or id, text, ...) -> the same with score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table, hasher, m = Restorer(lm.value), letter_table(), WordHashes(), model.value
        hashes = m["hashes"]
        maybe = np.zeros(1 << 20, bool)
        maybe[hashes & ((1 << 20) - 1)] = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            total = np.full(len(texts), m["bias"])
            for first, last, part in restored_batches(texts, restorer, table):
                doc, h = hasher.features(part, table)
                some = np.flatnonzero(maybe[h & ((1 << 20) - 1)])
                doc, h = doc[some], h[some]
                at = np.searchsorted(hashes, h)
                ok = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h) if len(hashes) else h < 0
                pairs = np.unique(doc[ok] * (len(hashes) + 1) + at[ok])      # presence, not count
                np.add.at(total, first + pairs // (len(hashes) + 1), m["weights"][pairs % (len(hashes) + 1)])
            score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns) if i != 1), pa.array(score)],
                [*(c for i, c in enumerate(b.schema.names) if i != 1), "score"])
        trim_memory()
    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """One row per row: id, held_out, score, predicted."""
    lm = language_model(docs, text_col)
    model = fit(docs, labels, lm, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                       (crc_mod(id_col, 5) == 0).alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        scored = rows.select("id", "held_out", F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)
        scored = rows.mapInArrow(score_batches(lm, held), f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    lm = language_model(docs, text_col)
    model = fit(docs, labels, lm, id_col, text_col, **options)
    if model is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {docs.schema.simpleString()}, score double"
    return (docs.select(row, text_or_empty(text_col)).mapInArrow(score_batches(lm, held), schema)
            .filter(F.col("score") < 0.5).select("row.*"))
