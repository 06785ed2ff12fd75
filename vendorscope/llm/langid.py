"""Language identification: multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal)
under an elastic net, then calibrated by a temperature.

Features: letters in lower case, every other character as a space; all
1- to 3-grams of the whole text, hashed to ``2**BITS`` buckets; weight = share
of the text's n-grams times the bucket's inverse document frequency. Document
frequencies and class counts come from all training documents. The model is
fitted on a bounded sample: about ``per_class`` documents of each language
(all, where there are fewer), chosen by a hash of the id; four fifths train,
the rest set the temperature. The elastic net's L1 part leaves the weights
sparse; buckets without weight are dropped from the model. The model is
buckets x classes numbers, whatever the input, and is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any training document every text is ``und``; repeated rows get equal
results; null languages do not train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorscope.llm.common import by_value, crc_mod, free_worker, trim_memory
from vendorscope.llm.pretokens import slices

by_value(__name__)

BITS = 16
ORDERS = (1, 2, 3)
PER_CLASS = 800
SLICE = 1_000_000
SCALE = 50.0
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Lower-case code of each letter below 0x10000, 32 for all else."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def letters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row, and where each text starts and ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = np.flatnonzero(codes >= len(table))
    low = table[np.minimum(codes, len(table) - 1)] if len(far) else table[codes]
    if len(far):
        uniq, at = np.unique(codes[far], return_inverse=True)
        low[far] = np.array([c if chr(c).isalpha() else 32 for c in uniq.tolist()], np.uint32)[at]
    return low, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def ngram_buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place (the last ones wrap)."""
    h = codes * np.uint32(0x9E3779B1)
    for k in range(1, order):
        h = (h ^ np.roll(codes, -k)) * np.uint32((0x85EBCA6B, 0xC2B2AE35)[k - 1])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D + 2 * order)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def grams(texts: list[str], table: np.ndarray, bits: int, orders=ORDERS):
    """(codes, starts, buckets of each order)."""
    codes, starts = letters(texts, table)
    return codes, starts, [ngram_buckets(codes, n, bits) for n in orders]


def spans(starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of each text's n-grams (empty for shorter texts)."""
    return starts[:-1], np.maximum(starts[1:] - (order - 1), starts[:-1])


def doc_frequencies(bits: int, orders):
    """mapInArrow body: (text) -> (bucket, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        table, total = letter_table(), np.zeros(1 << bits, np.int64)
        flags = np.zeros(1 << bits, np.uint8)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for first, last in slices(texts, SLICE):
                _, starts, hashed = grams(texts[first:last], table, bits, orders)
                ends = [spans(starts, n) for n in orders]
                for i in range(last - first):
                    for h, (a, z) in zip(hashed, ends):
                        flags[h[a[i]:z[i]]] = 1
                    total += flags
                    flags[:] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])
    return run


def sparse_rows(bits: int, orders):
    """mapInArrow body: (id hash, lang, text) -> (h, lang, buckets, shares)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            at, share = [], []
            for first, last in slices(texts, SLICE):
                _, starts, hashed = grams(texts[first:last], table, bits, orders)
                ends = [spans(starts, n) for n in orders]
                for i in range(last - first):
                    own = np.concatenate([h[a[i]:z[i]] for h, (a, z) in zip(hashed, ends)])
                    x, n = np.unique(own, return_counts=True)
                    at.append(x)
                    share.append((n / max(1, len(own))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())),
                 pa.array(share, pa.list_(pa.float32()))], ["h", "lang", "buckets", "shares"])
    return run


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """FTRL-proximal for multinomial logistic regression with an elastic net."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One document; the last feature row is the bias."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss (golden section over
    its logarithm). Targets are smoothed by one count in ``n + 2``: separable
    rows would else drive the temperature to 0 and every score to 1."""
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(u: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-30))).sum(axis=1).mean())
    a, b, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sampled(train: DataFrame, label: Column, id_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label (all where there are fewer), by
    a hash of the id ``h``; label counts cover all rows."""
    counts = train.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64(F.col(id_col), F.lit(17))
    known = train.withColumn("label", label).withColumn("h", h)
    # one row per label: as many as the languages, not as the documents
    return known.join(F.broadcast(counts), "label").filter(
        F.pmod("h", F.lit(1 << 20)) < F.lit(float(per_class << 20)) / F.col("n"))


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int = BITS, orders=ORDERS,
        per_class: int = PER_CLASS, epochs: int = 4) -> dict | None:
    """The model as numbers: classes, per-bucket weights, bias, temperature."""
    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df = train.select("text").mapInArrow(doc_frequencies(bits, orders), "bucket int, n long")
    idf = np.zeros(1 << bits)
    held = df.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()      # 2**bits rows at most
    n_docs = train.count()
    if not n_docs:
        return None
    idf[held["bucket"].to_numpy()] = np.log((1 + n_docs) / (1 + held["n"].to_numpy(float))) + 1
    sample = (sampled(train, F.col("lang"), "id", per_class).select("h", "lang", "text")
              .mapInArrow(sparse_rows(bits, orders), "h long, lang string, buckets array<int>, shares array<float>"))
    rows = sample.toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    told = rows.column("lang").to_pylist()
    classes = sorted(set(told))
    if not classes:
        return None
    number = {c: i for i, c in enumerate(classes)}
    # arrays all the way: as Python numbers the sample would take many times its size
    lists, shares = (pa.concat_arrays(rows.column(c).chunks) for c in ("buckets", "shares"))
    cuts, flat, weight = lists.offsets.to_numpy(), lists.values.to_numpy(), shares.values.to_numpy()
    data = []
    for i, lang in enumerate(told):
        at = flat[cuts[i]:cuts[i + 1]].astype(np.int64)
        data.append((at, weight[cuts[i]:cuts[i + 1]] * idf[at] * SCALE, number[lang]))
    order = np.random.default_rng(5).permutation(len(data))
    held_back = [data[i] for i in order[: len(data) // 5]]
    learn = [data[i] for i in order[len(data) // 5:]]
    model = FTRL(1 << bits, len(classes))
    for _ in range(epochs):
        for row in learn:
            model.learn(*row)
    w = model.weights()
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in held_back or learn])
    t = temperature(logits, np.array([y for *_, y in held_back or learn]))
    return {"classes": classes, "w": (w[:-1] * (idf * SCALE)[:, None] / t).astype(np.float32), "bias": w[-1] / t,
            "bits": bits, "orders": orders}


def predict_batches(model):
    """mapInArrow body: (id, text, ...) -> the same with lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = model.value, letter_table()
        w, orders = m["w"], m["orders"]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            langs: list[str] = []
            scores: list[float] = []
            for first, last in slices(texts, SLICE):
                codes, starts, hashed = grams(texts[first:last], table, m["bits"], orders)
                total = np.zeros((last - first, w.shape[1]))
                n = np.zeros(last - first)
                for k, h in zip(orders, hashed):
                    a, z = spans(starts, k)
                    some = np.flatnonzero(z > a)
                    if len(some):
                        cuts = np.stack([a[some], z[some]], 1).ravel()
                        sums = np.add.reduceat(np.concatenate([w[h], np.zeros((1, w.shape[1]), np.float32)]),
                                               cuts, axis=0, dtype=np.float64)[::2]
                        total[some] += sums
                        n += z - a
                p = softmax(total / np.maximum(n, 1)[:, None] + m["bias"])
                any_letter = np.concatenate(([0], np.cumsum(codes != 32)))
                lettered = any_letter[starts[1:]] > any_letter[starts[:-1]]
                best = p.argmax(axis=1)
                langs += [m["classes"][k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                scores += np.where(lettered, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns) if i != 1), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())],
                [*(c for i, c in enumerate(b.schema.names) if i != 1), "lang_pred", "score"])
        trim_memory()
    return run


def train_rows(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    return docs.filter((crc_mod(id_col, 4) != 2) & F.col(lang_col).isNotNull())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **options) -> DataFrame:
    """One row per row: id, held_out, lang_pred, score."""
    model = fit(train_rows(docs, id_col, lang_col), id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (crc_mod(id_col, 4) == 2).alias("held_out"))
    return predicted(rows, model, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)


def predicted(rows: DataFrame, model: dict | None, kind: str) -> DataFrame:
    if model is None:
        return rows.select("id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(predict_batches(held), f"id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified: not ``und``, and
    with a calibrated probability of at least ``least_score``."""
    model = fit(train_rows(docs, id_col, lang_col), id_col, text_col, lang_col, **options)
    if model is None:
        return docs.filter(F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {docs.schema.simpleString()}, lang_pred string, score double"
    return (docs.select(row.alias("row"), F.col(text_col).alias("text")).mapInArrow(predict_batches(held), schema)
            .filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*"))
