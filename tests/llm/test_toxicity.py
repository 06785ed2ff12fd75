import random

import numpy as np

from tests.llm.helpers import crc_mod, docs_of, prose
from vendorscope.llm.common import read_table
from vendorscope.llm.langid import letter_table
from vendorscope.llm.toxicity import (CLASSES, Restorer, WordHashes, character_model, classes_of, count_trigrams,
                                      keep_clean, lattice, suspects, toxicity, viterbi)

BAD = ("idiot", "moron", "pathetic", "scum")


def labelled(spark, n=400):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        text, toxic = prose(i, 20 + i % 60), i % 4 == 0
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(BAD))
            text = " ".join(parts)
        rows.append((i, text))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def labels_of(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def model_of(texts):
    import pyarrow as pa
    counts = np.zeros(CLASSES ** 3, np.int64)
    for b in count_trigrams(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])])):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return character_model(counts)


def test_deobfuscation():
    r = Restorer(model_of([prose(1, 3000) + " " + " ".join(BAD * 40) + " the idiot is a moron"]))
    pairs = {"m0r0n": "moron", "i d i o t": "idiot", "s.c.u.m": "scum", "idiiiooot": "idiot", "p@thet1c": "pathetic",
             "$cum": "scum", "IDIOT": "idiot", "alpha": "alpha", "a b": "a b", "": ""}
    assert {k: r.restore(k) for k in pairs} == pairs
    assert r.restore("an m0r0n, and 12 gamma") == "an moron, and 12 gamma"


def test_viterbi_against_all_paths():
    from itertools import product
    m = model_of([prose(2, 500)]).tolist()

    def total(path):
        score, a, b = 0.0, 0, 0
        for c, cost in path:
            score += cost
            if c:
                s = Restorer.symbol(c)
                score += m[a][b][s]
                a, b = b, s
        return score + m[a][b][0]
    for text, spaced in (("m0r0n", False), ("a1l", False), ("b e t a", True), ("gg4$", False)):
        options = lattice(text, spaced)
        best = max(product(*options), key=total)
        assert viterbi(options, m, Restorer.symbol) == "".join(c for c, _ in best)


def test_suspects_are_a_superset():
    texts = ["plain text", "m0ron", "a b c", "soooo", "1 2 3", "x", "", "end 5", "i-d-i"]
    marked = suspects(texts, letter_table())
    r = Restorer(model_of(["plain text"]))
    for t, odd in zip(texts, marked):
        if not odd:
            assert r.restore(t) == t.lower()


def test_word_hashes_tell_words_apart():
    table, h = letter_table(), WordHashes()
    doc, one = h.features(["idiot", "the idiot!", "idiots", ""], table)
    sets = [set(one[doc == i].tolist()) for i in range(4)]
    assert sets[0] <= sets[1] and not sets[0] <= sets[2] and sets[0] & sets[2] and not sets[3]
    assert classes_of(np.array([32, 97, 122, 233])).tolist()[:3] == [0, 1, 26]


def test_held_out_and_planted(spark):
    rows, marks = labelled(spark)
    odd = [(1000, "alpha beta an 1d10t gamma moron m0r0n"), (1001, "alpha s c u m beta pathetic idiooot"), (1002, prose(7, 80)),
           (1003, None), (1004, ""), (1005, prose(8, 30_000)), (1006, "moron scum idiot " + prose(9, 40_000)), (5, rows[5][1])]
    got = toxicity(docs_of(spark, rows + odd).repartition(3), labels_of(spark, marks + [(5, 1, None), (77777, 1, 1), (3, 0, 0)])).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r for r in got}
    assert all(r.held_out == (crc_mod(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(found[i].predicted == t for i, _, t in marks)
    assert [found[i].predicted for i in range(1000, 1007)] == [1, 1, 0, 0, 0, 0, 1]


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, marks = labelled(spark, 200)
    told = [(i, q, 1 - t if crc_mod(i, 5) == 0 else t) for i, q, t in marks]
    docs = docs_of(spark, rows)
    one, two = (sorted((r.doc_id, r.score) for r in toxicity(docs, labels_of(spark, m)).collect()) for m in (marks, told))
    assert one == two


def test_real_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    got = {r.doc_id: r.predicted for r in toxicity(docs, labels).collect()}
    marks = [(r.doc_id, r.toxic) for r in labels.collect()]
    assert sum(got[i] == 1 for i, t in marks if not t) <= 2
    assert sum(got[i] == 1 for i, t in marks if t) > 0.8 * sum(t for _, t in marks)


def test_without_labels_empty_and_filter(spark):
    rows, marks = labelled(spark, 200)
    docs = docs_of(spark, rows)
    assert {r.score for r in toxicity(docs, labels_of(spark, [(1, 1, 0)])).collect()} == {0.0}
    assert toxicity(docs.filter("false"), labels_of(spark, marks)).count() == 0
    extra = docs.selectExpr("*", "1 as score", "2 as toxic", "3 as predicted")
    out = keep_clean(extra, labels_of(spark, marks))
    assert out.dtypes == extra.dtypes
    assert {r.doc_id for r in out.collect()} == {i for i, _, t in marks if not t}


COMBINED = {"m 0 r 0 n": "moron", "1 d 1 0 t": "idiot", "i d 1 o t": "idiot", "m.0.r.o.n": "moron", "i  d  i  o  t": "idiot",
            "i/d/i/o/t": "idiot", "i,d,i,o,t": "idiot", "ii dd ii oo tt": "idiot", "id-iot": "idiot", "idi.ot": "idiot",
            "m 00 r 0 n": "moron", "an i - d - 1 - 0 - t": "an idiot", "s_c_u_m": "scum", "mo/r0n": "moron"}


def test_combined_disguises():
    r = Restorer(model_of([prose(1, 3000) + " " + " ".join(BAD * 40) + " the idiot is a moron"]))
    assert {k: r.restore(k) for k in COMBINED} == COMBINED
    assert all(suspects(list(COMBINED), letter_table()))
    plain = ["0 1 1 0 | | + +", "12, 13; 14", "alpha, beta. gamma (alpha)"]
    assert [r.restore(t) for t in plain] == plain and not any(suspects(plain, letter_table()))


def test_suspects_miss_no_stretch():
    rng = random.Random(5)
    r = Restorer(model_of(["plain text"]))
    texts = ["".join(rng.choice("ab0!1 -./,2_") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    marked = suspects(texts, letter_table())
    assert not [t for t, odd in zip(texts, marked) if not odd and r.restore(t) != t]
    assert not any(any(suspects([t], letter_table())) for t in ("a b", "ab cd", ""))


def test_combined_disguises_are_toxic(spark):
    rows, marks = labelled(spark)
    odd = [(2000 + k, f"alpha beta {a} gamma {b} delta") for k, (a, b) in enumerate(zip(
        ("m 0 r 0 n", "1 d 1 0 t", "i/d/i/o/t", "ii dd ii oo tt"), ("idi.ot", "mo-ron", "m.0.r.o.n", "i  d  i  o  t")))]
    got = {r.doc_id: r.predicted for r in toxicity(docs_of(spark, rows + odd), labels_of(spark, marks)).collect()}
    assert [got[i] for i, _ in odd] == [1] * len(odd)


def test_marks_take_linear_time():
    import time
    r, table = Restorer(model_of(["plain text"])), letter_table()
    for t in ("+" * 200_000, "! " * 100_000, "0 1 " * 50_000, "a" + "-" * 200_000, "a,," * 2 + "," * 200_000, "+-" * 100_000):
        begin = time.process_time()
        suspects([t], table)
        r.restore(t)
        assert time.process_time() - begin < 5
