import numpy as np

from tests.llm.helpers import crc_mod, docs_of
from vendorscope.llm.common import read_table
from vendorscope.llm.langid import FTRL, identify, keep_identified, softmax, temperature

A, B = "abba baba bab aab", "xyyx zyzy xzz yyx"


def corpus(n=120):
    return [(i, (A if i % 2 else B) * (1 + i % 5), "aa" if i % 2 else "bb") for i in range(n)]


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if crc_mod(r.doc_id, 4) == 2]
    assert all(got[r.doc_id].held_out == (crc_mod(r.doc_id, 4) == 2) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_held_out_rows_are_never_read(spark):
    rows = corpus()
    told = [(i, t, "zz" if crc_mod(i, 4) == 2 else lang) for i, t, lang in rows]
    one = sorted(tuple(r) for r in identify(docs_of(spark, rows)).collect())
    two = sorted(tuple(r) for r in identify(docs_of(spark, told)).collect())
    assert one == two


def test_edge_rows(spark):
    rows = corpus() + [(500, None, "aa"), (501, "", None), (502, "123 !?", "aa"), (503, A * 40_000, None),
                       (504, "a", None), (505, "\U00010400\U00010401", None), (1, A, "aa")]
    got = {}
    for r in identify(docs_of(spark, rows).repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (500, 501, 502))
    assert got[503][0].lang_pred == "aa" and got[504][0].lang_pred == "aa"
    assert got[505][0].lang_pred in ("aa", "bb")


def test_nothing_to_learn_from(spark):
    assert identify(docs_of(spark, corpus()).filter("false")).count() == 0
    untold = docs_of(spark, [(i, t, None) for i, t, _ in corpus(10)])
    assert {r.lang_pred for r in identify(untold).collect()} == {"und"}


def test_filter_keeps_columns(spark):
    docs = docs_of(spark, corpus() + [(700, "...", "aa")]).selectExpr("*", "1 as score", "'x' as lang_pred")
    out = keep_identified(docs)
    assert out.dtypes == docs.dtypes
    assert {r.doc_id for r in out.collect()} == set(range(120))


def test_batches_do_not_touch_each_other(spark):
    rows = corpus()
    one = sorted(tuple(r) for r in identify(docs_of(spark, rows).coalesce(1)).collect())
    many = sorted(tuple(r) for r in identify(docs_of(spark, rows).repartition(9)).collect())
    assert [(a[:3], round(a[3], 9)) for a in one] == [(a[:3], round(a[3], 9)) for a in many]


def test_elastic_net_leaves_sparse_weights():
    rng = np.random.default_rng(1)
    m = FTRL(50, 2)
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.append(rng.choice(np.arange(2, 50), 5, replace=False), y)
        m.learn(at, np.append(rng.normal(0, 0.05, 5), 1.0), y)
    w = m.weights()[:-1]
    assert w[0, 0] > 0.5 and w[1, 1] > 0.5 and (w[2:] == 0).mean() > 0.3


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 2, (3000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(4 * logits, labels) - 4) < 0.6
