import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import DOCS, UPPER, docs_of, prose
from vendorscope.llm import collocations as C


def brute(rows, min_count, share, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            for m in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(k for p, k in c.items() if len(p) == 1)
        cand = {p: k for p, k in c.items() if len(p) > 1 and k >= min_count}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * k >= share * a for q, k in cand.items()):
                continue
            s, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def table():
    rows = [(i, prose(i % 90, 60).replace("alpha", "of the.").replace("beta", "New York\tCity,"), ("en", "fr", None, "und")[i % 4])
            for i in range(160)]
    return rows + [(900, None, "en"), (901, "", "en"), (902, " \t.,", "xx"), (903, "Ä\x00 b c " * 50, "fr"),
                   (904, "x " * 30_000, "en"), (None, "a b c. " * 40, "de"), (905, "A|b |c\r\n" * 60, "de")]


@pytest.mark.parametrize("min_count,share,top", [(10, 50, 2000), (3, 80, 5), (1, 0, 40)])
def test_against_plain_counts(spark, min_count, share, top, monkeypatch):
    rows = table()[::1 if min_count > 1 else 9]
    docs = docs_of(spark, [(i, t, None) for i, t, _ in rows])
    docs = spark.createDataFrame([(i, t, lang, 1, 2, "p") for i, t, lang in rows],
                                 "doc_id long, text string, lang string, total int, rank int, prefix string")
    if top == 5:
        monkeypatch.setattr(C, "CHUNK", 50)
        monkeypatch.setattr(C, "HEAVY", 5000)                # nearly every prefix is split into blocks
        monkeypatch.setattr(C, "MAX_BITS", 6)                # and the bit map lets everything pass
        monkeypatch.setattr(C, "MIN_BITS", 6)
    got = C.collocations(docs.repartition(5), min_count=min_count, share=share, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_count, share, top)


def test_empty_table_and_no_words(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(docs_of(spark, [(1, None), (2, " . ")])).count() == 0


def test_scores_past_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**11, 4 * 10**11, 5 * 10**11)], "a long, l long, r long")
    assert big.select(C.score("l", "r").alias("s")).first().s == 10**6 * 9 * 10**22 // (20 * 10**22)


def test_pieces_and_words():
    w = C.Words([b"A b.\tc", b"\xc3\x84\x00 d;;e"])
    assert w.words[1:] == [b"a", b"b", b"c", b"\xc3\x84\x00", b"d", b"e"]
    assert w.ids.tolist()[-1] == 0 and np.count_nonzero(w.ids) == 6
