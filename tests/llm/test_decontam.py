import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import DOCS, UPPER, docs_of, prose
from vendorscope.llm.decontam import Winnower, contaminated_spans, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id string, text string"


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(rows, items, length=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - length + 1)):
            if w:
                windows.setdefault(tuple(w[i:i + length]), set()).add(item or "")
    out = []
    for key, text in rows:
        w, hit, names = split(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i:i + m])):
                    hit |= set(range(i, i + m))
                    names |= own
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(5)
    items = [(f"i{k}", prose(100 + k, rng.choice([10, 12, 30, 60]))) for k in range(12)]
    items += [("i3", prose(103, 15)), ("tiny", "Omega psi"), ("one", "zzz"), ("five", prose(7, 5)), (None, prose(8, 20)),
              ("none", None), ("void", " .,- "), ("same", items[0][1]), ("i11", items[11][1])]
    rows = [(k, prose(k, rng.choice([0, 1, 9, 10, 11, 200]))) for k in range(60)]
    rows += [(1000 + k, f"{prose(k, 30)} {t} {prose(k + 1, 30)}") for k, (_, t) in enumerate(items) if t]
    rows += [(2000 + k, " ".join((t or "").split()[:9])) for k, (_, t) in enumerate(items)]
    rows += [(3000, items[4][1].upper().replace(" ", "--")), (3000, items[4][1]), (None, items[5][1] * 2), (3001, None),
             (3002, ""), (3003, "...")] + [(4000 + k, "x " + items[2][1]) for k in range(30)]
    rows += [(5000, " ".join(t or "" for _, t in items) * 30), (5001, "é\U0001F600 " * 40)]
    return rows, items


@pytest.mark.parametrize("length", [10, 3, 1])
def test_against_all_windows(spark, length):
    rows, items = planted()
    docs = docs_of(spark, rows).selectExpr("*", "1 as start", "2 as item", "3 as combo").repartition(4)
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "7 as m", "8 as lang")
    for limit in (10_000, 0):
        got = decontaminate(docs, bench, length=length, broadcast_windows=limit)
        assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(rows, items, length)


def test_spans_are_the_hit_words(spark):
    rows, items = planted()
    marked, names = contaminated_spans(docs_of(spark, rows), spark.createDataFrame(items, ITEMS))
    for r in marked.filter("id >= 1000 and id < 1012").collect():
        assert any(s.start <= 30 and s.end >= 30 + len(items[r.id - 1000][1].split()) for s in r.spans)
    assert names.count() == names.distinct().count()


def test_empty_tables(spark):
    docs, bench = docs_of(spark, [(1, prose(1, 30))]), spark.createDataFrame([("a", prose(1, 30))], ITEMS)
    for empty in (bench.filter("false"), bench.selectExpr("item_id", "cast(null as string) as text")):
        r = decontaminate(docs, empty).first()
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (30, 0, 0, False)
    assert decontaminate(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontaminate(docs, bench).first().n_hit == 30


def test_a_window_keeps_its_least_gram():
    tool = Winnower()
    w, first = tool.word_hashes([prose(1, 300).encode(), b"", prose(2, 12).encode()])
    start, fp, _ = tool.windows(w, first, 10)
    grams = tool.grams(w, 5, 0)
    assert start.tolist() == [*range(291), 300, 301, 302]
    assert all(fp[k] == grams[s:s + 6].min() for k, s in enumerate(start))
    part = tool.windows(w, first, 10, lambda p: np.arange(len(p)) % 2 == 0)
    assert 0 < len(part[0]) < len(start) and set(part[0]) <= set(start)


def test_a_worker_holds_a_slice_not_a_batch():
    """Winnowing a batch of 6 MB keeps arrays of a slice only."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from vendorscope.llm.decontam import doc_candidates

    class Shared:
        value = np.full(1 << 13, 0, np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([prose(i, 14_000) for i in range(60)])], ["id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in doc_candidates(Shared, [10], pa.int64())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60 and peak < 60e6, peak
