import hashlib
from collections import defaultdict

import pytest

from tests.llm.helpers import docs_of, prose
from vendorscope.llm.exact_dedup import ContentTable, drop_copies, exact_dedup, grace

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (None, "z"), (8, "é"), (8, "é"),
        (9, "x" * 300_000), (10, "x" * 300_000)] + [(100 + i, "hot") for i in range(200)]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("memory", [64 << 20, 100])
def test_against_grouping(spark, memory):
    got = exact_dedup(docs_of(spark, ROWS).repartition(5), memory_bytes=memory).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in ROWS})                  # one row of every text, repeated rows too
    assert all(r.doc_id == r.keep_id for r in kept)


def test_spill_recursion_equals_memory():
    """Many contents against a tiny budget: several levels of spill files."""
    import pyarrow as pa
    texts = [prose(i % 400, 5) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], ["rep_key", "content"])

    def groups(memory):
        out = defaultdict(set)
        for b in grace(memory)(iter([batch])):
            for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out[g].add(k)
        return sorted(map(sorted, out.values()))
    assert groups(200) == groups(1 << 30)
    assert len(groups(200)) == len(set(texts))


def test_table_compares_whole_contents():
    t = ContentTable(2)
    for i, c in enumerate([b"a", b"b", b"c", b"d", b"e"]):
        at = t.find(7, c)                                               # one hash for all
        assert at < 0
        t.insert(-1 - at, 7, c, i)
    assert [t.values[t.find(7, c)] for c in (b"a", b"e", b"c")] == [0, 4, 2]


def test_drop_copies_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, True), (2, "a", "y", 2, False), (3, None, "z", 3, None)],
                               "doc_id long, text string, keep_id string, row_key int, kept boolean")
    out = drop_copies(df)
    assert out.dtypes == df.dtypes
    assert sorted(tuple(r) for r in out.collect()) == [(2, "a", "y", 2, False), (3, None, "z", 3, None)]


def test_empty(spark):
    df = docs_of(spark, [(1, "a")]).filter("false")
    assert exact_dedup(df).count() == 0 and drop_copies(df).count() == 0
