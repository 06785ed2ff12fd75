import numpy as np
import pytest

from vendorscope.llm.embedding_graph import audit_recall, near_duplicates, recall_of, robust_prune, search, unit

VECTORS = "vec_id long, embedding array<float>, label int"


def cloud(seed, n, dim=16, copies=6, spread=0.12):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, copies + 1)):
            out.append(base + rng.normal(size=dim) * spread)
    return np.array(out[:n], np.float32)


def brute(rows, threshold=0.9):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    n = [0] * len(rows)
    good = [k for k, (i, v) in enumerate(rows) if i is not None and fine(v)]
    x = {k: unit(np.array([rows[k][1]], np.float32))[0] for k in good}
    for a in good:
        for b in good:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                n[a] += 1
                n[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in good:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((i, n[k], least[find(k)] if k in x else i) for k, (i, _) in enumerate(rows)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("cap", [512, 20])
def test_against_all_pairs(spark, cap):
    rows = [(i, v) for i, v in enumerate(cloud(1, 600))]
    hot = np.random.default_rng(2).normal(size=16)
    rows += [(1000 + i, (hot + np.random.default_rng(i).normal(size=16) * 0.05).astype(np.float32)) for i in range(80)]
    rows += [(2000 + i, rows[7][1]) for i in range(50)]                   # copies
    got = near_duplicates(table(spark, rows).repartition(4), cap=cap).collect()
    want = brute(rows)
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)
    true = {i: n for i, n, _ in want}
    assert all(n <= true[i] for i, n, _ in found)
    assert sum(n for _, n, _ in found) >= 0.97 * sum(true.values())
    assert sum(a == b for a, b in zip(found, want)) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [2.0, 0.1]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e30, 0.0]),
            (13, [1e-30, 0.0]), (9, [0.0, 5.0]), (-0, [0.0, 7.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    odd = [r for r in near_duplicates(table(spark, rows)).collect() if r.vec_id is None]
    assert [(r.component_id, r.kept) for r in odd] == [(None, False)]


def test_empty_and_one(spark):
    df = table(spark, [(1, [1.0, 2.0])])
    assert near_duplicates(df.filter("false")).count() == 0
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 0, 1, True)]
    clash = df.selectExpr("*", "5 as key", "6 as weight", "7 as component_id")
    assert near_duplicates(clash).count() == 1


def test_pruned_lists_and_search():
    x = unit(cloud(5, 300))
    lists = robust_prune(x)
    sims = x @ x.T - 2 * np.eye(len(x))
    assert (lists[:, 0] == sims.argmax(axis=1)).mean() > 0.999            # the nearest is always kept
    adjacency = [set() for _ in x]
    for a, row in enumerate(lists):
        for z in row[row >= 0]:
            adjacency[a].add(z)
            adjacency[z].add(a)
    width = max(map(len, adjacency))
    table_ = np.full((len(x), width), -1)
    for a, own in enumerate(adjacency):
        table_[a, :len(own)] = sorted(own)
    x32 = x.astype(np.float32)
    seen = search(x32, x32, table_, 32)
    true = x @ x.T >= 0.9
    assert (seen >= 0.9 - 1e-4)[true].mean() > 0.97
    assert robust_prune(x[:1]).tolist() == [[-1] * lists.shape[1]]


def nodes_of(spark, vectors):
    rows = [(k, 1, len(v), [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "key long, weight long, dim int, embedding array<float>")


def test_audit_sees_lost_small_groups_beside_a_hot_one(spark):
    """All links of a hot group are found and those of 150 pairs lost; then
    links so rare that 256 nodes have none."""
    rng = np.random.default_rng(8)
    hot = rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.02
    pairs = np.repeat(rng.normal(size=(150, 32)), 2, axis=0) + rng.normal(size=(300, 32)) * 0.02
    nodes = nodes_of(spark, np.concatenate([hot, pairs]))
    counts = spark.createDataFrame([(k, 299, 299) for k in range(300)], "key long, n long, pairs long")
    assert audit_recall(nodes, 600, counts, 0.9) < 0.1
    rare = np.concatenate([rng.normal(size=(3000, 32)), pairs[:2]])
    assert audit_recall(nodes_of(spark, rare), 3002, counts.filter("false"), 0.9) == 0
    assert audit_recall(nodes_of(spark, rare[:3000]), 3000, counts.filter("false"), 0.9) == 1
    assert recall_of(np.array([1] * 40 + [500] * 4000), np.array([0] * 40 + [500] * 4000)) == 0


def test_all_pairs_where_the_audit_never_holds(spark):
    rows = [(i, v) for i, v in enumerate(cloud(1, 900))] + [(2000, [1.0, 0.0]), (2001, [1.0, 0.01])]
    got = near_duplicates(table(spark, rows), overlap=1, beam=1, tries=1, least_recall=2.0).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
