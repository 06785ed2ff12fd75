import random

import pyarrow as pa
import pytest

from tests.llm.helpers import docs_of, prose, words
from vendorscope.llm.components import components
from vendorscope.llm.jaccard_join import jaccard_components, keep_first_of_groups, prefix_size, token_stars, unmet_groups


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in text.split(" "))


def corpus():
    rows = [(i, prose(i, 30 + i % 50)) for i in range(60)]
    base = prose(999, 120)
    rows += [(100 + i, near(base, i, 0.012)) for i in range(60)]           # a hot group of near copies
    common = prose(998, 40)                                              # a passage that many rows share
    rows += [(200 + i, prose(300 + i, 5 + i) + " " + common) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "two one"),
             (307, base.upper()), (308, base), (309, "a b a b a b a b"), (310, "a b a b a b"), (311, "é È"), (312, "é è"),
             (20, prose(20, 50)), (400, prose(77, 40_000)), (401, near(prose(77, 40_000), 5, 0.002))]
    return rows


@pytest.mark.parametrize("k,num,den,block,most", [(3, 90, 100, 64, 1000), (3, 90, 100, 3, 0), (5, 80, 100, 8, 1000),
                                                  (1, 50, 100, 4, 0), (2, 100, 100, 8, 1000)])
def test_against_all_pairs(spark, k, num, den, block, most):
    rows = corpus()
    got = jaccard_components(docs_of(spark, rows).repartition(5), k, num, den, block=block, most_broadcast=most).collect()
    assert len(got) == len(rows)
    want = brute(rows, k, num, den)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t, k)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)


def test_prefix_size_is_what_a_link_allows():
    for n in range(1, 300):
        for num, den in ((90, 100), (80, 100), (1, 2), (1, 1)):
            least = -(-num * n // den)                                   # a link shares at least this many tokens
            assert prefix_size(n, num, den) == n - least + 1


@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_one_id_with_two_texts(spark, at):
    one, two = prose(1, 60), prose(2, 60)
    rows = [(7, one), (7, two), (8, near(one, 1, 0.01)), (9, near(two, 2, 0.01)), (3, one), (10, prose(3, 60))]
    rows = rows[at:] + rows[:at]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(docs_of(spark, rows).coalesce(1), 3, 80, 100).collect()}
    assert got == {(3, 3), (7, 3), (8, 3), (9, 3), (10, 10)}


def test_chains_of_near_copies_that_stars_leave_apart(spark):
    """Every text differs a little from the one before, so most pairs do not
    link and several parts meet in the second opening only."""
    text, rows = prose(5, 150).split(" "), []
    for i in range(80):
        text = list(text)
        text[(i * 7) % 150] = f"v{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, prose(5, 150) + f" x{i}") for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_components(docs_of(spark, rows).repartition(3), 3, 90, 100, block=4).collect()}
    assert got == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stars_are_the_same_for_any_batches(size):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(40), rng.randrange(4), rng.randrange(30)) for _ in range(400)})
    rows = [(t, b, 100 * b + g) for t, b, g in rows for _ in range(rng.choice((1, 2)))]
    data = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["token", "band", "least"])
    out = [r for b in token_stars(data.slice(i, size) for i in range(0, len(rows), size)) for r in zip(*(c.to_pylist() for c in b.columns))]
    first, want = {}, set()
    for t, b, g in rows:
        for c in (first.setdefault((t, b), g), first.get((t, b - 1), g)):
            if c != g:
                want.add((min(c, g), max(c, g)))
    assert {(a, b) for t, a, b in out if t is None} == want
    lists = {(t, b, a) for t, a, b in out if t is not None}
    several = {t for t, _, _ in rows if len({r for r in rows if r[0] == t}) >= 3}
    assert lists <= set(rows) and {r for r in set(rows) if r[0] in several} <= lists


def test_null_ids_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, 2), (3, "a b c d", 1, 2), (4, "a b c d", 1, 2)],
                               "doc_id long, text string, node int, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (4, 3)], key=str)
    kept = keep_first_of_groups(df)
    assert kept.dtypes == df.dtypes and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 3], key=str)
    assert jaccard_components(df.filter("false")).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(6)
    order = list(range(200))
    rng.shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (None, 3), (3000, 2999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{1000 + i: 1000 for i in range(1, 300)}, 3000: 2999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_that_do_not_link_are_not_opened_in_pairs(spark, monkeypatch):
    """Copies of one text, each with words of its own, share their deciding
    tokens but link with few: the second opening gets no pair for most of them."""
    import vendorscope.llm.jaccard_join as J
    rng, rows = random.Random(3), []
    for i in range(150):
        text = [f"b{k}" for k in range(60)]
        for place in rng.sample(range(60), 42):
            text[place] = f"u{i}x{place}"
        rows.append((i, " ".join(text)))
    opened, units_of = [], J.units_of

    def counted(groups, pairs, num, den, block, alone):
        if not alone:
            opened.append(pairs.distinct().count())
        return units_of(groups, pairs, num, den, block, alone)
    monkeypatch.setattr(J, "units_of", counted)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of(spark, rows).repartition(3), 1, 20, 100).collect()}
    assert got == brute(rows, 1, 20, 100)
    assert len(set(got.values())) > 10 and sum(opened) < 300      # 3346 where all that share a token were opened


@pytest.mark.parametrize("meet", [1, 3, 1000])
def test_second_opening_keeps_every_pair_that_may_link(spark, meet):
    from vendorscope.llm.jaccard_join import pairs_left
    rng = random.Random(8)
    base = [rng.getrandbits(1024) for _ in range(3)]
    nodes, lists = [], []
    for i in range(60):
        marks = base[i % 3]
        for _ in range(rng.randrange(30)):
            marks ^= 1 << rng.randrange(1024)
        group = 1000 + (i if i < 40 else i % 7)                          # some groups hold several sets
        nodes.append((i, 100 + rng.randrange(12), group, marks.to_bytes(128, "big")))
        lists += [(t, group, 7 + i % 3) for t in range(4) if rng.random() < 0.6]
    found = [(i, 30) for i in range(31, 38)] + [(i, 2) for i in range(3, 30, 5)]
    stars = [(None, 1000, 1001), (None, 1010, 1020)]
    got = {(r.a, r.b) for r in pairs_left(
        spark.createDataFrame(lists + stars, "token long, a long, b long"),
        spark.createDataFrame(nodes, "node long, n long, least long, marks binary"),
        spark.createDataFrame(found, "node long, component long"), 80, 100, meet).collect()}
    own = {i: dict(found).get(i, i) for i in range(60)}
    members = {g: [x for x in nodes if x[2] == g] for g in {x[2] for x in nodes}}
    kind = {g: {own[x[0]] for x in m} for g, m in members.items()}
    could, linked = set(), set()
    for t, a, x in lists:
        for u, b, y in lists:
            if t == u and a < b and abs(x - y) <= 1 and (a, b) not in {(1000, 1001), (1010, 1020)} and (
                    len(kind[a] | kind[b]) > 1):
                could.add((a, b))
                if any((int.from_bytes(p[3], "big") ^ int.from_bytes(q[3], "big")).bit_count() * 180
                       <= (p[1] + q[1]) * 20 for p in members[a] for q in members[b]):
                    linked.add((a, b))
    assert linked <= got <= could and linked and len(got) < len(could)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_lists_hold_the_groups_that_have_not_met_a_partner(size):
    """Of the groups that share a token those listed are in a pair that is in
    one band or two neighbouring ones and not among the stars' pairs."""
    rng = random.Random(9)
    rows = sorted({(rng.randrange(60), rng.randrange(6), rng.randrange(12)) for _ in range(300)} | {(70, 3, g) for g in range(90)})
    rows = [(t, b, 100 * b + g) for t, b, g in rows]
    data = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["token", "band", "least"])
    out = [r for b in unmet_groups(token_stars(data.slice(i, size) for i in range(0, len(rows), size)))
           for r in zip(*(c.to_pylist() for c in b.columns))]
    lists = [(t, b, a) for t, a, b in out if t is not None]
    first = {}
    for t, b, g in rows:
        first.setdefault((t, b), g)
    want = set()
    for t, b, g in rows:
        for u, c, h in rows:
            if t == u and b <= c <= b + 1 and g < h and first[t, b] != g:
                want |= {(t, b, g), (u, c, h)}
    assert sorted(lists) == sorted(want) and len(want) < len(rows)


def test_a_token_of_many_sizes_lists_no_groups(spark, monkeypatch):
    """Texts of very different sizes share a token: no two can link, and the
    second opening has nothing to look up."""
    import vendorscope.llm.jaccard_join as J
    texts = [" ".join(f"w{i}x{k}" for k in range(4 * 5 ** i)) for i in range(5)]
    rows = [(i, t + " shared") for i, t in enumerate(texts)] + [(10 * i + j, t) for i, t in enumerate(texts, 1) for j in range(9)]
    listed, pairs_left = [], J.pairs_left

    def counted(stars, *args):
        listed.append(stars.filter("token is not null").count())
        return pairs_left(stars, *args)
    monkeypatch.setattr(J, "pairs_left", counted)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of(spark, rows).repartition(3), 1, 1, 2).collect()}
    assert got == brute(rows, 1, 1, 2) and len(set(got.values())) == 5
    assert listed == [0]                                             # 5 before, one a size
