import math
from collections import Counter

import numpy as np

from tests.llm.helpers import crc_mod, docs_of, prose, words
from vendorscope.llm.pitman_yor import Batch, pack, pack_tokens, score_texts, seat, unpack, unpack_tokens
from vendorscope.llm.shingles import Shingler


def corpus():
    rows = [(i, prose(i % 50, 20 + i % 30)) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, "never seen-before here"), (903, prose(3, 60_000)), (5, rows[5][1]),
                   (904, "ALPHA alpha\x0bbeta\x1cgamma"), (905, "é")]


def test_base_scores_counts_and_improvement(spark):
    rows = corpus()
    got = score_texts(docs_of(spark, rows).repartition(4)).collect()
    tokens = [(i, words(t) + [None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if crc_mod(i, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i, crc_mod(i, 10) == 0, len(ws), sum(count[w] > 0 for w in ws), n) for i, ws in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {i: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in tokens}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-6 * max(1, -base[r.doc_id]) for r in got)
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)
    seen = [r for r in got if not r.held_out and r.doc_id < 150]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_disjoint_texts_stay_below_one(spark):
    """Held-out texts of no, one and two words are disjoint events."""
    learn = [(i, prose(i, 15)) for i in range(60)]
    vocabulary = sorted({w for i, t in learn if crc_mod(i, 10) for w in words(t)})
    ids = iter(i for i in range(10_000, 10**6) if crc_mod(i, 10) == 0)
    probe = {next(ids): f"{vocabulary[0]} {w}" for w in vocabulary + ["unknown-type"]}
    alone = next(ids)
    chain = {next(ids): w for w in vocabulary + ["unknown-type"]}
    empty = next(ids)
    rows = learn + list(probe.items()) + list(chain.items()) + [(alone, vocabulary[0]), (empty, "")]
    p = {r.doc_id: 10 ** r.score for r in score_texts(docs_of(spark, rows)).collect()}
    assert 0 < p[empty] < 1
    assert p[empty] + sum(p[i] for i in chain) < 1
    assert sum(p[i] for i in probe) + p[alone] < 1


def test_predictive_of_one_restaurant_is_normalised():
    rng = np.random.default_rng(3)
    c = rng.integers(1, 50, 200)
    d, s = 0.7, 1.0
    t = seat(c, np.full(200, 0.3), d, rng)
    parent = np.full(200, 1 / 200)
    p = (c - d * t) / (s + c.sum()) + (s + d * t.sum()) / (s + c.sum()) * parent
    assert abs(p.sum() - 1) < 1e-9 and (t >= 1).all() and (t <= c).all()


def test_seating_mean_against_one_by_one():
    rng = np.random.default_rng(4)

    def plain(c, a, d):
        t = 1
        for i in range(1, c):
            t += rng.random() < a / (a + i - d * t)
        return t
    for c, a, d in ((1, 1.0, 0.5), (2, 0.7, 0.5), (30, 2.0, 0.8), (700, 5.0, 0.3)):
        fast = seat(np.full(4000, c), np.full(4000, a), d, rng)
        slow = np.mean([plain(c, a, d) for _ in range(1500)])
        assert abs(fast.mean() - slow) < 0.06 * slow + 0.02
    assert seat(np.array([0, 10**9]), np.array([1.0, 3.0]), 0.5, rng)[1] < 200


def test_blobs_and_batches():
    a, b = np.arange(5, dtype=np.uint64), np.zeros(0, np.float32)
    x, y = unpack(pack(a, b))
    assert (x == a).all() and x.dtype == a.dtype and len(y) == 0 and y.dtype == b.dtype
    words_ = np.sort(np.array([1 << 63, 5, 1 << 40], np.uint64))
    at = np.array([0, 2, 1, 1, 0])
    assert unpack_tokens(pack_tokens(at, 3)).tolist() == at.tolist()
    batch = Batch(pack(np.array([2, 3])), pack(words_), pack_tokens(at, 3))
    assert len(batch.pairs) <= 5 and (batch.pair_word[batch.pair_at] == batch.at).all()
    cover = batch.buckets(7)
    assert cover[0][1] == 0 and cover[-1][2] == 3 and all(x[2] == y[1] for x, y in zip(cover, cover[1:]))


def test_nothing_to_learn_from(spark):
    assert score_texts(docs_of(spark, [(1, "a")]).filter("false")).count() == 0
    held = [i for i in range(100) if crc_mod(i, 10) == 0][:3]
    got = score_texts(docs_of(spark, [(i, "a b") for i in held])).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-9 for r in got)


def test_every_previous_word_has_its_own_restaurant(spark):
    """Two words whose hashes share their first 12 bits are not one context."""
    names = [f"w{i}" for i in range(2000)]
    hashes, _ = Shingler(1).word_hashes([" ".join(names).encode()])
    first = {}
    for name, h in zip(names, (hashes >> np.uint64(52)).tolist()):
        if h in first:
            one, two = first[h], name
            break
        first[h] = name
    learn = [i for i in range(200) if crc_mod(i, 10)][:80]
    held = [i for i in range(1000) if crc_mod(i, 10) == 0][:4]
    rows = [(i, f"{one} alpha" if k % 2 else f"{two} beta") for k, i in enumerate(learn)]
    rows += list(zip(held, (f"{one} alpha", f"{one} beta", f"{two} alpha", f"{two} beta")))
    got = {r.doc_id: r.score for r in score_texts(docs_of(spark, rows)).collect()}
    a, b, c, d = (got[i] for i in held)
    assert a - b > 1 and d - c > 1
    assert abs(10 ** a - 0.5) < 0.1                # START has two words, each has one successor and the end


def test_pairs_are_sent_once_and_asked_for_by_place():
    """A bucket keeps a batch's pairs as places, far shorter than the pairs
    themselves, and they answer every pair with its count in training."""
    import pyarrow as pa
    from vendorscope.llm.pitman_yor import START, answer, make_batches, merge_counts, send, unpack_places

    def table(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [str(k) for k in range(len(columns))])
    texts = [prose(i, 400) + f" rare{i} rarer{i} " * (i % 3) for i in range(60)] + ["", None]
    held = [i % 7 == 0 for i in range(62)]
    made = [b for lo in (0, 40) for b in make_batches(pa.int64())(iter(
        [table((list(range(lo, min(lo + 40, 62))), held[lo:lo + 40], texts[lo:lo + 40]))]))]
    rows = [r for b in made for r in zip(*(b.column(c).to_pylist() for c in ("held", "sizes", "words", "tokens")))]
    parts = [pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x]) for x in r)], list("abcde")) for k, r in enumerate(rows)]
    messages = sorted(r for b in send(5)(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns)))
    kept = [r for b in merge_counts(5)(iter([table(list(zip(*messages)))])) for r in b.to_pylist()]
    places = [r for r in kept if r["batch"] is not None]
    assert 2 * sum(len(r["places"]) for r in places) < sum(len(m[2]) for m in messages)
    seen = Counter()
    batches = [Batch(*r[1:]) for r in rows]
    names = [np.append(b.words, START) for b in batches]
    for b, name, r in zip(batches, names, rows):
        for k, train in zip(b.pair_at.tolist(), np.repeat(~np.array(r[0]), b.sizes).tolist()):
            seen[int(name[b.pair_word[k]]), int(name[b.pair_context[k]])] += train
    served = [(r["bucket"], 0, 0, r["blob"]) for r in kept if r["blob"] is not None]
    served += [(r["bucket"], 1, 0, pack(np.ones(len(unpack(r["many"])[2]), np.float32), np.ones(r["words"], np.float32)))
               for r in kept if r["blob"] is not None]
    served += [(r["bucket"], 3, r["batch"], r["places"]) for r in places]
    got = {}
    for b in answer(iter([table(list(zip(*sorted(served, key=lambda r: r[:3]))))])):
        for k, bucket, blob in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(k, []).append((bucket, unpack(blob)))
    for k, (b, name) in enumerate(zip(batches, names)):
        n = np.concatenate([x[3] for _, x in sorted(got[k], key=lambda x: x[0])]).tolist()
        assert n == [seen[int(name[w]), int(name[c])] for w, c in zip(b.pair_word, b.pair_context)]
    assert all(len(x) == 2 for x in map(unpack_places, (r["places"] for r in places)))


def test_ascending_hashes_and_small_numbers_pack_short():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64))
    small = rng.integers(0, 200, 100_000).astype(np.uint64)
    for a, most in ((hashes, 6.5), (small, 1.3)):
        blob = pack(a)
        assert len(blob) < most * len(a) and (unpack(blob)[0] == a).all()
