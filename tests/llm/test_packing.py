import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import docs_of, prose
from vendorscope.llm.packing import best_fit, pack, reduce_lengths, slot_rows
from vendorscope.llm.pretokens import by_spaces, stretch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for j, room in enumerate(bins):
            if room >= items[i] and room not in seen:
                seen.add(room)
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        bins.append(cap - items[i])
        go(i + 1, bins)
        bins.pop()
    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(400):
        cap = rng.choice([10, 20, 30])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        fixed, rest = reduce_lengths(dict(Counter(items)), cap)
        left = [x for x, n in rest.items() for _ in range(n)]
        used = sum(t for _, t in fixed)
        assert used + (optimum(left, cap) if left else 0) == optimum(items, cap), (items, cap)
        assert Counter(x for p, t in fixed for x in p * t) + Counter(left) == Counter(items)


def test_patterns_hold_everything_once():
    rng = random.Random(4)
    counts = Counter(min(1024, int(rng.expovariate(1 / 250)) + 1) for _ in range(30_000))
    slots, bins = slot_rows(dict(counts), 1024)
    total = sum(k * n for k, n in counts.items())
    assert -(-total // 1024) <= bins <= -(-total // 1024) * 1.005
    assert len(slots) < 8000
    for pattern, times in best_fit(dict(counts), 1024):
        assert times > 0 and sum(x * k for x, k in pattern) <= 1024


def check(rows, got, coder):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    lower = 0
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        sizes = [len(ids)] if len(ids) <= 1024 else ([len(ids) % 1024] if len(ids) % 1024 else []) + [1024] * (len(ids) // 1024)
        assert [r.length for r in own] == sizes and [r.piece for r in own] == list(range(len(sizes)))
        assert [r.start for r in own] == [sum(sizes[:k]) for k in range(len(sizes))]
        for r in own:
            raw = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and bytes(r.ids) == raw
        lower += len(ids)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), -(-lower // 1024)


def test_documents(spark):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    rng = random.Random(5)
    letters = list("abc   \n\t's漢\U0001F600́  \x1c1,.!;") + ["the", " of", "<|endoftext|>", "dog,", "é."]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    rows += [(i, prose(i, rng.randint(1, 900))) for i in range(300, 420)]
    rows += [(900, None), (901, ""), (902, " "), (903, prose(1, 9000)), (904, "x" * 30_000), (905, "a" * 40)]
    got = pack(docs_of(spark, rows).repartition(5), PATH, with_ids=True).collect()
    used, least = check(rows, got, coder)
    assert used <= least * 1.02 + 1


def test_repeated_rows_and_null_ids_have_their_own_places(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    got = pack(docs_of(spark, rows), PATH).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


def test_empty(spark):
    assert pack(docs_of(spark, [(1, "a")]).filter("false"), PATH).count() == 0


def test_stretches_cover_the_text():
    for t in ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n a b", "a  b c", "a \x1c b"]:
        assert "".join(map(stretch, by_spaces(t))) == t
