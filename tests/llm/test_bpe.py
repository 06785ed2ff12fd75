import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import by_id, docs_of
from vendorscope.llm.bpe import RankQueue, Vocabulary, bpe_digests

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as f:
        return Vocabulary(f.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_queue_gives_lowest_rank_first():
    rng, q = random.Random(1), RankQueue(50_000)
    ranks = [rng.randrange(50_000) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (got := q.pop()) is not None:
        out.append(got[0])
        assert got[1] == [i for i, r in enumerate(ranks) if r == got[0]]
    assert out == sorted(set(ranks))


def test_pretokens_as_the_library(vocabulary, library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abtheing ") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(400)]
    words += ["a" * n for n in (1, 2, 3, 5, 17, 4096)] + ["ab" * 900, "aba" * 700, "=" * 333, "the" * 500, "日本" * 50]
    words += ["".join(rng.choice(["ab", "a", "ba", "the", "he"]) for _ in range(300)) for _ in range(30)]
    for w, ids in zip(words, vocabulary.encode([w.encode() for w in words])):
        assert ids == library._encode_single_piece(w.encode()), w[:40]


def test_other_merge_orders():
    """Small vocabularies with clashing ranks against the plain rule: lowest
    rank, then leftmost."""
    import base64
    rng = random.Random(3)
    for _ in range(60):
        tokens = {bytes([i]): i for i in range(256)}
        for _ in range(25):
            a, b = rng.choice(list(tokens)), rng.choice([t for t in tokens if set(t) <= set(b"ab")])
            if set(a) <= set(b"ab"):
                tokens.setdefault(a + b, len(tokens))
        order = list(range(256, len(tokens)))
        rng.shuffle(order)
        tokens = {t: (r if r < 256 else order[r - 256]) for t, r in tokens.items()}
        v = Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in tokens.items()))
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(20)]
        for w, ids in zip(words, v.encode(words)):
            parts = [bytes([c]) for c in w]
            while w not in tokens:
                best = min(((tokens[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in tokens),
                           default=None)
                if best is None:
                    break
                parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids == ([tokens[w]] if w in tokens else [tokens[p] for p in parts])


def test_documents(spark, library):
    rng = random.Random(5)
    letters = list("abc  \n\t'sé漢\U0001F600\u0301\u00a0\u2003\x1c\x851,.!") + ["the", " of", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "z" * 50_000), (903, "one two " * 5000), (5, rows[5][1]), (None, "n")]
    got = bpe_digests(docs_of(spark, rows).repartition(3), RANKS, public_tokenizers.PATTERN)
    assert got.count() == len(rows)
    found = by_id(got, "doc_id")
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty(spark):
    assert bpe_digests(docs_of(spark, [(1, "a")]).filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0
