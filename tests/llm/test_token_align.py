import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs_of, prose
from vendorscope.llm.token_align import align, align_tokenizers, byte_level, run_length

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", "Hello, world!", " x  y \n  z\t\t", "unsichtbar   　 é\U0001F600",
         "has ▁ the mark", "<|endoftext|> <s> </s> <0x41>", "\x00\x1c\x85 \x1f x", "w" * 5000, prose(1, 40), prose(1, 40),
         prose(2, 3000), "don't we'll  I'm 12345 67,8", "a \n b\n\n c   \n", "naïve Übergröße señor garçon", "x" + " " * 70 + "y "]


def brute(rows):
    """Whole texts through both libraries, every pair of tokens compared."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    stand = byte_level()
    docs, counts = [], Counter()
    for key, text in rows:
        a = b = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text, num_threads=1)
            ta = [bytes(stand[c] for c in one.id_to_token(k)) for k in a]
            tb = [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode()
                  for k, p in ((k, two.id_to_piece(k)) for k in b)]
            if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
                a = b = []
        links, groups = [], []
        if a:
            ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
            cuts = sorted(set(ea) & set(eb))
            for lo, hi in zip([0, *cuts], cuts):
                groups.append(([k for k, e in zip(a, ea) if lo < e <= hi], [k for k, e in zip(b, eb) if lo < e <= hi]))
            sa, sb = [0, *ea], [0, *eb]
            links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        counts.update(set(links))
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((key, len(a), len(b), len(groups), links, hashlib.sha256(line.encode()).hexdigest() if a else ""))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted((k, na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha)
                  for k, na, nb, ng, ls, sha in docs)


def test_against_all_pairs_of_tokens(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 6000]
    want = brute(rows)
    docs = docs_of(spark, rows).selectExpr("*", "1 as n_a", "2 as pairs").repartition(3)
    got = align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    joined = align_tokenizers(docs, A, B, broadcast_pairs=0)
    assert joined.dtypes == got.dtypes and sorted(tuple(r) for r in joined.collect()) == want
    assert sum(r[1] == 0 for r in want) == 3                      # null, empty, the piece mark


def test_repeated_ids_null_ids_and_no_rows(spark):
    docs = docs_of(spark, [(None, "one two"), (7, "one two"), (7, "three")])
    got = sorted(align_tokenizers(docs, A, B).select("doc_id", "n_a", "count_sum").collect(), key=str)
    assert [r.doc_id for r in got] == [7, 7, None] and all(r.n_a for r in got)
    assert align_tokenizers(docs.filter("false"), A, B).count() == 0


ends = st.lists(st.integers(1, 4), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(0, 40))
def test_groups_are_the_common_ends(x, y, same):
    a, b = np.cumsum([1] * same + x + [1] * same), np.cumsum([1] * same + y + [1] * same)
    top = max(a[-1], b[-1]) + 1
    a, b = np.append(a, top), np.append(b, top)
    groups, la, lb = align(a, b)
    inside = sum(hi - lo - 1 for lo, hi, _, _ in groups)
    assert len(a) - inside == len(np.intersect1d(a, b))
    sa, sb = np.append(0, a), np.append(0, b)
    odd = [i for lo, hi, _, _ in groups for i in range(lo, hi)]
    assert sorted(zip(la, lb)) == [(i, j) for i in odd for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]]


@given(st.integers(0, 70), st.integers(0, 5))
def test_run_length(n, more):
    a = np.arange(n + more, dtype="<u4")
    b = np.concatenate((a[:n], a[n:] + 100))
    assert run_length(a.tobytes(), b.astype("<u4").tobytes(), 0, 0, n + more) == n


def test_a_worker_holds_a_slice_not_a_batch():
    """Aligning a batch of 3 MB keeps arrays of a slice only, and no copy of the worker's tables."""
    import tracemalloc

    import pyarrow as pa

    from vendorscope.llm.token_align import aligned_batches

    class Files:
        value = (open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(),
                 open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())

    def rows(n):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([prose(i, 7_000) for i in range(n)])], ["id", "text"])
        return sum(b.num_rows for b in aligned_batches(Files, pa.int64())(iter([batch])))

    assert rows(1) == 1                       # the tokenizers are loaded
    tracemalloc.start()
    assert rows(60) == 60
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak


def test_a_stretch_is_aligned_once(monkeypatch):
    """However often a word occurs, its tokens are aligned when it is new."""
    import vendorscope.llm.token_align as A
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, \
            open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        pair = A.Pair(f.read(), g.read())
    tokens, plain = [], A.align
    monkeypatch.setattr(A, "align", lambda a, b: tokens.append(len(a)) or plain(a, b))
    texts = ["unbelievably antidisestablishment " * 500, None, "", "antidisestablishment unbelievably", "\u2581 x", " a  b\t c\n\n d "]
    one, two = (A.documents(pair, texts) for _ in range(2))
    assert [x.to_pylist() for x in one] == [x.to_pylist() for x in two]
    assert sum(tokens) < 60 and one[0].to_pylist()[0] > 2000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\u00a0\u3000", max_size=20))
def test_stretches_by_both_ways(text):
    from vendorscope.llm.token_align import SPLIT, split
    assert [" " + s for s in split(text)] == SPLIT.split(" " + text)
