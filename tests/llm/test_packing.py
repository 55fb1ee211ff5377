"""Packing: exact round trip, full windows, little padding."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from jobsight.llm import packing as K


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


def check(rows, out, encode, window=1024):
    """Every id lies in one piece, sequences are gapless and no longer than a window."""
    import collections
    want = collections.Counter()
    for d, text in rows:
        ids = encode(text)
        for s in range(0, len(ids), window):
            part = ids[s:s + window]
            want[(d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    return sum(n for p in seqs.values() for _, n in p) / (window * len(seqs)) if seqs else 1.0


def test_whole_table(spark, small, encode):
    from jobsight.llm.queries import op6_packing
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    assert check(rows, op6_packing(spark, "/root/testdata/sf0.001").collect(), encode) > 0.97


def test_edge_rows(docs_of, encode):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (4, "word " * 5000), (5, "x" * 30_000),
            (6, " " * 4000 + "end"), (7, "<|endoftext|> is a token"), (9, "a <|endoftext|> b"), (8, "héllo 漢字 \U0001f600")]
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275, 0]
    check(rows, K.pack(docs_of(rows)).collect(), encode)
    assert K.pack(docs_of(rows).limit(0)).collect() == []


def test_plan_uses_the_histogram():
    rng = np.random.default_rng(1)
    for window, hi in ((64, 64), (128, 40)):
        hist = np.bincount(rng.integers(1, hi + 1, 20_000), minlength=window + 1)
        got = np.zeros(window + 1, int)
        slots = used = 0
        for lengths, m in K.plan(hist, window):
            assert sum(lengths) <= window and m > 0
            for n in lengths:
                got[n] += m
            slots += m
            used += m * sum(lengths)
        assert (got == hist).all()
        assert used / (slots * window) > 0.99


def test_least_squares_fits():
    combos = K.combinations(32)
    hist = np.zeros(33)
    hist[[10, 12]] = 100, 50      # 10 + 10 + 12 fills a window
    x = K.repeat_counts(hist, combos, 4000)
    got = sum(np.bincount(c.ravel(), weights=np.repeat(v, c.shape[1]), minlength=33) for c, v in zip(combos, x))
    assert np.abs(got - hist).max() < 1


def test_one_length_only(docs_of, encode):
    rows = [(i, "same words here") for i in range(400)]
    assert check(rows, K.pack(docs_of(rows)).collect(), encode) > 0.7
