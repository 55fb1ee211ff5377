"""Word-piece counts by a linear longest-match automaton.

Words (runs without white space) are cut greedily into the longest vocabulary pieces. The
vocabulary is a trie whose nodes carry a failure link and the number of pieces that taking
the link completes, both computed once; counting reads every byte once, follows links when
no edge fits, and never builds a piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 300_000


def read_vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of a rank file (base64 and rank on a line)."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Greedy longest-match piece counts. A byte that starts no piece counts as one."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}          # node * 256 + byte -> node; the root is 0
        whole = [False]
        parent = [(0, 0)]
        for piece in pieces:
            u = 0
            for c in piece:
                v = edges.get(u << 8 | c)
                if v is None:
                    v = edges[u << 8 | c] = len(whole)
                    whole.append(False)
                    parent.append((u, c))
                u = v
            if u:
                whole[u] = True
        n = len(whole)
        fail, pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(1, n):               # a parent's number is below its child's
            depth[v] = depth[parent[v][0]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):
            if whole[v]:
                fail[v], pops[v] = 0, 1
                continue
            u, c = parent[v]
            z, k = fail[u], pops[u]
            while z > 0 and (z << 8 | c) not in edges:
                k += pops[z]
                z = fail[z]
            if z >= 0 and (z << 8 | c) in edges:
                fail[v], pops[v] = edges[z << 8 | c], k
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of one word, every byte read once unless the vocabulary lacks a byte."""
        edges, fail, pops = self.edges, self.fail, self.pops
        n = u = 0
        for c in word:
            v = edges.get(u << 8 | c)
            while v is None:
                if u == 0 or fail[u] < 0:
                    return self._with_gaps(word)
                n += pops[u]
                u = fail[u]
                v = edges.get(u << 8 | c)
            u = v
        while u > 0:
            if fail[u] < 0:
                return self._with_gaps(word)
            n += pops[u]
            u = fail[u]
        return n

    def _with_gaps(self, word: bytes) -> int:
        """The same for words with bytes that no piece covers: longest piece or one byte."""
        edges, fail, pops = self.edges, self.fail, self.pops
        n = at = 0
        while at < len(word):
            u, best, i = 0, 1, at
            while i < len(word) and (u := edges.get(u << 8 | word[i], -1)) >= 0:
                i += 1
                if fail[u] == 0 and pops[u] == 1:   # a whole piece ends here
                    best = i - at
            n += 1
            at += best
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row; a null text has none; null doc_ids and
    repeated rows are answered each; very long texts and words are read whole; no ties arise,
    since of equally long pieces there is one; an empty table gives an empty result; other
    columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(path)))   # the vocabulary's size
    source = docs.select("doc_id", utf8("text").alias("_text"))
    zero = F.lit(0).cast("long")
    schema = source.select("doc_id", zero.alias("n_words"), zero.alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        get = counts.__getitem__
        for b in batches:
            words, tokens = [], []
            for t in b.column(1):
                w = t.as_py().split()
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))],
                names=["doc_id", "n_words", "n_tokens"])

    return source.mapInArrow(run, schema)


def op8(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
