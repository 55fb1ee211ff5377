"""Packing documents into fixed windows with non-negative least squares.

Documents are tokenised and cut at multiples of the window, so all but the last piece of a
document fill a window alone. The lengths of the rest form a histogram of at most
``window`` bins. All ways of filling a window exactly with one, two or three lengths are
enumerated; repeat counts ``x >= 0`` minimise ``|A x - histogram|``; they are rounded
within what is there, and the lengths left over are packed greedily (longest first, then
the longest that still fits). The plan is a table of classes (lengths, repeats), at most a
few thousand rows whatever the corpus size; every piece finds its place from its rank
among the pieces of equal length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, partitions

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
NNLS_ROUNDS = 400
_RANK_BITS = 44


class Ids:
    """Token ids of ``byte_bpe_50k.json``. The same vocabulary as a rank file is encoded
    by tiktoken, several times faster with equal ids (tested). Two kinds of text go to the
    tokenizers library itself: very long white space, on which tiktoken's splitter runs out
    of stack, and texts that spell an added token, which has an id of its own."""

    BLANK = re.compile(r"\s{500}")

    def __init__(self, ranks: bytes, path: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added) or (len(text) >= 500 and self.BLANK.search(text)):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


_IDS: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str | None = None, ranks_path: str | None = None,
           window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` for every piece of every row. A
    null or empty text is the end id alone."""
    path = path or public_tokenizers.path(VOCABULARY)
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())   # the vocabulary file
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    zero = F.lit(0).cast("long")
    schema = source.select("doc_id", *[zero.alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _IDS:
            _IDS[path] = Ids(shared.value, path)
        encode = _IDS[path]
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(encode(t.as_py()), np.array([END_ID], "<u4"))
                for s in range(0, len(ids), window):
                    part = ids[s:s + window]
                    at.append(i)
                    rows.append((s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(cols[:, k]) for k in range(4)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(run, schema)


def combinations(window: int = WINDOW) -> list[np.ndarray]:
    """Sorted lengths that fill a window exactly: one, two and three parts."""
    one = np.array([[window]])
    a = np.arange(1, window // 2 + 1)
    two = np.stack([a, window - a], 1)
    first, second = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    third = window - first - second
    ok = (first <= second) & (second <= third)
    three = np.stack([first[ok], second[ok], third[ok]], 1)
    return [one, two, three]


def repeat_counts(hist: np.ndarray, combos: list[np.ndarray], rounds: int = NNLS_ROUNDS) -> list[np.ndarray]:
    """Non-negative least squares by accelerated projected gradient: ``x`` per combination
    so that the lengths used come close to ``hist`` (index = length)."""
    scale = max(1.0, float(hist.max()))
    target = hist / scale
    size = len(hist)
    use = np.zeros(size)
    for c in combos:
        use += np.bincount(c.ravel(), minlength=size)
    step = 1.0 / (3.0 * use.max() + 1)
    x = [np.zeros(len(c)) for c in combos]
    y, t = [v.copy() for v in x], 1.0
    for _ in range(rounds):
        got = sum(np.bincount(c.ravel(), weights=np.repeat(v, c.shape[1]), minlength=size) for c, v in zip(combos, y))
        miss = target - got
        new = [np.maximum(0, v + step * miss[c].sum(axis=1)) for c, v in zip(combos, y)]
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = [n + (t - 1) / t2 * (n - o) for n, o in zip(new, x)]
        x, t = new, t2
    return [v * scale for v in x]


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Classes ``(lengths of a sequence, repeats)`` that use every length of ``hist``
    (index = length, up to the window) exactly as often as it occurs."""
    left = [int(v) for v in hist]
    out = [((window,), left[window])] if left[window] else []
    left[window] = 0
    combos = combinations(window)[1:]
    if sum(left):
        counts = repeat_counts(np.array(left, dtype=float), combos)
        order = sorted(((float(v[i]), tuple(c[i].tolist())) for c, v in zip(combos, counts)
                        for i in np.flatnonzero(v >= 0.5)), key=lambda p: (-p[0], p[1]))
        for v, lengths in order:
            need = {n: lengths.count(n) for n in lengths}
            m = min(int(v + 0.5), min(left[n] // k for n, k in need.items()))
            if m:
                out.append((lengths, m))
                for n, k in need.items():
                    left[n] -= m * k
    there = [n for n in range(1, window) if left[n]]
    while there:
        lengths, space = [], window
        used: dict[int, int] = {}
        i = len(there) - 1
        while i >= 0 and space:
            n = there[i]
            k = min(space // n, left[n])
            if k:
                used[n] = k
                lengths += [n] * k
                space -= n * k
            i -= 1
        m = min(left[n] // k for n, k in used.items())
        out.append((tuple(lengths), m))
        for n, k in used.items():
            left[n] -= m * k
        there = [n for n in there if left[n]]
    return out


def _places(classes: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Arrays sorted by (length, first rank): the key, sequence and offset of each run of ranks."""
    next_rank: dict[int, int] = {}
    key, seq, offset, base = [], [], [], 0
    for lengths, m in classes:
        at = 0
        for n in lengths:
            lo = next_rank.get(n, 0)
            next_rank[n] = lo + m
            key.append((n << _RANK_BITS) | lo)
            seq.append(base)
            offset.append(at)
            at += n
        base += m
    key = np.array(key, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], np.array(seq, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order]


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document of its own, also when a doc_id repeats or is null;
    other columns are ignored; an empty table gives an empty result. Very long texts are cut at
    multiples of the window; pieces of one length are told apart by doc_id, start and checksum,
    and any order of pieces equal in these packs alike."""
    spark = docs.sparkSession
    slots = max(64, partitions(spark))   # splits the ranking of one length over many tasks
    rows = cut(pieces(docs, path, ranks_path, window)
               .withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots))))
    sizes = rows.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))))   # window x slots rows
    hist = np.zeros(window + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():   # at most `window` rows
        hist[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_places(plan(hist, window)))
    own = Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("rn", F.row_number().over(own)).join(sizes, ["length", "slot"]) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                (F.col("ahead") + F.col("rn") - 1).alias("rank"))
    zero = F.lit(0).cast("long")
    schema = ranked.drop("rank").select("*", zero.alias("sequence_id"), zero.alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, offset = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            want = (np.asarray(b.column(2)) << _RANK_BITS) | np.asarray(b.column(5))
            i = np.searchsorted(key, want, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq[i] + (want - key[i])), pa.array(offset[i])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
