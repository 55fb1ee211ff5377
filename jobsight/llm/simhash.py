"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are merged first (equal ones form one node), then a fingerprint enters one
trie for each way a block of its bits can agree exactly (pigeonhole: ``bits`` differing
bits leave one of ``bits + 1`` blocks untouched). A trie is a sorted code array whose
nodes are index ranges; the self-join walks node pairs level by level, adds up the
differing bits and drops a pair as soon as the error budget is exceeded. Tries that hold
more than ``trie_limit`` codes are split again by a block of the bits that are still free,
which loses no pair: after two splits at most 2**20 distinct codes can share a trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, own_names, partitions, utf8
from .components import components

SHINGLE = 3
MAX_BITS = 2
TRIE_LIMIT = 1 << 17
WORK_CODES = 1 << 18
SEED = 42
_PART = 1 << 16


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text (bytes): majority of the shingles' XXH64 bits."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip((ends - lens)[:n - shingle + 1].tolist(),
                                                       ends[shingle - 1:].tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        part = np.array(hashes[i:i + _PART], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """``keep`` columns plus ``fp`` (the 64 bits as a signed long) for every row."""
    source = docs.select(*keep, utf8(text).alias("_text"))
    out = source.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_of(t.as_py(), shingle) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=[*b.schema.names[:-1], "fp"])

    return source.mapInArrow(run, out)


def _spans(width: int, parts: int) -> list[tuple[int, int]]:
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(parts)]


def _rotations(code: Column, fixed: int, bits: int) -> list[Column]:
    """``code`` once for each block of its ``64 - fixed`` free low bits, with that block
    moved to just below the fixed high bits. Moving bits keeps every Hamming distance."""
    free = 64 - fixed
    out = []
    for at, size in _spans(free, bits + 1):
        mask = ((1 << size) - 1) << at
        rest_hi = ((1 << free) - 1) & ~((1 << (at + size)) - 1)
        rest_lo = (1 << at) - 1
        signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
        moved = F.shiftleft(F.shiftrightunsigned(code.bitwiseAND(signed(mask)), at), free - size) \
            .bitwiseOR(F.shiftrightunsigned(code.bitwiseAND(signed(rest_hi)), size) if rest_hi else F.lit(0).cast("long")) \
            .bitwiseOR(code.bitwiseAND(signed(rest_lo)))
        keep = ((1 << 64) - 1) & ~((1 << free) - 1)
        out.append(moved.bitwiseOR(code.bitwiseAND(signed(keep))) if fixed else moved)
    return out


def trie_links(codes: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of positions whose codes share the group and differ in at most ``bits`` bits.

    ``codes`` is sorted within each (contiguous) group. A node is a range of positions with
    a common prefix; node pairs start as (group, group) and descend one bit at a time."""
    n = len(codes)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n]
    big = end - start > 1
    a0, a1 = start[big], end[big]
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    found = []
    for level in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(level)) & np.uint64(1)).astype(np.int64)])
        same = a0 == b0
        am = a1 - (ones[a1] - ones[a0])          # zeros come first inside a node
        bm = b1 - (ones[b1] - ones[b0])
        kids = []
        for x0, x1, y0, y1, add, cross in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False),
                                           (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            ok = (x1 > x0) & (y1 > y0) & (err + add <= bits)
            if cross:
                ok &= ~same                      # a node against itself has one mixed pair
            ok &= ~((x0 == y0) & (x1 - x0 == 1))  # a single code against itself
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], (err[ok] + add).astype(np.int8)))
        a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*kids))
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            d = np.bitwise_count(codes[i] ^ codes[j])
            near = d <= bits
            found.append(np.stack([i[near], j[near]], 1))
            a0, a1, b0, b1, err = (c[~single] for c in (a0, a1, b0, b1, err))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest position linked to each position (min-label rounds with pointer jumps)."""
    root = np.arange(n)
    if not len(pairs):
        return root
    i, j = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join_tries(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        held = 0

        def emit(cols):
            table_, key, code, fp = cols
            group = np.cumsum(np.r_[False, (table_[1:] != table_[:-1]) | (key[1:] != key[:-1])]) if len(key) else key
            order = np.lexsort((code.view(np.uint64), group))
            group, code, fp = group[order], code.view(np.uint64)[order], fp[order]
            pairs = trie_links(code, group, bits)
            root = _roots(len(fp), pairs)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            for i in range(0, len(moved), 100_000):
                m = moved[i:i + 100_000]
                yield batch(_LINK, [fp[root[m]], fp[m]])

        for b in batches:
            if not b.num_rows:
                continue
            rest.append(np.stack([np.asarray(c, dtype=np.int64) for c in b.columns]))
            held += b.num_rows
            if held < WORK_CODES:
                continue
            cols = np.concatenate(rest, axis=1)
            split = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            at = int(split[-1]) + 1 if len(split) else 0
            if at:
                yield from emit(cols[:, :at])
            rest, held = [cols[:, at:]], cols.shape[1] - at
        if held:
            yield from emit(np.concatenate(rest, axis=1))
    return run


def links(fps: DataFrame, bits: int = MAX_BITS, trie_limit: int = TRIE_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct values of ``fps.fp`` exactly as all pairs
    within ``bits`` differing bits do. Inside a trie only a star for each linked set is
    written, never all its pairs."""
    spark = fps.sparkSession
    cur = fps.select(F.col("fp").alias("code"), "fp")
    fixed, done = 0, None
    prefix = F.lit(0)
    for depth in range(3):
        turned = _rotations(F.col("code"), fixed, bits)
        size = min(s for _, s in _spans(64 - fixed, bits + 1))
        rows = cur.select(prefix.alias("way"), "fp", F.posexplode(F.array(*turned)).alias("pos", "code")) \
            .select((F.col("way") * (bits + 1) + F.col("pos")).cast("long").alias("way"), "code", "fp")
        fixed += size
        rows = rows.withColumn("key", F.shiftrightunsigned("code", 64 - fixed))
        if depth < 2:
            sizes = rows.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > trie_limit)
            hot = cut(sizes.select("way", "key"))
            any_hot = not hot.isEmpty()
        else:
            any_hot = False
        fit = rows.join(hot, ["way", "key"], "left_anti") if any_hot else rows
        part = fit.select("way", "key", "code", "fp") \
            .repartition(partitions(spark), "way", "key").sortWithinPartitions("way", "key") \
            .mapInArrow(_join_tries(bits), "a long, b long")
        done = part if done is None else done.union(part)
        if not any_hot:
            break
        cur = rows.join(hot, ["way", "key"], "left_semi").select("way", "code", "fp")
        prefix = F.col("way") + 1
    return done.distinct()


def _classes(docs: DataFrame, shingle: int, bits: int, trie_limit: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (doc_id among them), ``fp``, ``component_id`` and ``root`` for every
    row; ``root`` tells classes apart also where they share a doc_id or have none."""
    base = cut(fingerprints(docs, shingle, keep))
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = links(nodes.select("fp"), bits, trie_limit)
    comp = cut(components(edges))
    named = nodes.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = cut(named.join(lows, "root").select("fp", "component_id", "root"))
    return base.join(classes, "fp").select(*keep, "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS,
                    trie_limit: int = TRIE_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``bits``
    differing bits. A null or blank text has fingerprint zero and links like any other;
    rows with equal doc_id are separate members; a null doc_id is ignored as a class id
    unless the whole class has none (then the id is null). A bit set in exactly half the
    shingles is 0. Very long texts are taken whole; an empty table gives an empty result; other
    columns are ignored."""
    return _classes(docs, shingle, bits, trie_limit).select("doc_id", "fp", "component_id")


def hex_fp(c: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_fp().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each near-duplicate class.

    The class representative is the row of smallest doc_id (nulls last), then of smallest
    row hash; rows equal to it collapse to one. Classes are told apart by fingerprints, so
    rows of one doc_id or without any each count in their own class. Other columns may have
    any names."""
    return own_names(docs, ("doc_id", "text"), _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # nulls leave a hash unchanged, so which columns are null is hashed as well
    rows = docs.withColumn("__near_h", F.xxhash64(*cols, *[c.isNull() for c in cols]))
    same = _classes(rows, SHINGLE, MAX_BITS, TRIE_LIMIT, ("doc_id", "__near_h")) \
        .groupBy("root", "doc_id", "__near_h").agg(F.count(F.lit(1)).alias("n"))
    first = cut(same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__near_h", "n")).alias("r"))
                .select(F.col("r.doc_id").alias("__near_d"), F.col("r.__near_h").alias("__near_x"), F.col("r.n").alias("__near_n")))

    def kept(which: DataFrame) -> DataFrame:
        return rows.join(which, rows["doc_id"].eqNullSafe(which["__near_d"]) & (F.col("__near_h") == F.col("__near_x")), "left_semi")

    again = first.where(F.col("__near_n") > 1)
    if again.isEmpty():
        return kept(first).select(*cols)
    return kept(first.where(F.col("__near_n") == 1)).select(*cols) \
        .unionByName(kept(again).dropDuplicates(["doc_id", "__near_h"]).select(*cols))
