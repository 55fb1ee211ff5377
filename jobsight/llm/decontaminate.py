"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) are TF-IDF vectors over hashed words. A randomised SVD, its
matrix products computed by Spark tasks over the passages, gives a latent basis whose
directions are scaled to equal variance. Every window of every document is projected and
compared by cosine with the windows of the benchmark items; a candidate counts only if the
longest common subsequence of its neighbourhood and the item covers most of the item's
words, and most of the words of its answer (the item's last part) as well.

Document frequencies count all documents, and the basis is fitted on the passages of all
documents, with all benchmark windows, which weigh more; every document is searched. What the
fit needs of the passages is their feature-by-feature product, which is summed once and has at
most ``DIM`` x ``DIM`` entries however many passages there are. The benchmark is the query set: it is taken in blocks of about ``BLOCK``
windows, each with a basis of its own, so that a growing benchmark is searched as finely as a
small one; ``TOGETHER`` blocks at a time are shared with all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names, utf8

DIM = 1 << 14
RANK = 128           # of a block's basis, at least
WINDOWS_A_RANK = 12  # benchmark windows for each direction of a larger basis
MOST_RANK = 512      # only a block of one long item needs more; any one of its windows finds it
WINDOW = 16          # words of a passage
STEP = 8             # from window to window, in documents and in the basis
ITEM_STEP = 4        # from window to window of the items searched for: two words apart at most
BACKGROUND = 12_500  # passages that those of the documents weigh as much as, if there are more
ITEM_WEIGHT = 6.0    # of a benchmark window against a document's in the basis
FIT_TASKS = 6
CHUNK = 11 << 18     # passages whose products are summed in memory
PAIRS = 1 << 22      # products taken at a time
STRIP = 1 << 7       # features, rows of the product, that are summed at a time
SUM_TASKS = 32       # tasks that add up the strips of all chunks
PART = 1 << 11       # features of a piece of the product
GROUP = 512          # passages multiplied at a time
BLOCK = 1_500        # benchmark windows
TOGETHER = 4         # blocks in one pass over the documents
COSINE = 0.75
SHORT = 24           # items of fewer words have few windows to be found by ...
SHORT_COSINE = 0.65  # ... and an edit turns each of them further
COVER = 0.7          # part of an item's words in the common subsequence
ANSWER_PART = 0.25   # last part of an item that holds its answer
ANSWER_COVER = 0.6
SLICE = 1 << 10      # windows projected and multiplied at a time
PIECE = 1 << 18      # bytes hashed at a time

# Bytes that separate words: white space and punctuation.
_SEPARATORS = b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}|*#$%&<>_/\\-"
_IN_WORD = np.ones(256, bool)
_IN_WORD[np.frombuffer(_SEPARATORS, np.uint8)] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(out, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_ids(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-cased text, and their feature ids. A word's
    id is a polynomial hash of its bytes, taken from prefix sums for all words at once."""
    starts, ends, ids = [], [], []
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        b = np.frombuffer(text, np.uint8, stop - at, at)
        if stop < len(text):                       # end the piece after a separator
            inside = _IN_WORD[b]
            last = np.flatnonzero(~inside)
            if len(last):
                stop = at + int(last[-1]) + 1
            else:
                while stop < len(text) and _IN_WORD[text[stop]]:
                    stop += 1
            b = np.frombuffer(text, np.uint8, stop - at, at)
        mark = np.zeros(len(b) + 2, np.int8)
        mark[1:-1] = _IN_WORD[b]
        step = mark[1:] - mark[:-1]
        lo, hi = (step == 1).nonzero()[0], (step == -1).nonzero()[0]
        up, down = _powers(max(PIECE, len(b)) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=sums[1:])
            h = (sums[hi] - sums[lo]) * down[lo]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        starts.append(lo + at)
        ends.append(hi + at)
        ids.append((h >> np.uint64(65 - DIM.bit_length())).astype(np.int32))
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def words_of(text: bytes) -> list[bytes]:
    t = text.lower()
    lo, hi, _ = word_ids(t)
    return [t[a:z] for a, z in zip(lo.tolist(), hi.tolist())]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel, a row a step)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    ids: list[int]

    def possible(self, there: set[int]) -> bool:
        """A subsequence cannot cover more words than are there at all."""
        return sum(i in there for i in self.ids) >= COVER * len(self.ids)

    def matches(self, region: list[bytes]) -> bool:
        """The region covers enough of the item, and of its answer."""
        if common_subsequence(self.words, region) < COVER * len(self.words):
            return False
        answer = self.words[-max(1, round(len(self.words) * ANSWER_PART)):]
        return common_subsequence(answer, region) >= ANSWER_COVER * len(answer)


@dataclass
class Index:
    weight: np.ndarray        # DIM x RANK: idf times the scaled basis; a row of zeros
    items: list[Item]
    queries: np.ndarray       # RANK x windows: unit columns over the cosine from which one is a candidate
    owner: np.ndarray

    def vectors(self, parts: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of the windows of several runs of word ids, one run after the other;
        window ``w`` of a run begins at its word ``w * STEP``."""
        halves = np.array([-(-len(p) // STEP) for p in parts])
        begin = np.concatenate([[0], np.cumsum(halves)])
        words = np.full(begin[-1] * STEP, DIM, np.int32)             # DIM: no word
        for p, at in zip(parts, (begin * STEP).tolist()):
            words[at:at + len(p)] = p
        half = np.zeros((begin[-1] + 1, self.weight.shape[1]), np.float32)
        for k in range(STEP):
            half[:-1] += self.weight[words[k::STEP]]
        n = np.maximum(1, halves - 1)
        first = np.arange(n.sum()) + np.repeat(begin[:-1] - (np.cumsum(n) - n), n)
        x = half[first] + half[np.where(np.repeat(halves, n) > 1, first + 1, begin[-1])]
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]

    def hits(self, text: bytes) -> list[int]:
        """Positions in ``items`` of the benchmark items found in the text."""
        text = text.lower()
        return self.hits_in([(text, *word_ids(text))])[0]

    def _candidates(self, docs: list[tuple]) -> list[dict[int, set[int]]]:
        """For each document its windows that come near an item, and those items. About
        ``SLICE`` windows, of one document or of several, are multiplied at a time."""
        near: list[dict[int, set[int]]] = [{} for _ in docs]
        held: list[tuple[int, int, int, np.ndarray]] = []            # document, first window, windows, ids

        def search() -> None:
            x = self.vectors([ids for _, _, _, ids in held])
            rows = np.flatnonzero((x @ self.queries).max(axis=1) >= 1.0)
            if len(rows):
                begin = np.cumsum([0, *[n for _, _, n, _ in held]])
                row, col = np.nonzero(x[rows] @ self.queries >= 1.0)
                for r, k in zip(rows[row].tolist(), self.owner[col].tolist()):
                    i = int(np.searchsorted(begin, r, side="right")) - 1
                    near[held[i][0]].setdefault(held[i][1] + r - int(begin[i]), set()).add(k)
            held.clear()

        waiting = 0
        for d, (_, _, _, ids) in enumerate(docs):
            windows = max(0, len(ids) - WINDOW + STEP - 1) // STEP + 1 if len(ids) else 0
            for w in range(0, windows, SLICE):
                n = min(SLICE, windows - w)
                held.append((d, w, n, ids[w * STEP:(w + n - 1) * STEP + WINDOW]))
                waiting += n
                if waiting >= SLICE:
                    search()
                    waiting = 0
        if held:
            search()
        return near

    def hits_in(self, docs: list[tuple]) -> list[list[int]]:
        """The same for lower-cased texts whose words are known: ``(text, starts, ends, ids)``."""
        return [self._checked(*doc, near) for doc, near in zip(docs, self._candidates(docs))]

    def _checked(self, text: bytes, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, near: dict[int, set[int]]) -> list[int]:
        found: set[int] = set()
        for w, items in near.items():
            reach = max(len(self.items[k].words) for k in items)
            there = set(ids[max(0, w * STEP - reach):w * STEP + WINDOW + reach].tolist())
            for k in items - found:
                item = self.items[k]
                if item.possible(there):
                    reach = len(item.words)
                    part = slice(max(0, w * STEP - reach), w * STEP + WINDOW + reach)
                    if item.matches([text[a:z] for a, z in zip(lo[part].tolist(), hi[part].tolist())]):
                        found.add(k)
        return sorted(found)


def _words(docs: DataFrame) -> DataFrame:
    """``ids``: the feature ids of each document that is not blank, as bytes of int16."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [word_ids(t.as_py().lower())[2] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int16).tobytes() for x in rows if len(x)], pa.binary())], names=["ids"])

    return cut(docs.select(utf8("text").alias("t")).mapInArrow(run, "ids binary"))


def _frequencies(words: DataFrame) -> tuple[int, int, np.ndarray]:
    """Number of documents of ``_words``, of their passages, and by feature of documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, passages, df = 0, 0, np.zeros(DIM, np.int64)
        last = np.zeros(DIM, np.int64)
        for b in batches:
            for raw in b.column(0):
                ids = np.frombuffer(raw.as_buffer(), np.int16)
                at = np.arange(len(ids))
                last[ids] = at
                df[ids[last[ids] == at]] += 1      # each feature once
                n += 1
                passages += -(-len(ids) // WINDOW)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 2)), pa.array(np.append(df, [n, passages]))],
                                             names=["feature", "n"])

    rows = words.mapInArrow(run, "feature long, n long") \
        .groupBy("feature").agg(F.sum("n").alias("n")).toPandas()    # DIM + 2 rows at most
    out = np.zeros(DIM + 2, np.int64)
    out[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return int(out[-2]), int(out[-1]), out[:-2]


def _starts(n: int, step: int) -> list[int]:
    return sorted({*range(0, max(1, n - WINDOW + 1), step), max(0, n - WINDOW)})


def _passages(texts: DataFrame, step: int, weight: float) -> DataFrame:
    """``ids, weight``: the feature ids of each window of ``texts.t``, as bytes of int32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                ids = word_ids(t.as_py().lower())[2]
                if len(ids):
                    rows += [ids[i:i + WINDOW].tobytes() for i in _starts(len(ids), step)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([weight] * len(rows), pa.float64())],
                                             names=["ids", "weight"])
    return texts.mapInArrow(run, "ids binary, weight double")


def _products(ids: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Strips of ``U`` for the unit TF-IDF rows ``A`` of passages ``ids`` (``DIM``: no word),
    where ``A' A = U + U'``: the first feature of each and its rows, from its own column on."""
    ids.sort(axis=1)
    unit = np.concatenate([(1 / np.sqrt(np.maximum(1e-12, (w[x] ** 2).sum(axis=1)))) for x in np.array_split(ids, len(ids) // (1 << 16) + 1)])
    places = []                                    # by position in the sorted passage: passages by feature
    for k in range(WINDOW):
        order = np.argsort(ids[:, k], kind="stable").astype(np.int32)
        places.append((order, np.searchsorted(ids[order, k], np.arange(0, DIM + 1, STRIP))))
    at, value, most = np.empty(PAIRS, np.int64), np.empty(PAIRS), PAIRS // WINDOW
    for i, first in enumerate(range(0, DIM, STRIP)):
        wide = DIM - first + 1
        total, done = np.zeros(STRIP * wide), 0
        for k, (order, edge) in enumerate(places):
            for lo in range(edge[i], edge[i + 1], most):
                rows = order[lo:min(lo + most, edge[i + 1])]
                c = ids.take(rows, 0)[:, k:]
                if done + c.size > PAIRS:
                    total += np.bincount(at[:done], value[:done], len(total))
                    done = 0
                x = w[c] * unit[rows, None]
                here = slice(done, done + c.size)
                np.multiply(x, x[:, :1].copy(), out=value[here].reshape(c.shape))
                value[here].reshape(c.shape)[:, 0] /= 2
                np.add(c, (c[:, :1].astype(np.int64) - first) * wide - first, out=at[here].reshape(c.shape))
                done += c.size
        if done:
            total += np.bincount(at[:done], value[:done], len(total))
            yield first, total.astype(np.float32).reshape(STRIP, wide)[:, :-1]


_STRIPS = "first int, held binary, part binary"


def _packed(strips: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Strips as rows of ``_STRIPS``: which entries are there, a bit each, and these entries."""
    for first, strip in strips:
        held = strip != 0
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary()),
                                          pa.array([strip[held].tobytes()], pa.binary())], names=["first", "held", "part"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for first, held, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            strip = np.zeros((STRIP, DIM - first), np.float32)
            bits = np.unpackbits(np.frombuffer(held.as_buffer(), np.uint8), count=strip.size)
            strip[bits.reshape(strip.shape).view(bool)] = np.frombuffer(part.as_buffer(), np.float32)
            yield first, strip


def _gram(words: DataFrame, idf: np.ndarray, passages: int) -> DataFrame:
    """The strips of ``U`` (see ``_products``) for the passages of all documents. A task sums
    ``CHUNK`` passages at a time, so what is shuffled is a fixed share of the input and what
    comes out is bounded by ``DIM`` alone."""
    shared = words.sparkSession.sparkContext.broadcast(np.append(idf, np.float32(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty((CHUNK, WINDOW), np.int16), 0
        for b in batches:
            for raw in b.column(0):
                ids = np.frombuffer(raw.as_buffer(), np.int16)
                whole = len(ids) // WINDOW
                rows = ids[:whole * WINDOW].reshape(whole, WINDOW)
                while len(rows):
                    some = rows[:CHUNK - n]
                    held[n:n + len(some)] = some
                    n, rows = n + len(some), rows[len(some):]
                    if n == CHUNK:
                        yield from _packed(_products(held, shared.value))
                        n = 0
                if len(ids) % WINDOW:
                    end = ids[-WINDOW:]
                    held[n, :len(end)], held[n, len(end):] = end, DIM
                    n += 1
                    if n == CHUNK:
                        yield from _packed(_products(held, shared.value))
                        n = 0
        if n:
            yield from _packed(_products(held[:n], shared.value))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for first, strip in _unpacked(batches):
            if first in sums:
                sums[first] += strip
            else:
                sums[first] = strip
        yield from _packed(iter(sums.items()))

    tasks = max(1, -(-passages // CHUNK))
    out = cut(words.coalesce(tasks).mapInArrow(run, _STRIPS).repartition(SUM_TASKS, "first").mapInArrow(add, _STRIPS))
    shared.unpersist()
    return out


@dataclass
class Background:
    """What the basis knows of the documents: IDF, the strips of ``_gram``, passages."""
    idf: np.ndarray
    strips: DataFrame
    passages: int


def _gram_times(passages: DataFrame, background: Background, g: np.ndarray) -> np.ndarray:
    """``A' A g`` for the unit TF-IDF rows ``A`` of ``passages`` and of the documents, the
    latter weighing as ``BACKGROUND`` passages at most: every task adds up its part, the
    parts are added by blocks of ``PART`` features, so the driver only ever receives one
    matrix of g's size, in small pieces."""
    shared = passages.sparkSession.sparkContext.broadcast((background.idf, g))
    share = np.float32(min(1.0, BACKGROUND / max(1, background.passages)))
    shape, rank = "block int, part binary", g.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = (np.concatenate([v, np.zeros_like(v[:1])]) for v in shared.value)    # feature DIM: no word
        total = np.zeros(m.shape, np.float32)
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                raws = [np.frombuffer(raw.as_py(), np.int32) for raw in b.column(0)[at:at + GROUP]]
                ids = np.full((len(raws), WINDOW), DIM, np.int32)
                for row, raw in zip(ids, raws):
                    row[:len(raw)] = raw
                x = w[ids]
                x *= (b.column(1)[at:at + GROUP].to_numpy() / np.sqrt(np.maximum(1e-12, (x * x).sum(axis=1))))[:, None]
                y = np.einsum("nl,nlr->nr", x, m[ids])
                # rows of one feature are added by one product each
                order = np.argsort(ids, axis=None, kind="stable")
                feature, row, x = ids.ravel()[order], order // WINDOW, x.ravel()[order]
                first = np.flatnonzero(np.diff(feature, prepend=-1))
                for f, lo, hi in zip(feature[first].tolist(), first.tolist(), [*first[1:].tolist(), len(feature)]):
                    total[f] += x[lo:hi] @ y[row[lo:hi]]
        yield pieces({i: total[i * PART:(i + 1) * PART] for i in range(DIM // PART)})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[1]
        total = np.zeros(m.shape, np.float32)
        for first, strip in _unpacked(batches):
            total[first:first + STRIP] += strip @ m[first:]
            total[first:] += strip.T @ m[first:first + STRIP]
        total *= share
        yield pieces({i: total[i * PART:(i + 1) * PART] for i in range(DIM // PART)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(raw.as_py(), np.float32)
                sums[i] = sums[i] + part if i in sums else part
        yield pieces(sums)

    def pieces(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(
            [np.ascontiguousarray(v, np.float32).tobytes() for v in parts.values()], pa.binary())], names=["block", "part"])

    out = np.zeros(g.shape, np.float32)
    both = passages.mapInArrow(run, shape).union(background.strips.coalesce(FIT_TASKS).mapInArrow(multiply, shape))
    rows = both.repartition(DIM // PART, "block").mapInArrow(add, shape)
    for r in rows.toLocalIterator():
        out[r["block"] * PART:(r["block"] + 1) * PART] = np.frombuffer(r["part"], np.float32).reshape(-1, rank)
    shared.unpersist()
    return out


def _background(docs: DataFrame) -> Background:
    """IDF and feature products of all documents."""
    words = _words(docs)
    n, passages, df = _frequencies(words)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 0.1).astype(np.float32)
    return Background(idf, _gram(words, idf, passages), passages)


def fit(docs: DataFrame, benchmark: DataFrame, rank: int | None = None, seed: int = 7,
        background: Background | None = None) -> np.ndarray:
    """The DIM x rank matrix that takes word counts to scaled latent coordinates. Without a
    ``rank`` it follows the number of benchmark windows."""
    background = background or _background(docs)
    own = benchmark.select(utf8("text").alias("t"))
    rank = rank or min(MOST_RANK, max(RANK, _passages(own, ITEM_STEP, 1.0).count() // WINDOWS_A_RANK))
    passages = cut(_passages(own, STEP, ITEM_WEIGHT).coalesce(FIT_TASKS))
    g = np.random.default_rng(seed).standard_normal((DIM, rank)).astype(np.float32)
    for _ in range(2):
        g = np.linalg.qr(_gram_times(passages, background, g))[0].astype(np.float32)
    small = (g.T @ _gram_times(passages, background, g)).astype(np.float64)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    value = np.maximum(value, 0.0)
    # a direction that hardly any passage has is scaled like the one of rank n / 4, not blown up
    ridge = np.sort(value)[::-1][:max(1, min(rank, (background.passages + passages.count()) // 4))][-1]
    scale = np.where(value > value.max() * 1e-6, 1.0 / np.sqrt(value + ridge + 1e-12), 0.0)
    return (background.idf[:, None] * (g @ (turn * scale))).astype(np.float32)


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, text`` of the items that are not blank; the others match nothing."""
    return benchmark.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("item_id", "text")


def _split(items: DataFrame, n: int, size: int) -> list[DataFrame]:
    """``items`` in ``n / size`` parts, by hash."""
    parts = -(-n // size)
    return [items.where(F.pmod(F.xxhash64("item_id", utf8("text")), F.lit(parts)) == i) if parts > 1 else items
            for i in range(parts)]


def _index(items: DataFrame, weight: np.ndarray) -> Index | None:
    own, queries, owner = [], [], []
    for r in items.select("item_id", utf8("text").alias("t")).orderBy("item_id", "t").collect():   # one block of the query set
        text = bytes(r["t"]).lower()
        ids = word_ids(text)[2]
        if not len(ids):
            continue
        for at in _starts(len(ids), ITEM_STEP):
            q = weight[ids[at:at + WINDOW]].sum(axis=0)
            queries.append(q / max(1e-9, float(np.linalg.norm(q))))
            owner.append(len(own))
        own.append(Item(r["item_id"], words_of(text), ids.tolist()))
    if not own:
        return None
    least = np.array([SHORT_COSINE if len(own[k].words) < SHORT else COSINE for k in owner])
    return Index(np.vstack([weight, np.zeros_like(weight[:1])]), own, np.ascontiguousarray(np.stack(queries).T / least, dtype=np.float32), np.array(owner))


def blocks(benchmark: DataFrame, weight: np.ndarray, size: int = 2_000) -> list[Index]:
    """Search indexes over ``benchmark(item_id, text)`` that share one basis, about ``size``
    items each. Blank items match nothing and are left out."""
    rows = _items(benchmark)
    return [ix for own in _split(rows, rows.count(), size) if (ix := _index(own, weight))]


def _flag(docs: DataFrame, indexes: list[Index], name: str) -> DataFrame:
    """``docs`` plus ``name``: the ids of the blocks' items found in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])    # any column names may come in
    source = plain.select("*", utf8(f"c{docs.columns.index('text')}").alias("text"))
    schema = plain.select("*", F.array().cast("array<long>").alias("found")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().lower() for t in b.column(b.num_columns - 1)]
            read = [(t, *word_ids(t)) for t in texts]
            got: list[list] = [[] for _ in read]
            for ix in shared.value:
                for found, hits in zip(got, ix.hits_in(read)):
                    found += [ix.items[k].item_id for k in hits]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.list_(pa.int64()))],
                                             names=[*b.schema.names[:-1], "found"])

    return source.mapInArrow(run, schema).toDF(*docs.columns, name)


def flag(docs: DataFrame, benchmark: DataFrame, name: str = "leaked_items", size: int = BLOCK) -> DataFrame:
    """``docs`` plus ``name``, the sorted ids of the benchmark items found in each text.

    Null or blank texts hold none; repeated rows are answered each; an empty benchmark or
    table finds nothing. Words are separated by white space and punctuation and compared
    with A-Z in lower case. Very long texts are read whole; equal items are each found. The
    benchmark is taken in blocks of about ``size`` windows."""
    items = _items(benchmark)
    windows = _passages(items.select(utf8("text").alias("t")), ITEM_STEP, 1.0).count()
    parts = _split(items, windows, size)
    background = _background(docs) if parts else None
    out, names = docs, []
    for i in range(0, len(parts), TOGETHER):
        indexes = [_index(own, fit(docs, own, background=background)) for own in parts[i:i + TOGETHER] if not own.isEmpty()]
        if indexes := [ix for ix in indexes if ix]:
            names.append(f"__leak_{i}")
            out = _flag(out, indexes, names[-1])
    none = F.array().cast("array<long>")
    found = F.array_sort(F.array_distinct(F.concat(none, *[F.col(c) for c in names])))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(name))


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, leaked_items."""
    return flag(docs.select("doc_id", "text"), benchmark) \
        .select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; other columns may have any names."""
    return own_names(docs, ("doc_id", "text"), lambda own: flag(own, benchmark, "__leaked")
                     .where(F.size("__leaked") == 0).drop("__leaked"))
