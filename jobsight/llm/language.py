"""Language identification by nearest centroid.

A text becomes a hashed TF-IDF vector of letter 1- to 3-grams (lower case, everything but
letters acts as a word boundary). Every language keeps several centroids (spherical
k-means), a text goes to the language of its nearest centroid by cosine. It is rejected
when it lies farther from it than training texts of like length do and its grams are also
rarer (mean IDF) than those of any training text of the language: short or repetitive texts
of a known language are far from every centroid too, but made of its common grams.

Document frequencies count all training rows. Only the centroids are fitted on a bounded
sample, ``SAMPLE`` documents a language (smallest hash of the doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, unit_hash

DIM = 1 << 12
SAMPLE = 300
CENTROIDS = 4
ROUNDS = 12
PIECE = 1 << 20
# A text is rejected below this part of the lowest cosine of the training sample in its
# length band, if its mean IDF is also above the sample's highest in the language and so
# much above its median. The mean of few grams strays by STRAY over the root of their number.
REJECT_PART = 0.7
REJECT_RARE = 0.45
STRAY = 2.0
_BANDS = 24

UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


_LETTERS: np.ndarray | None = None


def gram_counts(text: str, dim: int = DIM) -> np.ndarray | None:
    """Counts of hashed letter 1-, 2- and 3-grams; None when the text has no letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    total = np.zeros(dim, np.float32)
    tail = np.zeros(2, np.uint32)
    seen = False
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "replace"), "<u4")
        wide = c >= (1 << 16)
        letter = _LETTERS[np.where(wide, 0, c)]
        if wide.any():
            letter |= wide & np.array([chr(x).isalpha() for x in c])
        seen = seen or bool(letter.any())
        c = np.where(letter, c, np.uint32(0))
        c = np.concatenate([tail, c])
        with np.errstate(over="ignore"):
            one = c[2:] * np.uint32(0x9E3779B1)
            two = (c[1:-1] * np.uint32(0x85EBCA77) + one)
            three = (c[:-2] * np.uint32(0xC2B2AE3D) + two)
        shift = np.uint32(32 - dim.bit_length() + 1)
        for h, ok in ((one, c[2:] > 0), (two ^ np.uint32(0x51ED270B), (c[1:-1] > 0) | (c[2:] > 0)),
                      (three ^ np.uint32(0x7FEB352D), c[1:-1] > 0)):
            with np.errstate(over="ignore"):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((h >> shift)[ok], minlength=dim)
        tail = c[-2:]
    return total if seen else None


@dataclass
class Model:
    """``centroids`` rows (unit length) belong to ``languages[owner]``; ``floor`` is the
    smallest accepted cosine for each band of log2(text length), unless the grams are no
    rarer than the language's ``ceiling``."""
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, cosine, accepted)``; ``und`` with score 0 for null or letterless texts."""
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        v = weigh(counts, self.idf)
        sims = self.centroids @ v
        at = int(np.argmax(sims))
        score = float(min(1.0, max(0.0, sims[at])))
        known = score >= self.floor[_band(len(text))] or rarity(counts, self.idf) <= self.ceiling[self.owner[at]]
        return self.languages[self.owner[at]], score, bool(known)


def _band(chars: int) -> int:
    return min(_BANDS - 1, int(chars).bit_length())


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def rarity(counts: np.ndarray, idf: np.ndarray) -> float:
    """Mean IDF of a text's grams, less what the mean of so few may stray."""
    n = float(counts.sum())
    return float(counts @ idf) / n - STRAY / n ** 0.5


def held_out(c: str = "doc_id") -> Column:
    """crc32 of the doc_id as text leaves remainder 2 by 4 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of lettered rows of ``docs(text)`` and, by n-gram bucket, of rows holding it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                g = gram_counts(t.as_py())
                if g is not None:
                    df[:-1] += g > 0
                    df[-1] += 1
        if df[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int64)), pa.array(df)],
                                             names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()   # DIM + 1 rows at most
    out = np.zeros(DIM + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return int(out[-1]), out[:-1]


def _kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means with farthest-first starts; deterministic."""
    mean = x.sum(axis=0)
    picks = [int(np.argmax(x @ mean))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        best = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[best == i].sum(axis=0) if (best == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: every row with a lang, a text and no held-out
    doc_id counts for the IDF; at most ``sample`` of them a language for the centroids.
    An empty training set gives a model that answers ``und``."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~held_out()).select("doc_id", "lang", "text")
    n, df = document_frequency(train)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    # a bound that about 4 x sample ids of each language pass, then the smallest hashes;
    # one size a label, fewer values than the model itself has
    sizes = train.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    few = train.select("doc_id", "lang").join(F.broadcast(sizes), "lang") \
        .where(unit_hash("doc_id") < 4.0 * sample / F.col("n")).distinct()
    w = Window.partitionBy("lang").orderBy(unit_hash("doc_id"), "doc_id")
    ids = few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample).select("doc_id", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                g = gram_counts(text)
                if g is not None:
                    at = np.flatnonzero(g)
                    rows.append((lang, len(text), at.astype(np.uint16).tobytes(), np.log1p(g[at]).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in
                 enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["lang", "chars", "at", "n"])

    picked = train.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    rows = few_rows(picked, ["lang"], sample).select("lang", "text") \
        .mapInArrow(vectors, "lang string, chars long, at binary, n binary") \
        .orderBy("lang", "chars", "at", "n").collect()   # bounded: sample x languages
    languages = sorted({r["lang"] for r in rows})
    found, owner, dense, chars, own, ceiling = [], [], [], [], [], np.zeros(len(languages))
    for i, lang in enumerate(languages):
        x, rare = [], []
        for r in rows:
            if r["lang"] == lang:
                g = np.zeros(DIM, np.float32)
                g[np.frombuffer(r["at"], np.uint16)] = np.expm1(np.frombuffer(r["n"], np.float16).astype(np.float32))
                x.append(weigh(g, idf))
                rare.append(rarity(g, idf))
                chars.append(r["chars"])
                own.append(i)
        ceiling[i] = max(max(rare), float(np.median(rare)) + REJECT_RARE)
        x = np.stack(x).astype(np.float32)
        dense.append(x)
        found.append(_kmeans(x, centroids))
        owner += [i] * len(found[-1])
    if not languages:
        return Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(_BANDS), ceiling)
    cent = np.concatenate(found)
    floor = _floors(np.concatenate(dense), np.array(own), np.array(chars), cent, np.array(owner))
    return Model(languages, idf, cent, np.array(owner), floor, ceiling)


def _floors(x, own, chars, cent, owner) -> np.ndarray:
    """Smallest accepted cosine per length band. No band asks for more than a longer one; a
    band without samples takes the bound of the next longer band, or of the longest one."""
    sims = x @ cent.T
    best = np.where(owner[None, :] == own[:, None], sims, -1).max(axis=1)
    band = np.array([_band(c) for c in chars])
    floor = np.full(_BANDS, np.inf)
    np.minimum.at(floor, band, best * REJECT_PART)
    floor = np.minimum.accumulate(floor[::-1])[::-1]      # shorter texts never face more
    last = floor[np.isfinite(floor)]
    floor[~np.isfinite(floor)] = last[-1] if len(last) else 0.0
    return floor


_OUT = "lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score`` and ``accepted`` for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)          # DIM x centroids, independent of the data
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = source.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("accepted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([g[i] for g in got], t) for i, t in
                    enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols],
                                             names=[*b.schema.names[:-1], "lang_pred", "score", "accepted"])

    return source.mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted.

    Null or letterless text: ``und``, score 0, not accepted. A null lang trains nothing; a
    null doc_id is never held out and trains nothing. Repeated rows are answered each; an
    empty table gives an empty result. Ties go to the first language by name. Very long texts
    are read whole."""
    model = fit(docs)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without rows whose language is rejected (no letters, or too far from every
    centroid). The prediction rides with the whole row, so nothing is joined back."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])    # any column names may come in
    source = plain.select("*", F.col(f"c{docs.columns.index('text')}").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ok = pa.array([m.predict(t.as_py())[2] for t in b.column(b.num_columns - 1)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(ok)

    return source.mapInArrow(run, plain.schema).toDF(*docs.columns)
