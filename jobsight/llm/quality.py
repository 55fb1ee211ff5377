"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. Per language and source the minimum
covariance determinant is estimated: among halves of the rows, the one whose covariance has
the smallest determinant. Four starts (quartile spreads, spatial signs, hyperbolic tangents,
the nearest quarter) each take two concentration steps; the best two go on until their
determinant falls no more. The rows inside the 97.5 % ellipsoid of the best one give the
final mean and covariance, and documents beyond ``CUTOFF`` squared units are rejected.

A step replaces an estimate by the moments of the ``H_PART`` of rows nearest to it: one
aggregation by (group, start, distance bin) over all rows, whole bins up to the half and the
missing part of the next. Vectors are integers (256ths), so sums are exact and results do
not depend on the order of rows. Rows meet their group's estimate by (group, bucket), so a
hot group spreads. Covariances are scaled to be consistent for normal rows, and a small
diagonal (``FEATURES``) is added to all, so statistics that are constant in most texts do
not reject every text that differs a little. Groups with few rows are pooled by language,
then altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
SCALE = 256
# Names of the vector's parts, with the smallest spread taken for each. All but root_repeats,
# which the base rule bounds at sqrt(0.5), can reject alone.
FEATURES = {"log_words": 0.5, "word_length": 0.25, "log_symbols": 0.5, "root_dup_lines": 0.12,
            "root_repeats": 0.15, "root_upper": 0.1, "log_marks": 0.5}
D = len(FEATURES)
FLOOR = np.array(list(FEATURES.values())) * SCALE
H_PART = 0.5
NEAR_PART = 0.25     # rows of the start from the nearest ones
BEST = 2             # starts that go on after two steps
FALL = 1e-3          # least fall of the log determinant for which a start goes on
CUTOFF = 45.0        # chi-squared with 7 degrees of freedom, tail about 1e-7
INSIDE = 16.012764   # its 97.5 % point
# Consistency factors part / P(chi-squared with 9 degrees <= point), for the half (point
# 6.345811) and for the 97.5 %.
C_HALF = 1.694174
C_INSIDE = 1.044586
MIN_GROUP = 200
MIN_POOL = 50
_BIN = 32            # distance bins per doubling
_UNIT = 1024         # of signs and tangents, kept as integers


def text_stats(raw: bytes) -> tuple[list[int], list[float]]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the vector."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeats = repeat_words(words)
    b = np.frombuffer(raw, np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    letters = upper + int(((b >= 97) & (b <= 122)).sum()) + int((b >= 0xC2).sum())
    marks = text.count("!") + text.count("?")
    x = [np.log(max(1, n)), chars / max(1, n), np.log1p(100 * symbols / max(1, n)),
         (dup / len(lines)) ** 0.5, (repeats / max(1, n)) ** 0.5, (upper / max(1, letters)) ** 0.5,
         np.log1p(100 * marks / max(1, n))]
    return [n, chars, symbols, dup, repeats], x


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    v = len(known)
    if v < 1 << 21:
        win = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)
        win = pair * v + ids[2:]
    order = np.argsort(win, kind="stable")
    same = win[order][1:] == win[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def stats(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the five counts and ``x0..``, the vector in 256ths."""
    source = docs.select("doc_id", F.col("lang").cast("string").alias("lang"),
                         F.col("source").cast("string").alias("source"), utf8("text").alias("_text"))
    names = [*_COUNTS, *[f"x{i}" for i in range(D)]]
    zero = F.lit(0).cast("long")
    schema = source.select("doc_id", "lang", "source", *[zero.alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(3):
                counts, x = text_stats(t.as_py())
                rows.append([*counts, *[min(1 << 20, round(v * SCALE)) for v in x]])
            cols = np.array(rows, dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(cols[:, k]) for k in range(len(names))]],
                                             names=[*b.schema.names[:3], *names])

    return source.mapInArrow(run, schema)


def _meet(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``small`` (few rows a key), joined by (key, bucket)."""
    pairs = rows.select(key, "bucket").distinct().join(small, key)
    return rows.join(pairs, [key, "bucket"])


def _pooled(rows: DataFrame) -> DataFrame:
    """Adds ``grp``, (language, source) where it has enough rows, else a pool, and ``n``, its rows."""
    own = F.to_json(F.array(F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))
    pool = F.to_json(F.array(F.coalesce("lang", F.lit("\0"))))
    rows = rows.withColumn("own", own).withColumn("pool", pool)
    n1 = rows.groupBy("own", "pool").agg(F.count(F.lit(1)).alias("n"))
    n2 = n1.where(F.col("n") < MIN_GROUP).groupBy("pool").agg(F.sum("n").alias("m"))
    keys = n1.join(n2, "pool", "left").select(
        "own", "n", F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("m") >= MIN_GROUP, F.col("pool"))
        .otherwise(F.lit("[]")).alias("grp"))
    sizes = keys.groupBy("grp").agg(F.sum("n").alias("n"))
    return _meet(rows.drop("pool"), keys.drop("n").join(sizes, "grp"), "own").drop("own")


_X = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_MODEL = "grp string, start int, mean array<double>, prec array<double>, logdet double"


def _moments(x: list[Column]) -> Column:
    """The sums of ``x`` and of their products, as decimals: exact at any number of rows."""
    terms = [*x, *[x[i] * x[j] for i, j in _PAIRS]]
    return F.array(*[F.sum(t.cast("decimal(20,0)")) for t in terms])


def _covariance(h: float, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = s[:D] / h
    cov = np.zeros((D, D))
    for (i, j), v in zip(_PAIRS, s[D:]):
        cov[i, j] = cov[j, i] = v / h - m[i] * m[j]
    return m, cov


def _model(grp: str, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    cov = cov + np.diag(FLOOR ** 2)
    return grp, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _models(frame: DataFrame, make) -> DataFrame:
    """A model for each row of ``frame``: ``make(row)`` gives the tuples of ``_MODEL``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [m for r in b.itertuples() for m in make(r)]
            yield pd.DataFrame(out, columns=["grp", "start", "mean", "prec", "logdet"])

    return frame.mapInPandas(run, _MODEL)


def _middle(rows: DataFrame) -> DataFrame:
    """``grp, med, sd``: medians, and quartile distances as spreads, exact from the counts
    of each integer value."""
    long_ = rows.select("grp", F.posexplode(F.array(*_X)).alias("i", "v"))
    counts = long_.groupBy("grp", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp", "i")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    q = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("v"))).cast("double")
    quart = ranked.groupBy("grp", "i").agg(q(0.5).alias("med"), ((q(0.75) - q(0.25)) / 1.349).alias("sd"))
    floor = F.array(*[F.lit(float(f)) for f in FLOOR])
    parts = F.array_sort(F.collect_list(F.struct("i", "med", F.greatest("sd", floor[F.col("i")]).alias("sd"))))
    return quart.groupBy("grp").agg(parts.alias("p")).select("grp", F.col("p.med").alias("med"), F.col("p.sd").alias("sd"))


def _starts(rows: DataFrame) -> DataFrame:
    """The starting models of every group."""
    middle = cut(_middle(rows))
    z = [(F.col(x) - F.col("med")[i]) / F.col("sd")[i] for i, x in enumerate(_X)]
    near = _meet(rows, middle, "grp").withColumns({f"z{i}": c for i, c in enumerate(z)})
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0)))
    near = near.withColumn("norm", F.when(norm > 0, norm).otherwise(1.0))
    sign = [F.rint(F.col(f"z{i}") / F.col("norm") * _UNIT).cast("long") for i in range(D)]
    tanh = [F.rint(F.tanh(f"z{i}") * _UNIT).cast("long") for i in range(D)]
    sums = near.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), _moments(sign).alias("s"), _moments(tanh).alias("t"))

    def make(r) -> list[tuple]:
        med, sd = np.array(r.med, float), np.array(r.sd, float)
        out = [_model(r.grp, 0, med, np.diag(sd ** 2))]
        for k, s in ((1, r.s), (2, r.t)):
            cov = _covariance(r.n, np.array(s, float) / np.repeat([_UNIT, _UNIT ** 2], [D, len(_PAIRS)]))[1]
            scale = sd / np.sqrt(np.maximum(np.diag(cov), 1e-6))
            out.append(_model(r.grp, k, med, cov * np.outer(scale, scale)))
        return out

    first = cut(_models(sums.join(middle, "grp"), make))
    quarter = _concentrate(rows, first.where("start = 0"), NEAR_PART).withColumn("start", F.lit(3))
    return cut(first.unionByName(quarter))


def _distance(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` with ``start`` and ``d2``, the squared Mahalanobis distance to each of the
    group's models."""
    joined = _meet(rows, models.select("grp", "start", "mean", "prec"), "grp")
    joined = joined.withColumns({f"e{i}": F.col(x) - F.col("mean")[i] for i, x in enumerate(_X)})
    d2: Column = F.lit(0.0)
    for i, j in _PAIRS:
        d2 = d2 + F.col("prec")[i * D + j] * F.col(f"e{i}") * F.col(f"e{j}") * (1.0 if i == j else 2.0)
    return joined.withColumn("d2", d2).drop("mean", "prec", *[f"e{i}" for i in range(D)])


def _concentrate(rows: DataFrame, models: DataFrame, part: float = H_PART) -> DataFrame:
    """One concentration step of every model, to the moments of the nearest ``part``."""
    bin_ = F.floor(F.log2(F.greatest("d2", F.lit(2.0 ** -10))) * _BIN).cast("int")
    binned = _distance(rows, models).withColumn("bin", bin_).groupBy("grp", "start", "bin") \
        .agg(F.max("n").alias("all"), F.count(F.lit(1)).alias("k"), _moments([F.col(x) for x in _X]).alias("s"))
    w = Window.partitionBy("grp", "start").orderBy("bin")
    binned = binned.withColumn("upto", F.sum("k").over(w)).withColumn("h", F.floor(F.col("all") * part + 0.5)) \
        .where(F.col("upto") - F.col("k") < F.col("h")).withColumn("whole", F.col("upto") <= F.col("h"))
    size = D + len(_PAIRS)
    none = F.array(*[F.lit(0).cast("decimal(38,0)")] * size)
    whole = F.array(*[F.sum(F.when(F.col("whole"), F.col("s")[i]).otherwise(0)) for i in range(size)])
    near = binned.groupBy("grp", "start").agg(
        F.max("h").alias("h"), F.sum(F.when(F.col("whole"), F.col("k")).otherwise(0)).alias("k"), whole.alias("s"),
        F.coalesce(F.max(F.when(~F.col("whole"), F.col("k"))), F.lit(1)).alias("edge_k"),
        F.coalesce(F.first(F.when(~F.col("whole"), F.col("s")), ignorenulls=True), none).alias("edge"))

    def make(r) -> list[tuple]:
        s = np.array(r.s, float) + np.array(r.edge, float) * ((r.h - r.k) / r.edge_k)
        mean, cov = _covariance(r.h, s)
        return [_model(r.grp, r.start, mean, cov * C_HALF)]

    return _models(near, make)


def estimate(rows: DataFrame) -> DataFrame:
    """``grp, start, mean, prec, logdet``: the smallest determinant found in each group."""
    models = _starts(rows)
    for _ in range(2):
        models = cut(_concentrate(rows, models))
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    going = cut(models.withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEST).drop("r"))
    ended = []
    # A start goes on only while its log determinant, which FEATURES bounds below, falls by
    # FALL or more, so the rounds end.
    while not going.isEmpty():
        old = going.select("grp", "start", F.col("logdet").alias("was"))
        new = cut(_concentrate(rows, going).join(old, ["grp", "start"]))
        fell = F.col("logdet") < F.col("was") - FALL
        stays = new.where(~fell).select("grp", "start")
        ended.append(going.join(stays, ["grp", "start"], "left_semi"))
        going = cut(new.where(fell).drop("was"))
    out = ended[0] if ended else going
    for e in ended[1:]:
        out = out.unionByName(e)
    return cut(out.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"))


def _reweighted(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The model of the rows inside the 97.5 % ellipsoid of each group's estimate."""
    inside = _distance(rows, models).where(F.col("d2") <= INSIDE)
    sums = inside.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), _moments([F.col(x) for x in _X]).alias("s"))

    def make(r) -> list[tuple]:
        mean, cov = _covariance(r.k, np.array(r.s, float))
        return [_model(r.grp, 0, mean, cov * C_INSIDE)]

    return _models(sums, make)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, distance (null where the
    method did not judge: base_failed, or fewer than MIN_POOL rows in the last pool).

    A null text has no words and fails; a null lang or source is a group of its own; a null
    doc_id and repeated rows are judged each; very long texts are read whole; rows at equal
    distances count alike, as a bin that only partly belongs to the nearest half counts by
    its share; an empty table gives an empty result."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MIN_WORDS * F.col("n_words"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written at once, so a bucket taken from a row's place stays what it is
    all_rows = cut(stats(docs).withColumn("base_failed", failed)
                   .withColumn("bucket", (F.monotonically_increasing_id() % spread).cast("int")))
    rows = cut(_pooled(all_rows.where(~F.col("base_failed"))))
    model = cut(_reweighted(rows, estimate(rows)))
    far = F.when(F.col("n") >= MIN_POOL, F.col("d2"))
    scored = _distance(rows, model).withColumn("distance", far) \
        .select("doc_id", *_COUNTS, "base_failed", (F.coalesce("distance", F.lit(0.0)) <= CUTOFF).alias("kept"), "distance")
    rest = all_rows.where("base_failed").select("doc_id", *_COUNTS, "base_failed", F.lit(False).alias("kept"),
                                                F.lit(None).cast("double").alias("distance"))
    return scored.unionByName(rest)


def op7(docs: DataFrame) -> DataFrame:
    return judge(docs)
