"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / size`` copies, at most ``MOST``. The expected
copies are summed up along the source, one random offset is added, and a document is
emitted once for each integer its piece of the line crosses. Documents stand in order of
their size (ties by a hash), so at every size the mix takes the expected share to within
one document: a source's taken words miss its target by less than its longest document.

Places come from one range-partitioned sort of (source, size, hash) without texts, so a
source that holds most rows spreads over all tasks. Targets are solved by rounds of
aggregates over the table of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, positions, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)      # repeated along the sources
MOST = 3.0                     # targets stop at this multiple of the source's size
SEED = 20_240_501


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _by_source() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]      # code points, null last


def with_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: the whole size shared by weight,
    what passes ``most`` times a source's size reshared among the others until none does.
    Each round stops at least one source or ends; the size of what is shared never
    exceeds what the sources can take, as ``most`` is at least 1. The weights follow the
    sources in code point order, null last; an empty table stays empty."""
    ranked = positions(sources, _by_source())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    x = cut(ranked.withColumn("_w", weight).withColumn("_full", F.lit(False)).drop("_at", "_part"))
    whole = float(x.agg(F.sum("source_size")).first()[0] or 0)
    limit, stopped = F.lit(float(most)) * F.col("source_size"), 0
    while True:
        taken, open_weight = x.agg(F.sum(F.when(F.col("_full"), limit)), F.sum(F.when(~F.col("_full"), F.col("_w")))).first()
        share = F.lit((whole - (taken or 0.0)) / open_weight if open_weight else 0.0) * F.col("_w")
        now = x.withColumn("_full", F.col("_full") | (share > limit))
        full = now.where("_full").count()
        if full == stopped:
            return x.withColumn("target", F.when(F.col("_full"), limit).otherwise(share)).drop("_w", "_full")
        x, stopped = cut(now), full


def copies(docs: DataFrame, size: Column, weights=WEIGHTS, most: float = MOST, seed: int = SEED,
           carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``source, size, source_size, target, copies`` and what
    ``carry`` names. ``size`` is a non-negative integer column.

    A null source is a source of its own. Documents of size 0 are placed and emitted like
    others and add no words; a source without words has target 0 and emits nothing. Rows
    of equal source, size and hash are ordered by what they carry; rows alike in all are
    interchangeable. The offset of a source is a hash of ``seed`` and its name, so reruns agree."""
    carry = carry or {}
    every = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(docs.columns)])
    rows = cut(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"),
                           every.alias("_hash"), *[c.alias(n) for n, c in carry.items()]))
    placed = positions(rows, [*_by_source(), F.col("size"), F.col("_hash"), *[F.col(n) for n in carry]])
    sources = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # one line per source and range of places: a source that holds most rows has many
    lines = placed.groupBy("_part", "source").agg(F.min("_at").alias("_first"))
    first = lines.groupBy("source").agg(F.min("_first").alias("_first"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sources = sources.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))) \
        .withColumn("_offset", unit_hash(F.lit(seed), key)).drop("_s")
    lines = lines.select(F.col("_part").alias("_p"), F.col("source").alias("_s"))
    lines = lines.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    joined = placed.join(lines, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_p")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    at = F.col("_at") - F.col("_first")
    crossed = F.floor((at + 1) * rate + F.col("_offset")) - F.floor(at * rate + F.col("_offset"))
    return joined.withColumn("copies", crossed.cast("long")).drop("_at", "_part", "_first", "_offset", "_hash")


def mix(docs: DataFrame, text_col: str = "text", weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixture itself: each row of ``docs(text, source, ...)`` as often as it is
    emitted. Copies are found for rows without texts and joined back by a hash of the
    whole row; rows alike in all columns share their copies."""
    ident = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    plan = copies(docs, size_of(F.col(f"`{text_col}`")), weights, most, seed, {"_row": ident})
    times = plan.groupBy("_row").agg(F.sum("copies").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    x = docs.withColumn("_row", ident).join(times.where("_times > 0"), "_row")
    once = x.where("_rows = 1").unionByName(x.where("_rows > 1").dropDuplicates(["_row"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))) \
        .drop("_row", "_times", "_rows", "_copy")


def op11(docs: DataFrame) -> DataFrame:
    """Per row of documents its size, its source's size and target, and the words taken."""
    docs = docs.select("doc_id", "text", "source")
    out = copies(docs, size_of(F.col("text").cast("string")), carry={"doc_id": F.col("doc_id")})
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "source", "copies")
