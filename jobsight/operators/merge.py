"""Set operations and merges (U1–U7). Dedup picks are aggregates (min_by/max_by),
so a hot key is combined map-side instead of landing whole in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import capacity_slots


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# U1 ---------------------------------------------------------------------------
def union_counts(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per_key(df: DataFrame, key, order, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order`` (which should end with a
    unique column). An aggregate, so partial per task."""
    ks = _keys(key)
    rest = [c for c in df.columns if c not in ks]
    pick = F.max_by if last else F.min_by
    g = df.groupBy(*ks).agg(pick(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*ks, *[F.col("__r")[c].alias(c) for c in rest])


# U2 ---------------------------------------------------------------------------
def insert_ignore(target: DataFrame, new: DataFrame, key, order=None):
    """ON CONFLICT DO NOTHING: returns (merged, inserted)."""
    ks = _keys(key)
    rest = [c for c in new.columns if c not in ks]
    # one row per key, picked deterministically (by ``order``, else by the other columns)
    n = first_per_key(new, ks, order or rest) if rest else new.distinct()
    inserted = n.join(target.select(*ks), ks, "left_anti")
    return target.unionByName(inserted.select(*target.columns)), inserted


# U3 ---------------------------------------------------------------------------
def upsert(target: DataFrame, new: DataFrame, key, order, set_cols) -> DataFrame:
    """Last row of ``new`` per key (by ``order``) updates ``set_cols`` of a
    matching target row (nulls included, as DO UPDATE SET col = EXCLUDED.col) or
    is inserted when there is no match."""
    ks = _keys(key)
    latest = first_per_key(new, ks, order, last=True)
    t = target.select(*ks, *[F.col(c).alias(f"__t_{c}") for c in target.columns if c not in ks],
                      F.lit(True).alias("__in_t"))
    nn = latest.select(*ks, *[F.col(c).alias(f"__n_{c}") for c in latest.columns if c not in ks],
                       F.lit(True).alias("__in_n"))
    j = t.join(nn, ks, "full_outer")
    cols = []
    for c in target.columns:
        if c in ks:
            cols.append(F.col(c))
        elif c in set_cols:
            cols.append(F.when(F.col("__in_n"), F.col(f"__n_{c}")).otherwise(F.col(f"__t_{c}")).alias(c))
        else:
            tv = F.col(f"__t_{c}")
            nv = F.col(f"__n_{c}") if c in latest.columns else F.lit(None)
            cols.append(F.when(F.col("__in_t"), tv).otherwise(nv).alias(c))
    return j.select(*cols)


# U4 ---------------------------------------------------------------------------
def idempotency_split(jobs: DataFrame, key=("queue_id", "idempotency_key"),
                      order=("created_at", "job_id"), id_col: str = "job_id"):
    """First job per (queue, key) is accepted, later ones are conflicts. NULL keys
    never conflict and bypass the grouping (no giant null group)."""
    ks = _keys(key)
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])
    keyed = jobs.filter(has_key)
    free = jobs.filter(~has_key)
    win = (keyed.groupBy(*ks).agg(F.min_by(F.col(id_col), F.struct(*order)).alias("__winner")))
    k2 = keyed.join(win, ks)
    accepted = free.unionByName(k2.filter(F.col(id_col) == F.col("__winner")).drop("__winner"))
    conflicts = (k2.filter(F.col(id_col) != F.col("__winner"))
                   .withColumnRenamed("__winner", "conflicts_with"))
    return accepted, conflicts


# U5 ---------------------------------------------------------------------------
def patch(target: DataFrame, patches: DataFrame, key, mode: str = "coalesce",
          now=None, stamp_col: str | None = None) -> DataFrame:
    """Partial update. ``coalesce``: a NULL patch value keeps the old value;
    ``overwrite``: a matched row takes the patch value, NULL included."""
    ks = _keys(key)
    pcols = [c for c in patches.columns if c not in ks]
    p = patches.select(*ks, *[F.col(c).alias(f"__p_{c}") for c in pcols], F.lit(True).alias("__hit"))
    j = target.join(p, ks, "left")
    out = []
    for c in target.columns:
        if c in pcols:
            pv = F.col(f"__p_{c}")
            v = F.coalesce(pv, F.col(c)) if mode == "coalesce" else \
                F.when(F.col("__hit"), pv).otherwise(F.col(c))
            out.append(v.alias(c))
        elif stamp_col and c == stamp_col and now is not None:
            from ..session import ts
            out.append(F.when(F.col("__hit"), ts(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# U6 ---------------------------------------------------------------------------
def delete_matching(target: DataFrame, keys: DataFrame, on) -> DataFrame:
    """DELETE … WHERE (key, owner) IN keys: an anti join."""
    return target.join(keys.select(*_keys(on)).distinct(), _keys(on), "left_anti")


# U7 ---------------------------------------------------------------------------
def resync_slots(tokens: DataFrame, queues: DataFrame) -> DataFrame:
    """Grow adds missing slots; shrink drops only free slots at or above the new
    maximum (held slots survive until released)."""
    q = queues.select("queue_id", "max_concurrency")
    t = tokens.join(q, "queue_id", "left")
    keep = t.filter((F.col("slot_index") < F.coalesce(F.col("max_concurrency"), F.lit(0)))
                    | F.col("worker_id").isNotNull() | F.col("job_id").isNotNull()).drop("max_concurrency")
    add = capacity_slots(q).join(tokens.select("queue_id", "slot_index"), ["queue_id", "slot_index"], "left_anti")
    for c in keep.columns:
        if c not in add.columns:
            add = add.withColumn(c, F.lit(None).cast(tokens.schema[c].dataType))
    return keep.unionByName(add.select(*keep.columns))
