"""Which creation requests are accepted (B1, B2): rules that follow the order of requests.

A queue takes its requests one after the other. A request that creates nothing leaves no
trace: it neither holds an idempotency key nor counts against the rate limit. The limit is
checked before the keys.

Single jobs (``decide_jobs``) need no iteration: until the limit is reached every first
request of a key creates its job, from then on nothing does, so a request's fate follows
from the number of first requests before it. Batches (``decide_batches``) are
all-or-nothing, so whether one is accepted depends on which earlier ones were. That is
solved as a fixpoint over all batches at once: each round decides every batch from the
last round's verdicts on earlier ones. The first batch of a queue is right after one
round, the next after one more at most, and a verdict that stands no longer changes those
behind it, so the verdicts stop changing at the sequential result; rounds follow the
longest chain of batches that decide each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, secs, ts
from .windows import id_range, running_sum_in_groups

_LAST = (1 << 63) - 1


def in_order(df: DataFrame, id_col: str) -> DataFrame:
    """``__pos``: numeric ids by number, all others after them; ties by the id itself."""
    return df.withColumn("__pos", F.coalesce(F.col(id_col).cast("string").try_cast("long"), F.lit(_LAST)))


def _buckets(id_col: str) -> list[Column]:
    """Rising along (``__pos``, id): ranges of numbers, beginnings of other ids."""
    other = F.col("__pos") == _LAST
    return [id_range("__pos"), F.when(other, F.substring(F.col(id_col).cast("string"), 1, 4)).otherwise("")]


def room(queues: DataFrame, arrivals: DataFrame | None, now) -> DataFrame:
    """``queue_id, __room``: jobs that a queue may still create now, null without a limit."""
    lim = queues.select("queue_id", F.col("rate_limit").alias("__lim"), F.col("rate_window_secs").alias("__rw"))
    if arrivals is None:
        return lim.select("queue_id", F.col("__lim").cast("long").alias("__room"))
    n = ts(now)
    had = arrivals.join(lim, "queue_id").filter((F.col("event_ts") >= n - secs(F.col("__rw"))) & (F.col("event_ts") <= n)) \
        .groupBy("queue_id").agg(F.count(F.lit(1)).alias("__had"))
    return lim.join(had, "queue_id", "left").select("queue_id", (F.col("__lim") - F.coalesce("__had", F.lit(0))).cast("long").alias("__room"))


def _held_keys(existing: DataFrame) -> DataFrame:
    return existing.filter(F.col("idempotency_key").isNotNull()) \
        .select(F.col("queue_id").alias("__wq"), F.col("idempotency_key").alias("__wk")).distinct()


def _same_key() -> Column:
    return (F.col("queue_id") == F.col("__wq")) & (F.col("__key") == F.col("__wk"))


def _mark_conflicts(r: DataFrame, existing: DataFrame | None, id_col: str) -> DataFrame:
    """``__conflict``: not the first request of its (queue, key), or ``existing`` has the
    key. Null keys never conflict and do not enter the grouping."""
    keyed = F.col("__key").isNotNull()
    first = r.filter(keyed).groupBy(F.col("queue_id").alias("__wq"), F.col("__key").alias("__wk")) \
        .agg(F.min(F.struct("__pos", id_col)).alias("__win"))
    if existing is not None:
        first = first.join(_held_keys(existing).withColumn("__held", F.lit(True)), ["__wq", "__wk"], "left")
    else:
        first = first.withColumn("__held", F.lit(None).cast("boolean"))
    lost = F.coalesce(F.col("__held"), F.lit(False)) | (F.struct("__pos", id_col) != F.col("__win"))
    marked = r.filter(keyed).join(first, _same_key()).withColumn("__conflict", lost).drop("__wq", "__wk", "__win", "__held")
    return marked.unionByName(r.filter(~keyed).withColumn("__conflict", F.lit(False)))


def decide_jobs(requests: DataFrame, id_col: str, existing: DataFrame | None = None,
                queue_room: DataFrame | None = None) -> DataFrame:
    """``requests(id, queue_id, __key, __pos, ...)`` with ``__reject``: null, ``rate_limited`` or
    ``idempotency_conflict``. ``queue_room`` (see ``room``) switches the limit on."""
    x = _mark_conflicts(requests, existing, id_col)
    conflict = F.when(F.col("__conflict"), "idempotency_conflict")
    if queue_room is None:
        return x.withColumn("__reject", conflict).drop("__conflict")
    x = x.withColumn("__makes", F.when(F.col("__conflict"), 0).otherwise(1).cast("long"))
    x = running_sum_in_groups(x, ["queue_id"], ["__pos", id_col], "__makes", "__upto", _buckets(id_col))
    x = x.join(queue_room, "queue_id", "left")
    full = F.coalesce(F.col("__upto") - F.col("__makes") >= F.col("__room"), F.lit(False))
    return x.withColumn("__reject", F.when(full, "rate_limited").otherwise(conflict)) \
        .drop("__conflict", "__makes", "__upto", "__room")


def decide_batches(batches: DataFrame, items: DataFrame, id_col: str, existing: DataFrame | None = None,
                   queue_room: DataFrame | None = None) -> DataFrame:
    """``batches(id, queue_id, __n)`` with ``__reject``. ``items(id, queue_id, __key)`` are the
    keyed items of these batches; a batch that repeats a key or uses a held one conflicts
    with itself or the past, whatever the others do."""
    items = cut_lineage(in_order(items.filter(F.col("__key").isNotNull()), id_col).select(id_col, "queue_id", "__key", "__pos"))
    bad = items.groupBy(id_col, "__key").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select(id_col)
    if existing is not None:
        held = items.join(_held_keys(existing), _same_key(), "left_semi")
        bad = bad.unionByName(held.select(id_col))
    clash = bad.distinct().withColumn("__clash", F.lit(True))
    x = in_order(batches, id_col).join(clash, id_col, "left").withColumn("__clash", F.coalesce("__clash", F.lit(False)))
    x = x.join(queue_room, "queue_id", "left") if queue_room is not None else x.withColumn("__room", F.lit(None).cast("long"))
    cols = [id_col, "queue_id", "__n", "__pos", "__clash", "__room"]
    x = cut_lineage(x.select(*cols, (~F.col("__clash")).alias("__ok"), F.lit(None).cast("string").alias("__reject")))
    while True:
        taken = items.join(x.filter("__ok").select(id_col), id_col, "left_semi") \
            .groupBy(F.col("queue_id").alias("__wq"), F.col("__key").alias("__wk")).agg(F.min(F.struct("__pos", id_col)).alias("__win"))
        blocked = items.join(taken, _same_key()).filter(F.col("__win") < F.struct("__pos", id_col)) \
            .select(id_col).distinct().withColumn("__blocked", F.lit(True))
        y = x.withColumn("__made", F.when(F.col("__ok"), F.col("__n")).otherwise(0).cast("long"))
        y = running_sum_in_groups(y, ["queue_id"], ["__pos", id_col], "__made", "__upto", _buckets(id_col))
        y = y.join(blocked, id_col, "left")
        over = F.coalesce(F.col("__upto") - F.col("__made") + F.col("__n") > F.col("__room"), F.lit(False))
        conflict = F.col("__clash") | F.coalesce("__blocked", F.lit(False))
        reject = F.when(over, "rate_limited").when(conflict, "idempotency_conflict")
        y = cut_lineage(y.select(*cols, reject.isNull().alias("__ok"), reject.alias("__reject"), F.col("__ok").alias("__was")))
        if y.filter("__ok <> __was").isEmpty():
            return y.select(id_col, "queue_id", "__reject")
        x = y.drop("__was")
