"""Windows, per-group top-k and ordered pages (W1–W7, L1–L5).

Skew notes: per-group top-k uses a constant rank bound so Spark plans a
WindowGroupLimit (partial top-k before the shuffle); the trailing-window count
(W4) splits each queue into time buckets with a one-bucket halo, so a hot queue
is spread over many tasks; latest-per-key (W7) is an aggregate, not a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros, failure_prompt
from ..schema import DECLARED_TRANSITIONS, DEFAULT_LEASE_SECS, OUTBOX_BATCH, OUTBOX_LOCK_SECS
from ..session import secs, ts
from .filters import due_condition


def _order(spec) -> list[Column]:
    """[('created_at', 'desc'), ('job_id', 'asc')] → Columns (nulls last on desc)."""
    out = []
    for s in spec:
        name, direction = (s, "asc") if isinstance(s, str) else s
        c = F.col(name)
        out.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first())
    return out


# W1 ---------------------------------------------------------------------------
def latest_logs(logs: DataFrame, n: int = 100, key: str = "job_id", ts_col: str = "created_at",
                id_col: str = "log_id") -> DataFrame:
    """Newest n rows per key (n clamped to 1..500)."""
    n = max(1, min(500, int(n)))
    w = Window.partitionBy(key).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    return logs.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= n)


# skew-safe numbering ------------------------------------------------------------
# A group is cut into buckets that rise with its order (days of a timestamp, ranges of
# an id): windows run inside (group, bucket), and what lies before a bucket comes from a
# small table with one row per (group, bucket). One lazy plan for every size: no probe, no
# job while building, and a hot group spreads over as many tasks as it has buckets.
def _cut_groups(df: DataFrame, bucket) -> tuple[DataFrame, list[str], list[Column]]:
    spec = [(c, "asc") if not isinstance(c, tuple) else c for c in bucket]
    names = [f"__b{i}" for i in range(len(spec))]
    df = df.withColumns({n: (F.expr(c) if isinstance(c, str) else c) for n, (c, _) in zip(names, spec)})
    return df, names, _order([(n, d) for n, (_, d) in zip(names, spec)])


def _with_offsets(x: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join of each row with its (group, bucket) line."""
    o = offsets.select(*[F.col(k).alias(f"__o_{k}") for k in keys],
                       *[c for c in offsets.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys])
    return x.join(o, cond).drop(*[f"__o_{k}" for k in keys])


def day(c: str) -> Column:
    return F.to_date(F.col(c))


def id_range(c: str, width: int = 1_000_000) -> Column:
    return F.floor(F.col(c) / width)


def row_number_in_groups(df: DataFrame, group: list[str], order, bucket, name: str = "rn") -> DataFrame:
    """``row_number() over (partition by group order by order)``. ``bucket``: columns or
    expressions, or (either, "desc"), that never fall along ``order``."""
    x, names, rising = _cut_groups(df, bucket)
    keys = [*group, *names]
    before = Window.partitionBy(*group).orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys).orderBy(*_order(order))
    out = _with_offsets(x.withColumn("__i", F.row_number().over(inside)), offsets, keys)
    return out.withColumn(name, (F.col("__i") + F.col("__off")).cast("long")).drop("__i", "__off", *names)


def running_sum_in_groups(df: DataFrame, group: list[str], order, value: str, name: str, bucket) -> DataFrame:
    """``sum(value) over (partition by group order by order rows unbounded preceding)``;
    nulls count as 0."""
    x, names, rising = _cut_groups(df, bucket)
    keys = [*group, *names]
    before = Window.partitionBy(*group).orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*keys).agg(F.sum(value).alias("__t"))
    offsets = sums.withColumn("__off", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = (Window.partitionBy(*keys).orderBy(*_order(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _with_offsets(x.withColumn("__cum", F.coalesce(F.sum(value).over(inside), F.lit(0))), offsets, keys)
    return out.withColumn(name, (F.col("__cum") + F.col("__off")).cast("long")).drop("__cum", "__off", *names)


def lag_in_groups(df: DataFrame, group: list[str], order: list[str], cols: list[str], bucket,
                  prefix: str = "prev_", rn: str = "__rn") -> DataFrame:
    """``lag(col) over (partition by group order by order)`` for ``cols`` and the row
    number; ascending order only. A bucket's first row takes the last row of the bucket
    before it."""
    x, names, rising = _cut_groups(df, bucket)
    keys = [*group, *names]
    by = Window.partitionBy(*group).orderBy(*rising)
    lines = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                 F.max_by(F.struct(*cols), F.struct(*order)).alias("__last"))
    lines = lines.withColumns({
        "__off": F.coalesce(F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__prev": F.lag("__last").over(by)}).drop("__n", "__last")
    inside = Window.partitionBy(*keys).orderBy(*_order(order))
    x = x.withColumns({"__i": F.row_number().over(inside), **{f"__l_{c}": F.lag(c).over(inside) for c in cols}})
    out = _with_offsets(x, lines, keys)
    out = out.withColumns({rn: (F.col("__i") + F.col("__off")).cast("long"), **{
        prefix + c: F.when(F.col("__i") == 1, F.col("__prev")[c]).otherwise(F.col(f"__l_{c}")) for c in cols}})
    return out.drop("__i", "__off", "__prev", *[f"__l_{c}" for c in cols], *names)


# W2 ---------------------------------------------------------------------------
DISPATCH_ORDER = [("priority", "desc"), ("created_at", "asc"), ("job_id", "asc")]
DISPATCH_BUCKET = [("priority", "desc"), ("to_date(created_at)", "asc")]


def dispatch_rank(jobs: DataFrame, statuses=("QUEUED",), top: int | None = None) -> DataFrame:
    """Rank of each waiting job inside its queue: priority desc, created_at, id.

    ``top`` bounds the rank (constant), which turns the window into a partial
    top-k before the shuffle. Without it every waiting job is ranked, a hot queue
    cut by priority and day of creation."""
    waiting = jobs.filter(F.col("status").isin(*statuses))
    if top:
        w = Window.partitionBy("queue_id").orderBy(*_order(DISPATCH_ORDER))
        out = waiting.withColumn("dispatch_rank", F.row_number().over(w).cast("long"))
        return out.filter(F.col("dispatch_rank") <= top)
    return row_number_in_groups(waiting, ["queue_id"], DISPATCH_ORDER, DISPATCH_BUCKET, "dispatch_rank")


# W3 ---------------------------------------------------------------------------
def allocate(queues: DataFrame, tokens: DataFrame, jobs: DataFrame, now, worker_id=None,
             lease_secs: int = DEFAULT_LEASE_SECS):
    """Claim the first free_slots claimable jobs of every unpaused queue.

    Claimable: QUEUED or RETRY_WAIT with no live lease. Jobs ranked by priority
    desc, created_at, id are matched to free slots ranked by slot_index on
    (queue, rank); a queue claims exactly as many jobs as it has free slots. A taken
    token gets the job, the worker, the next epoch and the lease's end. Returns
    (claimed jobs, updated tokens, STARTED executions)."""
    n = ts(now)
    live = queues.filter(~F.col("is_paused")).select("queue_id")
    claimable = (jobs.filter(F.col("status").isin("QUEUED", "RETRY_WAIT"))
                     .filter(F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < n))
                     .join(live, "queue_id", "left_semi"))
    empty = (tokens.filter(F.col("worker_id").isNull() & F.col("job_id").isNull())
                   .join(live, "queue_id", "left_semi").select("queue_id", "slot_index"))
    free = row_number_in_groups(empty, ["queue_id"], ["slot_index"], [id_range("slot_index")], "__rank")
    ranked = row_number_in_groups(claimable, ["queue_id"], DISPATCH_ORDER, DISPATCH_BUCKET, "__rank")
    owner = F.lit(worker_id).cast("long") if worker_id is not None else F.lit(None).cast("long")
    m = ranked.join(free, ["queue_id", "__rank"]).drop("__rank")
    claimed = (m.withColumn("status", F.lit("CLAIMED"))
                .withColumn("attempt", F.col("attempt") + 1)
                .withColumn("lease_epoch", F.col("lease_epoch") + 1)
                .withColumn("lease_owner", F.coalesce(owner, F.col("lease_owner")))
                .withColumn("lease_expires_at", n + secs(lease_secs))
                .withColumn("claimed_at", n).withColumn("updated_at", n))
    taken = claimed.select("queue_id", "slot_index", F.col("job_id").alias("__job"),
                           F.col("lease_owner").alias("__worker"), F.col("lease_expires_at").alias("__until"))
    got = F.col("__job").isNotNull()
    new_tokens = tokens.join(taken, ["queue_id", "slot_index"], "left").withColumns({
        "job_id": F.coalesce("__job", "job_id"),
        "worker_id": F.when(got, F.col("__worker")).otherwise(F.col("worker_id")),
        **({"epoch": F.when(got, F.coalesce("epoch", F.lit(0)) + 1).otherwise(F.col("epoch"))}
           if "epoch" in tokens.columns else {}),
        **({"lease_until": F.when(got, F.col("__until")).otherwise(F.col("lease_until"))}
           if "lease_until" in tokens.columns else {})}).drop("__job", "__worker", "__until")
    execs = claimed.select(
        F.sha2(F.concat_ws(":", F.lit("exec"), F.col("job_id").cast("string"),
                           F.col("attempt").cast("string")), 256).alias("execution_id"),
        "job_id", F.col("lease_owner").alias("worker_id"), "attempt", "lease_epoch",
        F.lit("STARTED").alias("status"), n.alias("started_at"))
    return claimed, new_tokens, execs


# W4 ---------------------------------------------------------------------------
def offered_load(arrivals: DataFrame, window_secs=None, limit=None, queues: DataFrame | None = None,
                 key: str = "queue_id", ts_col: str = "event_ts", id_col: str = "arrival_id") -> DataFrame:
    """Per arrival: arrivals of its queue in [at - window, at] (itself included)
    and whether that exceeds the limit. Offered load, not admission (see T4).

    Each queue is cut into buckets one window wide; a row's trailing window lies
    in its own bucket and the previous one, so every (queue, bucket) partition
    holds the bucket plus a copy of the previous bucket (halo). The count is a
    running sum at the row minus a running sum at a probe placed at at-window.
    Window widths may differ per queue (``queues.rate_window_secs``)."""
    a = arrivals.select(key, id_col, ts_col)
    if queues is not None:
        a = a.join(queues.select(key, F.col("rate_window_secs").alias("__w"),
                                 F.col("rate_limit").alias("__lim")), key)
    else:
        a = a.withColumn("__w", F.lit(window_secs).cast("long")).withColumn("__lim", F.lit(limit).cast("long"))
    wus = F.col("__w") * 1_000_000
    a = a.withColumn("__t", epoch_micros(ts_col)).withColumn("__b", F.floor(F.col("__t") / wus))
    own = a.withColumn("__kind", F.lit(1)).withColumn("__wt", F.lit(1)).withColumn("__own", F.lit(True))
    halo = own.withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False))
    probe = (own.withColumn("__t", F.col("__t") - wus).withColumn("__kind", F.lit(0))
                .withColumn("__wt", F.lit(0)))
    u = own.unionByName(halo).unionByName(probe)
    w = (Window.partitionBy(key, "__b").orderBy("__t", "__kind")
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    c = u.withColumn("__cum", F.sum("__wt").over(w)).filter(F.col("__own"))
    g = c.groupBy(key, "__b", id_col).agg(
        F.first(F.col(ts_col)).alias(ts_col), F.first("__lim").alias("__lim"),
        (F.sum(F.when(F.col("__kind") == 1, F.col("__cum")).otherwise(0))
         - F.sum(F.when(F.col("__kind") == 0, F.col("__cum")).otherwise(0))).cast("long").alias("offered"))
    return g.select(key, id_col, ts_col, "offered",
                    F.coalesce(F.col("offered") > F.col("__lim"), F.lit(False)).alias("over_limit"))


# W5 ---------------------------------------------------------------------------
INITIAL_STATUSES = ("QUEUED", "SCHEDULED", "WAITING")


def transition_matrix(spark, pairs=DECLARED_TRANSITIONS) -> DataFrame:
    """The allowed edges as inline values, so the planner knows how small they are."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(from_status, to_status)")


def audit_transitions(events: DataFrame, matrix: DataFrame, key: str = "job_id", ts_col: str = "event_ts",
                      id_col: str = "event_id") -> DataFrame:
    """Previous status per job and whether the step is an allowed edge. A job's
    first event is allowed when it enters a creation state. A job's events are cut
    by day (one job may own a large share of them)."""
    x = lag_in_groups(events, [key], [ts_col, id_col], ["status"], [day(ts_col)]) \
        .withColumnRenamed("prev_status", "from_status").drop("__rn")
    m = matrix.select("from_status", F.col("to_status").alias("status")).withColumn("__ok", F.lit(True))
    x = x.join(m, ["from_status", "status"], "left")
    allowed = F.when(F.col("from_status").isNull(), F.col("status").isin(*INITIAL_STATUSES)) \
        .otherwise(F.coalesce(F.col("__ok"), F.lit(False)))
    return x.withColumn("allowed", allowed).drop("__ok")


# W6 ---------------------------------------------------------------------------
def lease_epochs(claims: DataFrame, key: str = "job_id", ts_col: str = "event_ts",
                 id_col: str = "event_id") -> DataFrame:
    """epoch = claim ordinal per job, previous owner, takeover flag."""
    x = lag_in_groups(claims, [key], [ts_col, id_col], ["worker_id"], [day(ts_col)], rn="epoch") \
        .withColumnRenamed("prev_worker_id", "prev_owner")
    return x.withColumn("takeover", F.coalesce(F.col("prev_owner") != F.col("worker_id"), F.lit(False)))


# W7 ---------------------------------------------------------------------------
def latest_by(df: DataFrame, key, ts_col: str, tiebreak: str) -> DataFrame:
    """Latest row per key by (ts, tiebreak) as an aggregate (partial per task)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts_col, tiebreak)).alias("__r"))
    return g.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


# L1 / L2 ----------------------------------------------------------------------
def page(df: DataFrame, order, page_no: int = 1, size: int = 20) -> DataFrame:
    """1-indexed page, size clamped to 1..100; order must end with a unique id."""
    size = max(1, min(100, int(size or 20)))
    page_no = max(1, int(page_no or 1))
    return df.orderBy(*_order(order)).offset((page_no - 1) * size).limit(size)


LISTING_ORDERS = {
    "queues": [("created_at", "desc"), ("queue_id", "asc")],
    "executions": [("started_at", "desc"), ("execution_id", "asc")],
    "workers": [("started_at", "desc"), ("worker_id", "asc")],
    "dead_letter_entries": [("moved_at", "desc"), ("dlq_id", "asc")],
    "workflow_jobs": [("created_at", "asc"), ("job_id", "asc")],
    "jobs": [("created_at", "desc"), ("job_id", "asc")],
}


def listing(df: DataFrame, order) -> DataFrame:
    """Full ordered listing (range-partitioned global sort)."""
    return df.orderBy(*_order(order))


def listing_ranked(df: DataFrame, order, group: str | None = None) -> DataFrame:
    """Listing position as a column (per group when given; global otherwise), cut by the
    day of the leading timestamp."""
    first, direction = order[0] if isinstance(order[0], tuple) else (order[0], "asc")
    return row_number_in_groups(df, [group] if group else [], order, [(day(first), direction)], "position")


# L3 ---------------------------------------------------------------------------
def due_schedules(schedules: DataFrame, now, k: int = 100) -> DataFrame:
    return (schedules.filter(due_condition("cron", now))
                     .orderBy(F.col("next_fire_at").asc(), F.col("schedule_id").asc()).limit(k))


# L4 ---------------------------------------------------------------------------
def outbox_batch(outbox: DataFrame, owner: str, now, n: int = OUTBOX_BATCH,
                 lease_secs: int = OUTBOX_LOCK_SECS) -> DataFrame:
    """Unpublished rows that are unlocked or whose lock expired, priority desc,
    created asc (id last), first n, stamped with the relay owner and lock."""
    t = ts(now)
    ready = outbox.filter(F.col("published_at").isNull()
                          & (F.col("relay_locked_until").isNull() | (F.col("relay_locked_until") < t)))
    top = ready.orderBy(F.col("priority").desc(), F.col("created_at").asc(), F.col("event_id").asc()).limit(n)
    return top.withColumn("relay_owner_id", F.lit(owner)).withColumn("relay_locked_until", t + secs(lease_secs))


# L5 ---------------------------------------------------------------------------
def pending_summaries(dlq: DataFrame, summaries: DataFrame, n: int = 5) -> DataFrame:
    todo = dlq.join(summaries.select("dlq_id"), "dlq_id", "left_anti")
    top = todo.orderBy(F.col("moved_at").asc(), F.col("dlq_id").asc()).limit(n)
    return top.withColumn("prompt", failure_prompt("error_kind", "final_error", "attempt"))


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
