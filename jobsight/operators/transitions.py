"""Job-table transformations (B1–B10): state transitions as set operations.

Each returns the changed rows and the derived rows (outbox, DLQ, executions,
conflicts); callers merge them into the tables with ``merge.upsert`` /
``merge.patch``. Every change stamps ``updated_at = now``; ids of new rows are
derived from their inputs (``derived_id``) so a rerun produces the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as G
from ..session import secs, ts
from .creation import decide_batches, decide_jobs, in_order, room
from .filters import due_condition
from .joins import fence

OUTBOX_COLUMNS = ["event_id", "job_id", "queue_id", "org_id", "project_id", "subject", "payload",
                  "priority", "nats_msg_id", "created_at", "published_at"]


def outbox_for(changed: DataFrame, queues: DataFrame, projects: DataFrame, now, reason: str) -> DataFrame:
    """Outbox rows for jobs that became QUEUED: tenant context, sharded subject
    (the job's own shard), derived event id."""
    ctx = queues.select("queue_id", "project_id", F.col("shard_count").alias("__sc")) \
        .join(projects.select("project_id", "org_id"), "project_id")
    c = changed.select("job_id", "queue_id", "shard_id", "payload", "priority").join(ctx, "queue_id")
    eid = G.derived_id(F.lit("outbox"), F.lit(reason), F.col("job_id"), F.lit(str(now)))
    return c.select(
        eid.alias("event_id"), "job_id", "queue_id", "org_id", "project_id",
        G.subject("org_id", "project_id", "queue_id", "__sc", "shard_id", "priority").alias("subject"),
        "payload", "priority", eid.cast("string").alias("nats_msg_id"), ts(now).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"))


def _one_per_job(df: DataFrame) -> DataFrame:
    """One report per job, picked deterministically (reused by several outputs,
    so every branch must see the same pick)."""
    from .merge import first_per_key
    order = [c for c in ("execution_id", "epoch", "worker_id") if c in df.columns]
    return first_per_key(df, "job_id", order or [c for c in df.columns if c != "job_id"])


def _set(df: DataFrame, **cols) -> DataFrame:
    """Set several columns at once (all evaluated against the input row)."""
    return df.withColumns(cols)


def free_tokens(tokens: DataFrame, jobs: DataFrame) -> DataFrame:
    """The tokens held by ``jobs``, released: no job, worker or lease; the epoch stays."""
    t = tokens.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    gone = {"worker_id": F.lit(None).cast("long"), "job_id": F.lit(None).cast("long")}
    if "lease_until" in tokens.columns:
        gone["lease_until"] = F.lit(None).cast("timestamp_ntz")
    return t.withColumns(gone)


# B3 / B4 ----------------------------------------------------------------------
def promote(jobs: DataFrame, queues: DataFrame, projects: DataFrame, now):
    """SCHEDULED → QUEUED when due. Returns (changed, outbox)."""
    n = ts(now)
    changed = _set(jobs.filter(due_condition("scheduled", now)), status=F.lit("QUEUED"),
                   queued_at=n, updated_at=n)
    return changed, outbox_for(changed, queues, projects, now, "promote")


def requeue(jobs: DataFrame, queues: DataFrame, projects: DataFrame, now):
    """RETRY_WAIT → QUEUED when next_retry_at is due; clears next_retry_at."""
    n = ts(now)
    changed = _set(jobs.filter(due_condition("retry", now)), status=F.lit("QUEUED"),
                   next_retry_at=F.lit(None).cast("timestamp_ntz"), queued_at=n, updated_at=n)
    return changed, outbox_for(changed, queues, projects, now, "requeue")


# B5 ---------------------------------------------------------------------------
def reclaim(jobs: DataFrame, execs: DataFrame, tokens: DataFrame, queues: DataFrame,
            projects: DataFrame, now):
    """RUNNING/CLAIMED whose lease expired more than 10 s ago → QUEUED; their
    STARTED executions → ABANDONED; their tokens freed. Returns
    (changed jobs, changed executions, freed tokens, outbox)."""
    n = ts(now)
    stale = jobs.filter(due_condition("stale_lease", now))
    changed = _set(stale, status=F.lit("QUEUED"), lease_owner=F.lit(None).cast("long"),
                   lease_expires_at=F.lit(None).cast("timestamp_ntz"), queued_at=n, updated_at=n)
    ids = stale.select("job_id")
    ex = _set(execs.filter(F.col("status") == "STARTED").join(ids, "job_id", "left_semi"),
              status=F.lit("ABANDONED"), finished_at=n)
    return changed, ex, free_tokens(tokens, ids), outbox_for(changed, queues, projects, now, "reclaim")


# B6 ---------------------------------------------------------------------------
def backfill_outbox(jobs: DataFrame, outbox: DataFrame, queues: DataFrame, projects: DataFrame,
                    now, age_secs: int = 30) -> DataFrame:
    """Outbox rows for QUEUED jobs older than ``age_secs`` that have no outbox row
    at all (published rows count, so a published job is not re-sent)."""
    waiting = jobs.filter(due_condition("queued_aged", now, age_secs=age_secs))
    lacking = waiting.join(outbox.select("job_id"), "job_id", "left_anti")
    return outbox_for(lacking, queues, projects, now, "backfill")


# B7 ---------------------------------------------------------------------------
def apply_starts(jobs: DataFrame, starts: DataFrame, now) -> DataFrame:
    """CLAIMED → RUNNING for (job_id, worker_id, epoch) matching owner and epoch."""
    v = fence(starts, jobs, require_running=False)
    ok = v.filter(F.col("verdict") == "accepted").select("job_id").distinct()
    c = jobs.filter(F.col("status") == "CLAIMED").join(ok, "job_id", "left_semi")
    n = ts(now)
    return _set(c, status=F.lit("RUNNING"), started_at=n, updated_at=n)


def apply_completions(jobs: DataFrame, execs: DataFrame, tokens: DataFrame, reports: DataFrame, now):
    """Fenced completion reports (job_id, worker_id, epoch, execution_id, result):
    RUNNING → COMPLETED with the lease cleared, the execution closed with its
    duration, the token freed. Returns (jobs, executions, freed tokens, verdicts)."""
    n = ts(now)
    verdicts = fence(reports, jobs)
    ok = _one_per_job(verdicts.filter(F.col("verdict") == "accepted"))
    res = ok.select("job_id", *(["result"] if "result" in reports.columns else []))
    j = jobs.join(res, "job_id")
    changed = _set(j, status=F.lit("COMPLETED"), completed_at=n, lease_owner=F.lit(None).cast("long"),
                   lease_expires_at=F.lit(None).cast("timestamp_ntz"), updated_at=n)
    e = execs.join(ok.select("execution_id"), "execution_id", "left_semi")
    e = _set(e, status=F.lit("COMPLETED"), finished_at=n,
             duration_ms=G.duration_ms(F.col("started_at"), n))
    return changed, e, free_tokens(tokens, ok), verdicts


# B8 ---------------------------------------------------------------------------
def apply_failures(jobs: DataFrame, execs: DataFrame, tokens: DataFrame, reports: DataFrame, now):
    """Failure reports (job_id, worker_id, epoch, execution_id, outcome,
    error_message, error_kind) with outcome ``retry`` / ``permanent`` / ``unknown``.

    retry/permanent are fenced on owner and epoch only (as the failing update
    is); ``unknown`` also requires RUNNING. attempt < max_attempts and not
    permanent → RETRY_WAIT at now + retry delay; otherwise FAILED plus a DLQ row
    with the real reason; unknown → UNKNOWN_EXTERNAL_RESULT with the execution
    ABANDONED. Every accepted report frees the job's capacity token.
    Returns (jobs, executions, dlq, outcomes, freed tokens)."""
    n = ts(now)
    v = fence(reports, jobs, require_running=False)
    j = jobs.select("job_id", F.col("status").alias("__st"))
    v = v.join(j, "job_id", "left")
    verdict = F.when((F.col("verdict") == "accepted") & (F.col("outcome") == "unknown")
                     & (F.col("__st") != "RUNNING"), "not_running").otherwise(F.col("verdict"))
    v = v.withColumn("verdict", verdict).drop("__st")
    ok = _one_per_job(v.filter(F.col("verdict") == "accepted")).select(
        "job_id", "execution_id", "outcome", F.col("error_message").alias("__msg"),
        F.col("error_kind").alias("__kind"))
    x = jobs.join(ok, "job_id")
    retry = (F.col("outcome") == "retry") & (F.col("attempt") < F.col("max_attempts"))
    delay = G.retry_delay_secs("retry_strategy", "base_delay_secs", "max_delay_secs", "attempt")
    new_status = (F.when(F.col("outcome") == "unknown", "UNKNOWN_EXTERNAL_RESULT")
                   .when(retry, "RETRY_WAIT").otherwise("FAILED"))
    x = x.withColumn("__new", new_status)
    changed = _set(
        x, status=F.col("__new"),
        next_retry_at=F.when(F.col("__new") == "RETRY_WAIT", n + secs(delay)).otherwise(F.col("next_retry_at")),
        error_message=F.col("__msg"), error_kind=F.col("__kind"),
        failed_at=F.when(F.col("__new") == "FAILED", n),
        lease_owner=F.lit(None).cast("long"), lease_expires_at=F.lit(None).cast("timestamp_ntz"),
        updated_at=n)
    dlq = changed.filter(F.col("__new") == "FAILED").select(
        G.derived_id(F.lit("dlq"), F.col("job_id"), F.col("attempt")).alias("dlq_id"), "job_id", "queue_id",
        F.when(F.col("outcome") == "permanent", "permanent_failure")
         .otherwise("max_attempts_exceeded").alias("reason"),
        "error_kind", "attempt", F.col("error_message").alias("final_error"), "payload",
        n.alias("moved_at"), F.lit(None).cast("long").alias("replayed_to_job_id"))
    ex_status = ok.select("execution_id", F.when(F.col("outcome") == "unknown", "ABANDONED")
                          .otherwise("FAILED").alias("__es"), "__msg", "__kind")
    e = execs.join(ex_status, "execution_id")
    e = _set(e, status=F.col("__es"), finished_at=n, duration_ms=G.duration_ms(F.col("started_at"), n),
             error_kind=F.col("__kind")).drop("__es", "__msg", "__kind")
    outcomes = v.join(changed.select("job_id", F.col("__new").alias("new_status")), "job_id", "left")
    changed = changed.drop("__new", "__msg", "__kind", "outcome", "execution_id")
    return changed, e, dlq, outcomes, free_tokens(tokens, ok)


# B9 ---------------------------------------------------------------------------
def replay(dlq: DataFrame, queues: DataFrame, projects: DataFrame, now, skip_replayed: bool = True):
    """New QUEUED job per DLQ row (priority 5, 3 attempts, attempt 0) with lineage.
    Returns (new jobs, DLQ rows with replayed_to_job_id set, outbox)."""
    n = ts(now)
    src = dlq.filter(F.col("replayed_to_job_id").isNull()) if skip_replayed else dlq
    new_id = G.derived_id(F.lit("replay"), F.col("dlq_id"), F.lit(str(now)))
    jobs = src.select(
        new_id.alias("job_id"), "queue_id", F.lit(0).cast("long").alias("shard_id"),
        F.lit("immediate").alias("kind"), F.lit("QUEUED").alias("status"), "payload",
        F.lit(5).cast("long").alias("priority"), F.lit(0).cast("long").alias("attempt"),
        F.lit(3).cast("long").alias("max_attempts"), F.lit("exponential").alias("retry_strategy"),
        F.lit(5).cast("long").alias("base_delay_secs"), F.lit(3600).cast("long").alias("max_delay_secs"),
        F.col("dlq_id").alias("replayed_from_dlq_id"), F.col("job_id").alias("original_job_id"),
        n.alias("created_at"), n.alias("queued_at"), n.alias("updated_at"))
    marked = src.withColumn("replayed_to_job_id", new_id).withColumn("replayed_at", n)
    return jobs, marked, outbox_for(jobs, queues, projects, now, "replay")


# B10 --------------------------------------------------------------------------
def manual_retry(jobs: DataFrame, ids: DataFrame, queues: DataFrame, projects: DataFrame, now):
    """FAILED/RETRY_WAIT → QUEUED with attempt 0 and errors cleared; any other
    requested job is a conflict (UNKNOWN_EXTERNAL_RESULT included). Unknown ids
    are reported as ``not_found``. Returns (changed, outbox, conflicts)."""
    n = ts(now)
    want = ids.select("job_id").distinct()
    hit = jobs.join(want, "job_id", "left_semi")
    ok = hit.filter(F.col("status").isin("FAILED", "RETRY_WAIT"))
    changed = _set(ok, status=F.lit("QUEUED"), attempt=F.lit(0).cast("long"),
                   next_retry_at=F.lit(None).cast("timestamp_ntz"), error_message=F.lit(None).cast("string"),
                   error_kind=F.lit(None).cast("string"), lease_owner=F.lit(None).cast("long"),
                   lease_expires_at=F.lit(None).cast("timestamp_ntz"), queued_at=n, updated_at=n)
    conflicts = (hit.filter(~F.col("status").isin("FAILED", "RETRY_WAIT"))
                    .select("job_id", "status", F.lit("not_retryable").alias("reason"))
                    .unionByName(want.join(jobs.select("job_id"), "job_id", "left_anti")
                                 .select("job_id", F.lit(None).cast("string").alias("status"),
                                         F.lit("not_found").alias("reason"))))
    return changed, outbox_for(changed, queues, projects, now, "manual_retry"), conflicts


# B1 / B2 ----------------------------------------------------------------------
def _checked(requests: DataFrame, queues: DataFrame) -> DataFrame:
    """Requests with their queue's defaults, priority ``__prio`` and, where the queue is
    missing or the priority out of range, ``__reject``."""
    r = requests.join(queues.select("queue_id", "default_priority", "shard_count"), "queue_id", "left")
    asked = F.col("priority") if "priority" in requests.columns else F.lit(None).cast("long")
    r = r.withColumn("__prio", G.first_present(asked, F.col("default_priority")))
    return r.withColumn("__reject", F.when(F.col("default_priority").isNull(), "queue_not_found")
                        .when((F.col("__prio") < 0) | (F.col("__prio") > 100), "priority_out_of_range"))


def create_jobs(requests: DataFrame, queues: DataFrame, projects: DataFrame, now,
                request_id: str = "request_id", existing: DataFrame | None = None,
                arrivals: DataFrame | None = None, rate_limits: bool = False):
    """Job creation from request rows (request_id, queue_id, payload, priority,
    kind, job_type, header_key, body_key, max_attempts, retry_strategy,
    base_delay_secs, max_delay_secs, scheduled_for, batch_id; missing columns
    take defaults). Priority item > queue default; key header > body; status
    SCHEDULED when scheduled_for is set.

    Requests are taken in order of request id. Of those with one (queue, key) the first
    creates a job, unless a job of ``existing`` holds the key; the others are rejected as
    ``idempotency_conflict``. With ``rate_limits`` requests that find the queue's limit in
    its window used up (by ``arrivals(queue_id, event_ts)`` and the jobs created before
    them) are rejected as ``rate_limited``. Returns (jobs, outbox, rejects)."""
    n = ts(now)

    def col(name, dtype):
        return F.col(name) if name in requests.columns else F.lit(None).cast(dtype)

    key = G.first_present(col("header_key", "string"), col("body_key", "string"))
    r = in_order(_checked(requests, queues).withColumn("__key", key), request_id)
    valid = decide_jobs(r.filter(F.col("__reject").isNull()).drop("__reject"), request_id, existing,
                        room(queues, arrivals, now) if rate_limits else None)
    r = valid.unionByName(r.filter(F.col("__reject").isNotNull()))
    rejects = r.filter(F.col("__reject").isNotNull()).select(request_id, "queue_id", F.col("__reject").alias("reason"))
    ok = r.filter(F.col("__reject").isNull())
    routing = F.coalesce(F.col("__key"), F.concat(F.lit("req-"), F.col(request_id).cast("string")))
    status = F.when(col("scheduled_for", "timestamp_ntz").isNotNull(), "SCHEDULED").otherwise("QUEUED")
    jobs = ok.select(
        G.derived_id(F.lit("job"), F.col(request_id)).alias("job_id"), "queue_id",
        col("batch_id", "long").alias("batch_id"),
        G.shard_for_key(routing, F.col("shard_count")).alias("shard_id"),
        G.normalize_kind(col("kind", "string"), col("job_type", "string")).alias("kind"),
        status.alias("status"), col("payload", "string").alias("payload"), F.col("__prio").alias("priority"),
        F.lit(0).cast("long").alias("attempt"),
        F.coalesce(col("max_attempts", "long"), F.lit(3).cast("long")).alias("max_attempts"),
        G.normalize_strategy(col("retry_strategy", "string")).alias("retry_strategy"),
        F.coalesce(col("base_delay_secs", "long"), F.lit(5).cast("long")).alias("base_delay_secs"),
        F.coalesce(col("max_delay_secs", "long"), F.lit(3600).cast("long")).alias("max_delay_secs"),
        col("scheduled_for", "timestamp_ntz").alias("scheduled_for"),
        F.col("__key").alias("idempotency_key"), n.alias("created_at"),
        F.when(status == "QUEUED", n).alias("queued_at"), n.alias("updated_at"),
        F.col(request_id).alias(request_id))
    outbox = outbox_for(jobs.filter(F.col("status") == "QUEUED"), queues, projects, now, "create")
    return jobs, outbox, rejects


def create_batches(batch_requests: DataFrame, queues: DataFrame, projects: DataFrame, now,
                   items_col: str = "items", max_items: int = 1000, existing: DataFrame | None = None,
                   arrivals: DataFrame | None = None, rate_limits: bool = False):
    """Batch requests (batch_request_id, queue_id, items: array<struct(payload,
    priority, idempotency_key)>, optional request-level priority, max_attempts,
    retry_strategy) → 1..max_items jobs of kind ``batch`` per batch. Item
    priority falls back to the request's, then the queue default. A batch is
    all-or-nothing: an empty or oversized batch, or one with an invalid item, with a key
    that is held or repeated, or with more items than the rate limit leaves room for,
    creates nothing, holds no key, counts against no limit and is reported once. Batches
    are taken in order of their id. Returns (batches, jobs, outbox, rejects)."""
    size = F.size(items_col)
    bad = batch_requests.filter((size < 1) | (size > max_items))
    good = batch_requests.filter((size >= 1) & (size <= max_items))
    bid = G.derived_id(F.lit("batch"), F.col("batch_request_id"))
    req_level = [c for c in ("priority", "max_attempts", "retry_strategy") if c in batch_requests.columns]
    items = good.select(bid.alias("batch_id"), "batch_request_id", "queue_id",
                        *[F.col(c).alias(f"__req_{c}") for c in req_level],
                        F.posexplode(items_col).alias("position", "item"))
    fields = set(items.schema["item"].dataType.fieldNames())
    item_prio = F.col("item.priority").cast("long") if "priority" in fields else F.lit(None).cast("long")
    req_prio = F.col("__req_priority").cast("long") if "priority" in req_level else F.lit(None).cast("long")
    req = items.select(
        F.concat_ws("/", F.col("batch_request_id").cast("string"), F.col("position").cast("string")).alias("request_id"),
        "batch_request_id", "queue_id", "batch_id",
        (F.col("item.payload") if "payload" in fields else F.lit(None).cast("string")).alias("payload"),
        (F.col("item.idempotency_key") if "idempotency_key" in fields
         else F.lit(None).cast("string")).alias("body_key"),
        F.coalesce(item_prio, req_prio).alias("priority"), F.lit("batch").alias("kind"),
        *[F.col(f"__req_{c}").alias(c) for c in req_level if c != "priority"])
    keys = req.select("batch_request_id", "queue_id", F.col("body_key").alias("__key"))
    invalid = _checked(req, queues).filter(F.col("__reject").isNotNull()).groupBy("batch_request_id").agg(F.min("__reject").alias("reason"))
    valid = good.select("batch_request_id", "queue_id", size.cast("long").alias("__n")) \
        .join(invalid.select("batch_request_id"), "batch_request_id", "left_anti")
    failed = invalid
    if "idempotency_key" in fields or rate_limits:
        decided = decide_batches(valid, keys.join(valid.select("batch_request_id"), "batch_request_id", "left_semi"),
                                 "batch_request_id", existing, room(queues, arrivals, now) if rate_limits else None)
        failed = failed.unionByName(decided.filter(F.col("__reject").isNotNull())
                                    .select("batch_request_id", F.col("__reject").alias("reason")))
    failed = failed.withColumn("batch_id", G.derived_id(F.lit("batch"), F.col("batch_request_id")))
    jobs, outbox, _ = create_jobs(req.join(failed.select("batch_id"), "batch_id", "left_anti"), queues, projects, now)
    batches = (good.select(bid.alias("batch_id"), "queue_id", size.cast("long").alias("total_jobs"),
                           F.lit("QUEUED").alias("status"), ts(now).alias("created_at"))
                   .join(failed.select("batch_id"), "batch_id", "left_anti"))
    rejects = bad.select("batch_request_id", F.lit("batch_size").alias("reason"))
    return batches, jobs, outbox, rejects.unionByName(failed.select("batch_request_id", "reason"))
