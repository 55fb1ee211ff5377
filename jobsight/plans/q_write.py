"""Registered queries for the state transitions (B1–B10) and the maintenance tick (T8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import derived_id_sql
from ..operators import transitions as B
from ..sources.fixtures import JOBS_NOW, Ops, read, with_views
from .registry import register

NOW_SQL = f"TIMESTAMP '{JOBS_NOW}'"
_TIER = "CASE WHEN c.priority >= 10 THEN 'high' WHEN c.priority > 0 THEN 'standard' ELSE 'low' END"


def outbox_sql(changed: str, reason: str) -> str:
    """DuckDB text of ``transitions.outbox_for`` over a relation ``changed``."""
    eid = derived_id_sql("'outbox'", f"'{reason}'", "c.job_id", f"'{JOBS_NOW}'")
    return f"""SELECT {eid} AS event_id, c.job_id, c.queue_id, p.org_id, p.project_id,
  'org.' || CAST(p.org_id AS VARCHAR) || '.proj.' || CAST(p.project_id AS VARCHAR) || '.queue.' || CAST(c.queue_id AS VARCHAR)
    || CASE WHEN q.shard_count > 1 THEN '.shard.' || CAST(c.shard_id AS VARCHAR) ELSE '' END || '.' || {_TIER} AS subject,
  c.payload, c.priority, CAST({eid} AS VARCHAR) AS nats_msg_id, {NOW_SQL} AS created_at,
  CAST(NULL AS TIMESTAMP) AS published_at
FROM {changed} c JOIN queues q ON q.queue_id = c.queue_id JOIN projects p ON p.project_id = q.project_id"""


_CTX = ("jobs", "queues", "projects")
_DUE = {
    "scheduled": f"status = 'SCHEDULED' AND scheduled_for IS NOT NULL AND scheduled_for <= {NOW_SQL}",
    "retry": f"status = 'RETRY_WAIT' AND next_retry_at IS NOT NULL AND next_retry_at <= {NOW_SQL}",
    "stale": f"""status IN ('RUNNING', 'CLAIMED') AND lease_expires_at IS NOT NULL
                 AND lease_expires_at < {NOW_SQL} - INTERVAL 10 SECOND""",
    "aged": f"status = 'QUEUED' AND queued_at < {NOW_SQL} - INTERVAL 30 SECOND",
}


# B3 / B4 ----------------------------------------------------------------------
@register("b3_promote_outbox", with_views(outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['scheduled']})", "promote"), *_CTX))
def b3(spark, d):
    o = Ops(spark, d)
    return B.promote(o.jobs, o.queues, o.projects, JOBS_NOW)[1]


@register("b3_promote_jobs", with_views(f"""
SELECT job_id, 'QUEUED' AS status, {NOW_SQL} AS queued_at FROM jobs WHERE {_DUE['scheduled']}""", "jobs"))
def b3j(spark, d):
    o = Ops(spark, d)
    return B.promote(o.jobs, o.queues, o.projects, JOBS_NOW)[0].select("job_id", "status", "queued_at")


@register("b4_requeue_outbox", with_views(outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['retry']})", "requeue"), *_CTX))
def b4(spark, d):
    o = Ops(spark, d)
    return B.requeue(o.jobs, o.queues, o.projects, JOBS_NOW)[1]


# B5 ---------------------------------------------------------------------------
@register("b5_reclaim_jobs", with_views(f"""
SELECT job_id, 'QUEUED' AS status, CAST(NULL AS BIGINT) AS lease_owner, {NOW_SQL} AS queued_at FROM jobs
WHERE {_DUE['stale']}""", "jobs"))
def b5(spark, d):
    o = Ops(spark, d)
    ch, _, _, _ = B.reclaim(o.jobs, o.executions, o.capacity_tokens, o.queues, o.projects, JOBS_NOW)
    return ch.select("job_id", "status", "lease_owner", "queued_at")


@register("b5_reclaim_executions", with_views(f"""
SELECT execution_id, job_id, 'ABANDONED' AS status FROM executions WHERE status = 'STARTED'
  AND job_id IN (SELECT job_id FROM jobs WHERE {_DUE['stale']})""", "executions", "jobs"))
def b5e(spark, d):
    o = Ops(spark, d)
    _, ex, _, _ = B.reclaim(o.jobs, o.executions, o.capacity_tokens, o.queues, o.projects, JOBS_NOW)
    return ex.select("execution_id", "job_id", "status")


@register("b5_reclaim_tokens", with_views(f"""
SELECT queue_id, slot_index FROM capacity_tokens WHERE job_id IN (SELECT job_id FROM jobs WHERE {_DUE['stale']})""",
    "capacity_tokens", "jobs"))
def b5t(spark, d):
    o = Ops(spark, d)
    _, _, fr, _ = B.reclaim(o.jobs, o.executions, o.capacity_tokens, o.queues, o.projects, JOBS_NOW)
    return fr.select("queue_id", "slot_index")


@register("b5_reclaim_outbox", with_views(outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['stale']})", "reclaim"), *_CTX))
def b5o(spark, d):
    o = Ops(spark, d)
    return B.reclaim(o.jobs, o.executions, o.capacity_tokens, o.queues, o.projects, JOBS_NOW)[3]


# B6 ---------------------------------------------------------------------------
@register("b6_backfill_outbox", with_views(outbox_sql(f"""(SELECT * FROM jobs j WHERE {_DUE['aged']}
  AND NOT EXISTS (SELECT 1 FROM outbox_events e WHERE e.job_id = j.job_id))""", "backfill"), *_CTX, "outbox_events"))
def b6(spark, d):
    o = Ops(spark, d)
    return B.backfill_outbox(o.jobs, o.outbox_events, o.queues, o.projects, JOBS_NOW)


# B7 ---------------------------------------------------------------------------
def _starts(o):
    c = o.jobs.filter(F.col("status") == "CLAIMED")
    k = F.col("job_id")
    return c.select("job_id", F.col("lease_owner").alias("worker_id"),
                    F.when(k % 3 == 0, F.col("lease_epoch") + 5).otherwise(F.col("lease_epoch")).alias("epoch"))


@register("b7_start_jobs", with_views(f"""
SELECT job_id, 'RUNNING' AS status, {NOW_SQL} AS started_at FROM jobs WHERE status = 'CLAIMED' AND job_id % 3 <> 0""", "jobs"))
def b7s(spark, d):
    o = Ops(spark, d)
    return B.apply_starts(o.jobs, _starts(o), JOBS_NOW).select("job_id", "status", "started_at")


def _completions(o):
    r = o.jobs.filter(F.col("status") == "RUNNING")
    k = F.col("job_id")
    return r.select("job_id", F.col("lease_owner").alias("worker_id"),
                    F.when(k % 4 == 0, F.col("lease_epoch") - 1).otherwise(F.col("lease_epoch")).alias("epoch"),
                    (k * 100 + 1).alias("execution_id"),
                    F.concat(F.lit('{"ok":'), k.cast("string"), F.lit("}")).alias("result"))


@register("b7_complete_jobs", with_views(f"""
SELECT job_id, 'COMPLETED' AS status, '{{"ok":' || CAST(job_id AS VARCHAR) || '}}' AS result, {NOW_SQL} AS completed_at,
  CAST(NULL AS BIGINT) AS lease_owner FROM jobs WHERE status = 'RUNNING' AND job_id % 4 <> 0""", "jobs"))
def b7c(spark, d):
    o = Ops(spark, d)
    ch, _, _, _ = B.apply_completions(o.jobs, o.executions, o.capacity_tokens, _completions(o), JOBS_NOW)
    return ch.select("job_id", "status", "result", "completed_at", "lease_owner")


@register("b7_complete_executions", with_views(f"""
SELECT execution_id, job_id, 'COMPLETED' AS status,
  CAST(round((epoch_us({NOW_SQL}) - epoch_us(started_at)) / 1000.0) AS BIGINT) AS duration_ms
FROM executions WHERE execution_id IN (SELECT job_id * 100 + 1 FROM jobs WHERE status = 'RUNNING' AND job_id % 4 <> 0)""",
    "executions", "jobs"))
def b7e(spark, d):
    o = Ops(spark, d)
    _, ex, _, _ = B.apply_completions(o.jobs, o.executions, o.capacity_tokens, _completions(o), JOBS_NOW)
    return ex.select("execution_id", "job_id", "status", "duration_ms")


# B8 ---------------------------------------------------------------------------
def _failures(o):
    r = o.jobs.filter(F.col("status").isin("RUNNING", "CLAIMED"))
    k = F.col("job_id")
    return r.select("job_id", F.col("lease_owner").alias("worker_id"), F.col("lease_epoch").alias("epoch"),
                    (k * 100 + 1).alias("execution_id"),
                    F.element_at(F.array(F.lit("retry"), F.lit("permanent"), F.lit("unknown")),
                                 (k % 3 + 1).cast("int")).alias("outcome"),
                    F.concat(F.lit("boom "), k.cast("string")).alias("error_message"),
                    F.lit("handler_error").alias("error_kind"))


_FAIL_SQL = f"""(SELECT j.*, ['retry', 'permanent', 'unknown'][j.job_id % 3 + 1] AS outcome,
    CASE WHEN ['retry', 'permanent', 'unknown'][j.job_id % 3 + 1] = 'unknown' THEN 'UNKNOWN_EXTERNAL_RESULT'
         WHEN ['retry', 'permanent', 'unknown'][j.job_id % 3 + 1] = 'retry' AND j.attempt < j.max_attempts THEN 'RETRY_WAIT'
         ELSE 'FAILED' END AS new_status
  FROM jobs j WHERE j.status IN ('RUNNING', 'CLAIMED')
    AND NOT (['retry', 'permanent', 'unknown'][j.job_id % 3 + 1] = 'unknown' AND j.status <> 'RUNNING'))"""


@register("b8_fail_jobs", with_views(f"""
SELECT job_id, new_status AS status,
  CASE WHEN new_status = 'RETRY_WAIT' THEN {NOW_SQL} + to_seconds(CAST(floor(greatest(least(CASE WHEN retry_strategy = 'fixed'
    THEN 5.0 WHEN retry_strategy = 'linear' THEN 5.0 * greatest(attempt, 1) ELSE 5.0 * pow(2, least(greatest(attempt, 1) - 1, 62))
    END, 3600.0), 0.0)) AS BIGINT)) ELSE next_retry_at END AS next_retry_at,
  'boom ' || CAST(job_id AS VARCHAR) AS error_message, CASE WHEN new_status = 'FAILED' THEN {NOW_SQL} END AS failed_at
FROM {_FAIL_SQL} f""", "jobs"))
def b8(spark, d):
    o = Ops(spark, d)
    ch, *_ = B.apply_failures(o.jobs, o.executions, o.capacity_tokens, _failures(o), JOBS_NOW)
    return ch.select("job_id", "status", "next_retry_at", "error_message", "failed_at")


@register("b8_fail_dlq", with_views(f"""
SELECT {derived_id_sql("'dlq'", "job_id", "attempt")} AS dlq_id, job_id, queue_id,
  CASE WHEN outcome = 'permanent' THEN 'permanent_failure' ELSE 'max_attempts_exceeded' END AS reason,
  'handler_error' AS error_kind, attempt, 'boom ' || CAST(job_id AS VARCHAR) AS final_error, payload, {NOW_SQL} AS moved_at,
  CAST(NULL AS BIGINT) AS replayed_to_job_id
FROM {_FAIL_SQL} f WHERE new_status = 'FAILED'""", "jobs"))
def b8d(spark, d):
    o = Ops(spark, d)
    return B.apply_failures(o.jobs, o.executions, o.capacity_tokens, _failures(o), JOBS_NOW)[2]


@register("b8_fail_executions", with_views(f"""
SELECT e.execution_id, e.job_id, CASE WHEN f.outcome = 'unknown' THEN 'ABANDONED' ELSE 'FAILED' END AS status,
  'handler_error' AS error_kind FROM executions e JOIN {_FAIL_SQL} f ON e.execution_id = f.job_id * 100 + 1""",
    "executions", "jobs"))
def b8e(spark, d):
    o = Ops(spark, d)
    ex = B.apply_failures(o.jobs, o.executions, o.capacity_tokens, _failures(o), JOBS_NOW)[1]
    return ex.select("execution_id", "job_id", "status", "error_kind")


@register("b8_freed_tokens", with_views(f"""
SELECT t.queue_id, t.slot_index, t.epoch, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS TIMESTAMP) AS lease_until
FROM capacity_tokens t WHERE t.job_id IN (SELECT job_id FROM {_FAIL_SQL} f)""", "capacity_tokens", "jobs"))
def b8t(spark, d):
    o = Ops(spark, d)
    return B.apply_failures(o.jobs, o.executions, o.capacity_tokens, _failures(o), JOBS_NOW)[4].select(
        "queue_id", "slot_index", "epoch", "job_id", "lease_until")


@register("b8_outcomes", with_views(f"""
SELECT j.job_id, CASE WHEN j.job_id % 3 = 2 AND j.status <> 'RUNNING' THEN 'not_running' ELSE 'accepted' END AS verdict,
  f.new_status FROM jobs j LEFT JOIN {_FAIL_SQL} f ON f.job_id = j.job_id WHERE j.status IN ('RUNNING', 'CLAIMED')""", "jobs"))
def b8v(spark, d):
    o = Ops(spark, d)
    return B.apply_failures(o.jobs, o.executions, o.capacity_tokens, _failures(o), JOBS_NOW)[3].select(
        "job_id", "verdict", "new_status")


@register("b7_freed_tokens", with_views("""
SELECT queue_id, slot_index, CAST(NULL AS BIGINT) AS job_id FROM capacity_tokens
WHERE job_id IN (SELECT job_id FROM jobs WHERE status = 'RUNNING' AND job_id % 4 <> 0)""", "capacity_tokens", "jobs"))
def b7t(spark, d):
    o = Ops(spark, d)
    return B.apply_completions(o.jobs, o.executions, o.capacity_tokens, _completions(o), JOBS_NOW)[2].select(
        "queue_id", "slot_index", "job_id")


# B9 ---------------------------------------------------------------------------
_REPLAY_ID = derived_id_sql("'replay'", "dlq_id", f"'{JOBS_NOW}'")


@register("b9_replay_jobs", with_views(f"""
SELECT {_REPLAY_ID} AS job_id, queue_id, 'QUEUED' AS status, CAST(5 AS BIGINT) AS priority, CAST(3 AS BIGINT) AS max_attempts,
  CAST(0 AS BIGINT) AS attempt, dlq_id AS replayed_from_dlq_id, job_id AS original_job_id, payload
FROM dead_letter_entries WHERE replayed_to_job_id IS NULL""", "dead_letter_entries"))
def b9(spark, d):
    o = Ops(spark, d)
    jobs, _, _ = B.replay(o.dead_letter_entries, o.queues, o.projects, JOBS_NOW)
    return jobs.select("job_id", "queue_id", "status", "priority", "max_attempts", "attempt",
                       "replayed_from_dlq_id", "original_job_id", "payload")


@register("b9_replay_outbox", with_views(outbox_sql(f"""(SELECT {_REPLAY_ID} AS job_id, queue_id, CAST(0 AS BIGINT) AS shard_id,
  payload, CAST(5 AS BIGINT) AS priority FROM dead_letter_entries WHERE replayed_to_job_id IS NULL)""", "replay"),
    "dead_letter_entries", "queues", "projects"))
def b9o(spark, d):
    o = Ops(spark, d)
    return B.replay(o.dead_letter_entries, o.queues, o.projects, JOBS_NOW)[2]


@register("b9_replay_marks", with_views(f"""
SELECT dlq_id, {_REPLAY_ID} AS replayed_to_job_id, {NOW_SQL} AS replayed_at FROM dead_letter_entries
WHERE replayed_to_job_id IS NULL""", "dead_letter_entries"))
def b9m(spark, d):
    o = Ops(spark, d)
    return B.replay(o.dead_letter_entries, o.queues, o.projects, JOBS_NOW)[1].select(
        "dlq_id", "replayed_to_job_id", "replayed_at")


# B10 --------------------------------------------------------------------------
_RETRY_IDS = """(SELECT job_id FROM dead_letter_entries UNION SELECT replayed_to_job_id FROM dead_letter_entries
  WHERE replayed_to_job_id IS NOT NULL)"""


def _retry_ids(o):
    dl = o.dead_letter_entries
    return dl.select("job_id").unionByName(
        dl.filter(F.col("replayed_to_job_id").isNotNull()).select(F.col("replayed_to_job_id").alias("job_id")))


@register("b10_manual_retry_jobs", with_views(f"""
SELECT job_id, 'QUEUED' AS status, CAST(0 AS BIGINT) AS attempt, CAST(NULL AS VARCHAR) AS error_kind, {NOW_SQL} AS queued_at
FROM jobs WHERE status IN ('FAILED', 'RETRY_WAIT') AND job_id IN {_RETRY_IDS}""", "jobs", "dead_letter_entries"))
def b10(spark, d):
    o = Ops(spark, d)
    ch, _, _ = B.manual_retry(o.jobs, _retry_ids(o), o.queues, o.projects, JOBS_NOW)
    return ch.select("job_id", "status", "attempt", "error_kind", "queued_at")


@register("b10_manual_retry_conflicts", with_views(f"""
SELECT job_id, status, 'not_retryable' AS reason FROM jobs WHERE status NOT IN ('FAILED', 'RETRY_WAIT') AND job_id IN {_RETRY_IDS}
UNION ALL SELECT job_id, CAST(NULL AS VARCHAR), 'not_found' FROM {_RETRY_IDS} r WHERE job_id NOT IN (SELECT job_id FROM jobs)""",
    "jobs", "dead_letter_entries"))
def b10c(spark, d):
    o = Ops(spark, d)
    return B.manual_retry(o.jobs, _retry_ids(o), o.queues, o.projects, JOBS_NOW)[2]


@register("b10_manual_retry_outbox", with_views(outbox_sql(f"""(SELECT * FROM jobs WHERE status IN ('FAILED', 'RETRY_WAIT')
  AND job_id IN {_RETRY_IDS})""", "manual_retry"), *_CTX, "dead_letter_entries"))
def b10o(spark, d):
    o = Ops(spark, d)
    return B.manual_retry(o.jobs, _retry_ids(o), o.queues, o.projects, JOBS_NOW)[1]


# B1 / B2 ----------------------------------------------------------------------
def _requests(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda vals, i: F.element_at(F.array(*[F.lit(v) for v in vals]), (i + 1).cast("int"))
    return o.select(
        k.alias("request_id"), F.col("o_custkey").alias("queue_id"),
        F.concat(F.lit('{"type":"echo","n":'), k.cast("string"), F.lit("}")).alias("payload"),
        F.when(k % 4 != 0, k % 120).alias("priority"),
        pick(["", "delayed", "batch", "weird"], k % 4).alias("kind"),
        F.when(k % 5 == 0, F.concat(F.lit("h"), (k % 7).cast("string"))).alias("header_key"),
        F.when(k % 3 == 0, F.concat(F.lit("b"), (k % 11).cast("string"))).alias("body_key"),
        pick(["", "fixed", "linear", "bogus"], k % 4).alias("retry_strategy"),
        F.when(k % 6 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("scheduled_for"))


_REQ_SQL = """(SELECT o_orderkey AS request_id, o_custkey AS queue_id, '{"type":"echo","n":' || CAST(o_orderkey AS VARCHAR) || '}' AS payload,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 120 END AS priority, ['', 'delayed', 'batch', 'weird'][o_orderkey % 4 + 1] AS kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'h' || CAST(o_orderkey % 7 AS VARCHAR) END AS header_key,
  CASE WHEN o_orderkey % 3 = 0 THEN 'b' || CAST(o_orderkey % 11 AS VARCHAR) END AS body_key,
  ['', 'fixed', 'linear', 'bogus'][o_orderkey % 4 + 1] AS retry_strategy,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS scheduled_for FROM orders)"""

_CREATED_SQL = f"""(SELECT {derived_id_sql("'job'", "r.request_id")} AS job_id, r.queue_id, r.request_id,
  CASE WHEN r.scheduled_for IS NOT NULL THEN 'SCHEDULED' ELSE 'QUEUED' END AS status,
  coalesce(r.priority, q.default_priority) AS priority,
  CASE WHEN r.kind IN ('delayed', 'scheduled', 'recurring', 'batch') THEN r.kind ELSE 'immediate' END AS kind,
  coalesce(r.header_key, r.body_key) AS idempotency_key,
  CASE WHEN r.retry_strategy IN ('fixed', 'linear') THEN r.retry_strategy ELSE 'exponential' END AS retry_strategy,
  CAST(list_reduce(list_transform(range(octet_length(encode(rk))), lambda i: ('0x' || substr(hex(encode(rk)), 2 * i + 1, 2))::UHUGEINT),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)
    % CAST(greatest(q.shard_count, 1) AS UHUGEINT) AS BIGINT) AS shard_id, r.payload
  FROM (SELECT *, coalesce(header_key, body_key, 'req-' || CAST(request_id AS VARCHAR)) AS rk FROM {_REQ_SQL}) r
  JOIN queues q ON q.queue_id = r.queue_id
  WHERE coalesce(r.priority, q.default_priority) BETWEEN 0 AND 100
  QUALIFY coalesce(r.header_key, r.body_key) IS NULL
    OR row_number() OVER (PARTITION BY r.queue_id, coalesce(r.header_key, r.body_key) ORDER BY r.request_id) = 1)"""


@register("b1_created_jobs", with_views(f"""
SELECT job_id, queue_id, request_id, status, priority, kind, idempotency_key, retry_strategy, shard_id FROM {_CREATED_SQL} c""",
    "queues"))
def b1(spark, d):
    o = Ops(spark, d)
    jobs, _, _ = B.create_jobs(_requests(spark, d), o.queues, o.projects, JOBS_NOW)
    return jobs.select("job_id", "queue_id", "request_id", "status", "priority", "kind", "idempotency_key",
                       "retry_strategy", "shard_id")


@register("b1_create_outbox", with_views(outbox_sql(f"(SELECT * FROM {_CREATED_SQL} x WHERE status = 'QUEUED')", "create"),
                                         "queues", "projects"))
def b1o(spark, d):
    o = Ops(spark, d)
    return B.create_jobs(_requests(spark, d), o.queues, o.projects, JOBS_NOW)[1]


_REJECTS_SQL = f"""(SELECT r.request_id, r.queue_id, CASE WHEN q.queue_id IS NULL THEN 'queue_not_found' ELSE 'priority_out_of_range' END AS reason
FROM {_REQ_SQL} r LEFT JOIN queues q ON q.queue_id = r.queue_id
WHERE q.queue_id IS NULL OR NOT (coalesce(r.priority, q.default_priority) BETWEEN 0 AND 100))"""
_VALID_SQL = f"""(SELECT r.request_id, r.queue_id, coalesce(r.header_key, r.body_key) AS k, q.rate_limit FROM {_REQ_SQL} r
  JOIN queues q ON q.queue_id = r.queue_id WHERE coalesce(r.priority, q.default_priority) BETWEEN 0 AND 100)"""


@register("b1_create_conflicts", with_views(f"""
SELECT request_id, queue_id FROM (SELECT *, row_number() OVER (PARTITION BY queue_id, k ORDER BY request_id) AS rn
  FROM {_VALID_SQL} v WHERE k IS NOT NULL) x WHERE rn > 1 OR (queue_id, k) IN (SELECT queue_id, idempotency_key FROM held)
""".replace("held", "(SELECT o_custkey AS queue_id, 'h' || CAST(o_orderkey % 7 AS VARCHAR) AS idempotency_key FROM orders WHERE o_orderkey % 50 = 0) h"),
    "queues"))
def b1x(spark, d):
    """Conflicts with keys already held by other jobs and inside the requests."""
    o = Ops(spark, d)
    src = read(spark, d, "orders").filter("o_orderkey % 50 = 0")
    held = src.select(F.col("o_custkey").alias("queue_id"),
                      F.concat(F.lit("h"), (F.col("o_orderkey") % 7).cast("string")).alias("idempotency_key"))
    rej = B.create_jobs(_requests(spark, d), o.queues, o.projects, JOBS_NOW, existing=held)[2]
    return rej.filter("reason = 'idempotency_conflict'").select("request_id", "queue_id")


def _sequential_sql(valid: str) -> str:
    """Request by request over ``valid(request_id, queue_id, k, rate_limit)``: the number of
    jobs made and their keys travel along."""
    reason = """CASE WHEN made >= rate_limit THEN 'rate_limited' WHEN list_contains(keys, k) THEN 'idempotency_conflict' END"""
    return f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY request_id) AS rn FROM {valid} x),
step(queue_id, rn, request_id, reason, made, keys) AS (
  SELECT DISTINCT queue_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM v
  UNION ALL
  SELECT queue_id, rn, request_id, why, CASE WHEN why IS NULL THEN made + 1 ELSE made END,
    CASE WHEN why IS NULL AND k IS NOT NULL THEN list_append(keys, k) ELSE keys END
  FROM (SELECT v.*, s.made, s.keys, {reason} AS why FROM step s JOIN v ON v.queue_id = s.queue_id AND v.rn = s.rn + 1) n)
SELECT request_id, queue_id, reason FROM step WHERE rn > 0 AND reason IS NOT NULL"""


@register("b1_rate_limited", with_views(f"""
SELECT request_id, queue_id FROM ({_sequential_sql(_VALID_SQL)}) s WHERE reason = 'rate_limited'""", "queues"))
def b1l(spark, d):
    o = Ops(spark, d)
    rej = B.create_jobs(_requests(spark, d), o.queues, o.projects, JOBS_NOW, rate_limits=True)[2]
    return rej.filter("reason = 'rate_limited'").select("request_id", "queue_id")


_TIGHT_SQL = """(SELECT o_orderkey AS request_id, o_custkey AS queue_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'k' || CAST(o_orderkey % 3 AS VARCHAR) END AS k,
  CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 4 + 1 AS BIGINT) END AS rate_limit FROM orders WHERE o_custkey IN (SELECT queue_id FROM queues))"""


@register("b1_limits_with_conflicts", with_views(_sequential_sql(_TIGHT_SQL), "queues"))
def b1t(spark, d):
    """Few keys and low limits: a conflict creates nothing, so it leaves room for another."""
    o = Ops(spark, d)
    k = F.col("o_orderkey")
    reqs = read(spark, d, "orders").select(
        k.alias("request_id"), F.col("o_custkey").alias("queue_id"), F.lit(1).cast("long").alias("priority"),
        F.when(k % 5 != 0, F.concat(F.lit("k"), (k % 3).cast("string"))).alias("body_key"))
    c = F.col("queue_id")
    tight = o.queues.withColumn("rate_limit", F.when(c % 4 != 0, c % 4 + 1))
    rej = B.create_jobs(reqs, tight, o.projects, JOBS_NOW, rate_limits=True)[2]
    return rej.filter("reason <> 'queue_not_found'").select("request_id", "queue_id", "reason")


@register("b1_create_rejects", with_views(f"""
SELECT * FROM {_REJECTS_SQL} a UNION ALL
SELECT request_id, queue_id, 'idempotency_conflict' FROM (SELECT *, row_number() OVER (PARTITION BY queue_id, k ORDER BY request_id) AS rn
  FROM {_VALID_SQL} v WHERE k IS NOT NULL) x WHERE rn > 1""", "queues"))
def b1r(spark, d):
    o = Ops(spark, d)
    return B.create_jobs(_requests(spark, d), o.queues, o.projects, JOBS_NOW)[2]


def _batch_requests(spark, d):
    o = read(spark, d, "orders")
    item = F.struct(F.col("o_orderkey").alias("k"),
                    F.concat(F.lit('{"type":"echo","n":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
                    ((F.col("o_orderkey") % 7) * 10).alias("priority"), F.lit("batch").alias("kind"))
    return (o.groupBy(F.expr("o_orderkey div 20").alias("batch_request_id"))  # 20 items per request
             .agg(F.min_by("o_custkey", "o_orderkey").alias("queue_id"),
                  F.sort_array(F.collect_list(item)).alias("items")))


_BATCH_ID = derived_id_sql("'batch'", "o_orderkey // 20")


@register("b2_batches", with_views(f"""
SELECT {_BATCH_ID} AS batch_id, arg_min(o_custkey, o_orderkey) AS queue_id, count(*) AS total_jobs, 'QUEUED' AS status
FROM orders GROUP BY o_orderkey // 20""", "queues"))
def b2(spark, d):
    o = Ops(spark, d)
    batches, _, _, _ = B.create_batches(_batch_requests(spark, d), o.queues, o.projects, JOBS_NOW)
    return batches.select("batch_id", "queue_id", "total_jobs", "status")


@register("b2_batch_jobs", with_views(f"""
SELECT {derived_id_sql("'job'", "CAST(b AS VARCHAR) || '/' || CAST(pos AS VARCHAR)")} AS job_id, {_BATCH_ID} AS batch_id,
  queue_id, (o_orderkey % 7) * 10 AS priority, 'batch' AS kind, 'QUEUED' AS status
FROM (SELECT o_orderkey, o_orderkey // 20 AS b, arg_min(o_custkey, o_orderkey) OVER (PARTITION BY o_orderkey // 20) AS queue_id,
  row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS pos FROM orders) x
WHERE queue_id IN (SELECT queue_id FROM queues)""", "queues"))
def b2j(spark, d):
    o = Ops(spark, d)
    _, jobs, _, _ = B.create_batches(_batch_requests(spark, d), o.queues, o.projects, JOBS_NOW)
    return jobs.select("job_id", "batch_id", "queue_id", "priority", "kind", "status")


_KEYED_ITEMS_SQL = """(SELECT o_orderkey // 4 AS b, CAST(1 + (o_orderkey // 4) % 20 AS BIGINT) AS queue_id, o_orderkey,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'k' || CAST(o_orderkey * 7 % 101 AS VARCHAR) END AS k FROM orders)"""


@register("b2_keyed_rejects", with_views(f"""
WITH RECURSIVE bs AS (SELECT b, i.queue_id, count(*) AS n, list(k) FILTER (k IS NOT NULL) AS ks, any_value(lim) AS lim,
    row_number() OVER (PARTITION BY i.queue_id ORDER BY b) AS rn FROM {_KEYED_ITEMS_SQL} i
    JOIN (SELECT queue_id, CASE WHEN queue_id % 3 <> 0 THEN 40 + queue_id END AS lim FROM queues) q ON q.queue_id = i.queue_id
    GROUP BY b, i.queue_id),
step(queue_id, rn, b, reason, made, keys) AS (
  SELECT DISTINCT queue_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS HUGEINT), CAST([] AS VARCHAR[]) FROM bs
  UNION ALL
  SELECT queue_id, rn, b, why, CASE WHEN why IS NULL THEN made + n ELSE made END, CASE WHEN why IS NULL THEN list_concat(keys, coalesce(ks, [])) ELSE keys END
  FROM (SELECT bs.*, s.made, s.keys, CASE WHEN s.made + n > lim THEN 'rate_limited'
      WHEN len(list_distinct(ks)) < len(ks) OR list_has_any(s.keys, coalesce(ks, [])) THEN 'idempotency_conflict' END AS why
    FROM step s JOIN bs ON bs.queue_id = s.queue_id AND bs.rn = s.rn + 1) m)
SELECT b AS batch_request_id, reason FROM step WHERE rn > 0 AND reason IS NOT NULL""", "queues"))
def b2k(spark, d):
    """Batches that share keys: only accepted ones hold them, and only they fill the limit."""
    o = Ops(spark, d)
    k = F.col("o_orderkey")
    b = F.expr("o_orderkey div 4")
    item = F.struct(k.alias("k"), F.lit("{}").alias("payload"), F.lit(1).cast("long").alias("priority"),
                    F.when(k % 3 != 0, F.concat(F.lit("k"), (k * 7 % 101).cast("string"))).alias("idempotency_key"))
    reqs = read(spark, d, "orders").groupBy(b.alias("batch_request_id")).agg(F.sort_array(F.collect_list(item)).alias("items")) \
        .withColumn("queue_id", 1 + F.col("batch_request_id") % 20)
    c = F.col("queue_id")
    tight = o.queues.withColumn("rate_limit", F.when(c % 3 != 0, 40 + c))
    return B.create_batches(reqs, tight, o.projects, JOBS_NOW, rate_limits=True)[3]
