"""Registered queries for streaming operators (T1–T8), sinks (S4, S5), exact
admission (T4) and handlers (X1). Streaming queries run with an availableNow
trigger over the supplied files and return the sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import handlers as X
from ..operators.admission import admit
from ..schema import DECLARED_TRANSITIONS
from ..session import checkpoint_dir
from ..sources.fixtures import EVENTS_NOW, JOBS_NOW, Ops, build, with_views
from ..streaming import operators as T
from ..streaming.runner import append_events, arrivals_stream, publish_once, published, run_to_table
from ..functions.columns import derived_id_sql
from .registry import register
from .tick import run_tick
from .q_write import outbox_sql, _DUE


@register("t1_dedup_messages", with_views("SELECT DISTINCT msg_id, header_job_id, body FROM messages", "messages"))
def t1(spark, d):
    s = build(spark, d, "messages", stream=True)
    return run_to_table(T.dedup_messages(s), "t1").select("msg_id", "header_job_id", "body")


@register("t2_status_snapshot", with_views("""
SELECT status, count(*) AS n FROM (SELECT job_id, arg_max(status, (event_ts, event_id)) AS status FROM status_events
  GROUP BY job_id) x GROUP BY status""", "status_events"))
def t2(spark, d):
    return run_to_table(T.snapshot_stream(_status_stream(spark, d)), "t2", mode="complete")


def _status_stream(spark, d):
    """status events as a stream over the events file; the lease epoch rises with the
    event id, and every 13th event carries the epoch before."""
    from ..streaming.runner import stream_table
    ev = stream_table(spark, d, "events")
    et, k = F.col("event_type"), F.col("event_id")
    st = (F.when(et == "signup", "QUEUED").when(et == "view", "CLAIMED").when(et == "click", "RUNNING")
           .when(et == "purchase", "COMPLETED").otherwise("FAILED"))
    epoch = F.floor(k / 500) - F.when(k % 13 == 0, 1).otherwise(0)
    return ev.select("event_id", F.col("user_id").alias("job_id"), st.alias("status"),
                     F.col("ts").alias("event_ts"), epoch.cast("long").alias("epoch"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in DECLARED_TRANSITIONS)
_LIFECYCLE_SQL = f"""
WITH RECURSIVE ev AS (SELECT event_id, user_id AS job_id, epoch_us(ts) AS t,
    CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'CLAIMED' WHEN 'click' THEN 'RUNNING'
         WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
    event_id // 500 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS epoch,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
step(job_id, rn, event_id, from_status, status, epoch, verdict, cur, ep) AS (
  SELECT job_id, rn, event_id, CAST(NULL AS VARCHAR), status, epoch, v,
    CASE WHEN v = 'accepted' THEN status END, CASE WHEN v = 'accepted' THEN greatest(epoch, -1) ELSE -1 END
  FROM (SELECT *, CASE WHEN epoch < -1 THEN 'stale_epoch' WHEN status IN ('QUEUED', 'SCHEDULED', 'WAITING') THEN 'accepted'
        ELSE 'invalid_transition' END AS v FROM ev WHERE rn = 1) b
  UNION ALL
  SELECT job_id, rn, event_id, cur, status, epoch, v, CASE WHEN v = 'accepted' THEN status ELSE cur END,
    CASE WHEN v = 'accepted' THEN greatest(ep, epoch) ELSE ep END
  FROM (SELECT e.*, s.cur, s.ep, CASE WHEN e.epoch < s.ep THEN 'stale_epoch'
        WHEN (s.cur IS NULL AND e.status IN ('QUEUED', 'SCHEDULED', 'WAITING'))
          OR (s.cur || '>' || e.status) IN (SELECT a || '>' || b FROM (VALUES {_PAIRS}) p(a, b)) THEN 'accepted'
        ELSE 'invalid_transition' END AS v FROM step s JOIN ev e ON e.job_id = s.job_id AND e.rn = s.rn + 1) n)
SELECT event_id, job_id, from_status, status, epoch, verdict FROM step"""


def _admission_sql(arrivals: str, limit: str, window: str) -> str:
    """Decision by decision: the last ``limit`` accepted times travel along."""
    return f"""
WITH RECURSIVE arr AS (SELECT arrival_id, queue_id, event_ts, epoch_us(event_ts) AS t, {limit} AS lim,
    CAST({window} AS BIGINT) * 1000000 AS w, row_number() OVER (PARTITION BY queue_id ORDER BY event_ts, arrival_id) AS rn FROM ({arrivals}) a),
step(queue_id, rn, arrival_id, event_ts, accepted, times) AS (
  SELECT queue_id, rn, arrival_id, event_ts, coalesce(lim > 0, true), CASE WHEN coalesce(lim > 0, true) THEN [t] ELSE [] END
  FROM arr WHERE rn = 1
  UNION ALL
  SELECT queue_id, rn, arrival_id, event_ts, ok,
    CASE WHEN NOT ok OR lim IS NULL THEN times WHEN len(times) < lim THEN list_append(times, t) ELSE list_append(times[2:], t) END
  FROM (SELECT a.*, s.times, a.lim IS NULL OR (a.lim > 0 AND (len(s.times) < a.lim OR a.t > s.times[1] + a.w)) AS ok
        FROM step s JOIN arr a ON a.queue_id = s.queue_id AND a.rn = s.rn + 1) n)
SELECT arrival_id, queue_id, event_ts, accepted FROM step"""


@register("t3_liveness_sessions", with_views("""
SELECT worker_id, min(heartbeat_at) AS session_start, max(heartbeat_at) + INTERVAL 1 HOUR AS session_end, count(*) AS beats
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR heartbeat_at - prev >= INTERVAL 1 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY worker_id ORDER BY heartbeat_at, heartbeat_id) AS sid
      FROM (SELECT *, lag(heartbeat_at) OVER (PARTITION BY worker_id ORDER BY heartbeat_at, heartbeat_id) AS prev
            FROM worker_heartbeats) a) b
GROUP BY worker_id, sid""", "worker_heartbeats"))
def t3(spark, d):
    hb = build(spark, d, "worker_heartbeats", stream=True)
    return run_to_table(T.liveness_sessions(hb, "1 hour"), "t3", mode="complete")


def _edges_sql(now: str) -> str:
    return f"""
SELECT worker_id, heartbeat_at + INTERVAL 3600 SECOND AS edge_at, 'ONLINE' AS from_status, 'STALE' AS to_status
  FROM (SELECT *, lead(heartbeat_at) OVER (PARTITION BY worker_id ORDER BY heartbeat_at, heartbeat_id) AS nxt FROM worker_heartbeats) x
  WHERE coalesce(nxt, {now}) > heartbeat_at + INTERVAL 3600 SECOND
UNION ALL
SELECT worker_id, heartbeat_at + INTERVAL 43200 SECOND, 'STALE', 'OFFLINE'
  FROM (SELECT *, lead(heartbeat_at) OVER (PARTITION BY worker_id ORDER BY heartbeat_at, heartbeat_id) AS nxt FROM worker_heartbeats) x
  WHERE coalesce(nxt, {now}) > heartbeat_at + INTERVAL 43200 SECOND
UNION ALL
SELECT worker_id, heartbeat_at, CASE WHEN heartbeat_at - prev > INTERVAL 43200 SECOND THEN 'OFFLINE' ELSE 'STALE' END, 'ONLINE'
  FROM (SELECT *, lag(heartbeat_at) OVER (PARTITION BY worker_id ORDER BY heartbeat_at, heartbeat_id) AS prev FROM worker_heartbeats) x
  WHERE heartbeat_at - prev > INTERVAL 3600 SECOND"""


@register("t3_liveness_edges", with_views(_edges_sql(f"TIMESTAMP '{EVENTS_NOW}'"), "worker_heartbeats"))
def t3e(spark, d):
    from ..streaming.liveness import liveness_edges
    return liveness_edges(Ops(spark, d).worker_heartbeats, EVENTS_NOW, 3600, 43200)


_T4_SQL = _admission_sql("SELECT event_id AS arrival_id, event_type AS queue_id, ts AS event_ts FROM events", "3", "3600")


@register("t4_admission_batch", _T4_SQL)
def t4(spark, d):
    return admit(Ops(spark, d).arrivals, limit=3, window_secs=3600)


@register("t4_admission_stream", _T4_SQL)
def t4s(spark, d):
    a = build(spark, d, "arrivals", stream=True)
    out = run_to_table(T.admit_stream(a, 3, 3600), "t4")
    return out.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@register("t5_lifecycle_stream", _LIFECYCLE_SQL)
def t5(spark, d):
    ev = _status_stream(spark, d)
    return run_to_table(T.lifecycle_stream(ev), "t5")


def _lease_sql(now: str) -> str:
    return f"""SELECT l.job_id, l.worker_id, l.event_id, l.event_ts + INTERVAL 30 SECOND AS expired_at FROM (
  SELECT job_id, ep, arg_max(worker_id, (event_ts, event_id)) AS worker_id, arg_max(event_id, (event_ts, event_id)) AS event_id,
    max(event_ts) AS event_ts FROM (
    SELECT *, max(CASE WHEN event_ts > prev + INTERVAL 40 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, ep
        ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM (
      SELECT e.*, lag(event_ts) OVER (PARTITION BY e.job_id, e.ep ORDER BY event_ts, event_id) AS prev
      FROM episodes e JOIN (SELECT job_id, ep, worker_id AS holder FROM episodes WHERE kind = 'claim') c
        ON c.job_id = e.job_id AND c.ep = e.ep WHERE e.kind = 'claim' OR e.worker_id = c.holder) p) b
  WHERE broken = 0 GROUP BY job_id, ep) l
LEFT JOIN (SELECT job_id, ep - 1 AS ep, event_ts AS ended FROM episodes WHERE kind <> 'renew') n ON n.job_id = l.job_id AND n.ep = l.ep
WHERE coalesce(ended, {now}) > l.event_ts + INTERVAL 40 SECOND"""


_EPISODES = """WITH episodes AS (SELECT *, sum(CASE WHEN kind <> 'renew' THEN 1 ELSE 0 END)
  OVER (PARTITION BY job_id ORDER BY event_ts, event_id) AS ep FROM lease_events)
"""


@register("t6_lease_expiries", with_views(_EPISODES + _lease_sql(f"TIMESTAMP '{EVENTS_NOW}'"), "lease_events"))
def t6(spark, d):
    from ..streaming.liveness import lease_expiries
    return lease_expiries(Ops(spark, d).lease_events, EVENTS_NOW, 30, 10)


@register("t6_lease_stream", with_views(_EPISODES + "SELECT job_id, worker_id, expired_at FROM ("
                                        + _lease_sql("(SELECT max(event_ts) FROM lease_events)") + ") s", "lease_events"))
def t6s(spark, d):
    ev = build(spark, d, "lease_events", stream=True)
    out = run_to_table(T.lease_stream(ev), "t6")
    return out.withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))


@register("t7_dag_stream", with_views("""
SELECT e.child_id, CAST(count(DISTINCT e.parent_id) AS BIGINT) AS parents FROM workflow_edges e
  LEFT JOIN jobs p ON p.job_id = e.parent_id AND p.status = 'COMPLETED'
GROUP BY e.child_id HAVING count(DISTINCT e.parent_id) = count(DISTINCT p.job_id)""", "workflow_edges", "jobs"))
def t7(spark, d):
    completions = build(spark, d, "jobs", stream=True).filter(F.col("status") == "COMPLETED")
    return run_to_table(T.dag_stream(completions, Ops(spark, d).workflow_edges), "t7")


_CRON_JOB_ID = derived_id_sql("'cron'", "schedule_id", "CAST(next_fire_at AS VARCHAR)")
_CRON_DUE = f"scheduled_jobs WHERE is_active AND next_fire_at <= TIMESTAMP '{JOBS_NOW}'"


@register("t8_tick_occurrences", with_views(f"""
SELECT schedule_id, next_fire_at AS fire_time, queue_id IN (SELECT queue_id FROM queues) AS created
FROM {_CRON_DUE}""", "scheduled_jobs", "queues"))
def t8c(spark, d):
    return run_tick(Ops(spark, d), JOBS_NOW)["occurrences"].select(
        "schedule_id", "fire_time", F.col("created_job_id").isNotNull().alias("created"))


@register("t8_tick_tokens", with_views(f"""
SELECT queue_id, slot_index, epoch FROM capacity_tokens WHERE job_id IN (SELECT job_id FROM jobs WHERE {_DUE['stale']})""",
    "capacity_tokens", "jobs"))
def t8t(spark, d):
    return run_tick(Ops(spark, d), JOBS_NOW)["freed_tokens"].select("queue_id", "slot_index", "epoch")


@register("t8_tick_outbox", with_views("\nUNION ALL\n".join([
    outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['stale']})", "reclaim").replace("SELECT ", "SELECT 'reclaim' AS source, ", 1),
    outbox_sql(f"""(SELECT * FROM jobs j WHERE {_DUE['aged']}
      AND NOT EXISTS (SELECT 1 FROM outbox_events e WHERE e.job_id = j.job_id))""", "backfill")
    .replace("SELECT ", "SELECT 'backfill' AS source, ", 1),
    outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['scheduled']})", "promote").replace("SELECT ", "SELECT 'promote' AS source, ", 1),
    outbox_sql(f"(SELECT * FROM jobs WHERE {_DUE['retry']})", "requeue").replace("SELECT ", "SELECT 'requeue' AS source, ", 1),
    outbox_sql(f"(SELECT {_CRON_JOB_ID} AS job_id, queue_id, CAST(0 AS BIGINT) AS shard_id, payload, priority FROM {_CRON_DUE})",
               "cron").replace("SELECT ", "SELECT 'cron' AS source, ", 1),
]), "jobs", "queues", "projects", "outbox_events", "scheduled_jobs"))
def t8(spark, d):
    return run_tick(Ops(spark, d), JOBS_NOW)["outbox"]


@register("x1_handlers", with_views("""
SELECT job_id, t AS type,
  CASE t WHEN 'echo' THEN 'ok' WHEN 'sleep' THEN 'ok' WHEN 'always_fail' THEN 'retry'
    WHEN 'external_payment' THEN CASE WHEN fu OR attempt = 1 THEN 'unknown' ELSE 'ok' END ELSE 'permanent' END AS outcome,
  CASE t WHEN 'echo' THEN '{"attempt":' || CAST(attempt AS VARCHAR) || ',"echoed":true}'
    WHEN 'sleep' THEN '{"slept_secs":' || CAST(secs AS VARCHAR) || '}'
    WHEN 'external_payment' THEN CASE WHEN fu OR attempt = 1 THEN NULL
      ELSE '{"idempotency":' || CAST(job_id AS VARCHAR) || ',"payment":"confirmed"}' END END AS result,
  CASE t WHEN 'echo' THEN NULL WHEN 'sleep' THEN NULL WHEN 'always_fail' THEN 'intentional test failure'
    WHEN 'external_payment' THEN CASE WHEN fu OR attempt = 1
      THEN 'payment request sent but response timeout - unknown if succeeded' END
    ELSE format('no handler registered for job type ''{}''', t) END AS error_message,
  CASE t WHEN 'echo' THEN NULL WHEN 'sleep' THEN NULL WHEN 'always_fail' THEN 'test_failure'
    WHEN 'external_payment' THEN CASE WHEN fu OR attempt = 1 THEN 'external_timeout' END ELSE 'no_handler' END AS error_kind
FROM (SELECT *, coalesce(json_extract_string(payload, '$.type'), 'echo') AS t,
  coalesce(TRY_CAST(json_extract_string(payload, '$.secs') AS BIGINT), 1) AS secs,
  coalesce(TRY_CAST(json_extract_string(payload, '$.force_unknown') AS BOOLEAN), false) AS fu FROM jobs) j""", "jobs"))
def x1(spark, d):
    return X.apply_handlers(Ops(spark, d).jobs)


@register("s4_publish_once", with_views("SELECT DISTINCT msg_id, header_job_id, body FROM messages", "messages"))
def s4(spark, d):
    import uuid
    target = f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    msgs = Ops(spark, d).messages
    publish_once(msgs, target)
    publish_once(msgs, target)  # a redelivered batch appends nothing
    return published(spark, target, msgs).select("msg_id", "header_job_id", "body")


@register("s5_append_events", with_views("""
SELECT CAST(CAST(heartbeat_at AS DATE) AS VARCHAR) AS event_date, count(*) AS n FROM worker_heartbeats GROUP BY ALL""", "worker_heartbeats"))
def s5(spark, d):
    import uuid
    path = f"{checkpoint_dir(spark)}/heartbeats-{uuid.uuid4().hex}"
    append_events(Ops(spark, d).worker_heartbeats, path, "heartbeat_at")
    return (spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"))
                 .agg(F.count(F.lit(1)).alias("n")))


@register("t4_admission_queues", with_views(_admission_sql(
    "SELECT job_id AS arrival_id, CAST(j.queue_id AS VARCHAR) AS queue_id, created_at AS event_ts, rate_limit, rate_window_secs "
    "FROM jobs j JOIN queues q ON q.queue_id = j.queue_id", "rate_limit", "rate_window_secs"), "jobs", "queues"))
def t4q(spark, d):
    o = Ops(spark, d)
    arr = o.jobs.select(F.col("job_id").alias("arrival_id"), "queue_id", F.col("created_at").alias("event_ts"))
    return admit(arr, queues=o.queues)


@register("t3_liveness_stream", with_views(_edges_sql("(SELECT max(heartbeat_at) FROM worker_heartbeats)"), "worker_heartbeats"))
def t3s(spark, d):
    hb = build(spark, d, "worker_heartbeats", stream=True)
    out = run_to_table(T.liveness_stream(hb, 3600, 43200), "t3-edges")
    return out.withColumn("edge_at", F.col("edge_at").cast("timestamp_ntz"))


@register("t2_project_snapshot_stream", with_views("""
SELECT q.project_id, j.status, count(*) AS n FROM jobs j JOIN queues q ON q.queue_id = j.queue_id
  JOIN projects p ON p.project_id = q.project_id GROUP BY ALL""", "jobs", "queues", "projects"))
def t2p(spark, d):
    """Per-project status snapshot from a job stream joined to the static tenant
    tables (stream-static join), latest status per job held in state."""
    from ..operators.joins import with_context
    o = Ops(spark, d)
    jobs = build(spark, d, "jobs", stream=True).select(
        "job_id", "queue_id", "status", F.col("updated_at").alias("event_ts"), F.col("job_id").alias("event_id"))
    ctx = with_context(jobs, o.queues, o.projects)
    return run_to_table(T.snapshot_stream(ctx, scope="project_id"), "t2p", mode="complete")


@register("s2_arrivals", with_views("SELECT msg_id, header_job_id, body FROM messages", "messages"))
def s2(spark, d):
    """Messages dropped as files into a folder, picked up a few files a trigger."""
    import uuid
    path = f"{checkpoint_dir(spark)}/inbox-{uuid.uuid4().hex}"
    sent = Ops(spark, d).messages.select("msg_id", "header_job_id", "body")
    sent.write.parquet(path)
    return run_to_table(arrivals_stream(spark, path, sent.schema, max_files=4), "s2")
