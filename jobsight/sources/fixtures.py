"""Job-operations views derived from the supplied star-schema tables.

The hierarchy region → nation → customer → orders → lineitem has the shape
organization → project → queue → job → execution. Each view exists twice: as a
lazy Spark DataFrame (``build(spark, dir, name)``) and as DuckDB SQL text
(``VIEW_SQL``) used by the independent oracle. Integer arithmetic only, so both
engines agree; every integer column is BIGINT.
"""

from __future__ import annotations

import contextvars

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOB_STATUSES, MEMBER_ROLES, RETRY_STRATEGIES, DLQ_REASONS
from ..session import secs, ts

# ---- fixed values of the fixture (our own choices) ------------------------------
JOBS_NOW = "1998-06-01 00:00:00"       # 'now' for the jobs tables
EVENTS_NOW = "2024-01-31 00:00:00"     # 'now' for the event-derived tables
ERROR_KINDS = ["timeout", "http_5xx", "panic", "oom", "bad_payload", "no_handler", "network"]
PAYLOAD_TYPES = ["echo", "sleep", "always_fail", "external_payment", "resize_image"]
FIXTURE_CRONS = ["0 0 * * * *", "0 */15 * * * *", "0 30 9 * * *", "0 0 0 1 * *", "not a cron"]
FIXTURE_ZONES = ["UTC", "Asia/Kolkata", "America/New_York", "Mars/Olympus"]
# -------------------------------------------------------------------------------

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


_STREAM = contextvars.ContextVar("jobsight_stream_views", default=False)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A supplied table: batch scan, or a file stream while building stream views."""
    if _STREAM.get():
        from ..streaming.runner import stream_table
        return stream_table(spark, d, name)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] with a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _L(x) -> Column:
    return F.lit(x).cast("long")


# ------------------------------------------------------------------ Spark views
def _organizations(spark, d):
    r = read(spark, d, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("org_id"), F.col("r_name").alias("name"))


def _projects(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("project_id"),
                    F.col("n_regionkey").cast("long").alias("org_id"),
                    F.col("n_name").alias("name"),
                    ((F.col("n_nationkey") % 10) == 9).alias("is_archived"))


def _queues(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("queue_id"), F.col("c_nationkey").cast("long").alias("project_id"),
        F.col("c_name").alias("name"), (k % 8 + 1).alias("max_concurrency"),
        ((k % 11) == 0).alias("is_paused"),
        F.when(k % 3 == 0, _L(3)).alias("rate_limit"), _L(3600).alias("rate_window_secs"),
        (k % 4 + 1).alias("shard_count"), _L(5).alias("default_priority"),
        _L(60).alias("ack_wait_secs"), _L(3).alias("max_receives"))


def _users(spark, d):
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("user_id"),
                    F.concat(F.lower(F.regexp_replace("s_name", "#", "")), F.lit("@example.com")).alias("email"),
                    F.col("s_name").alias("name"),
                    ((F.col("s_suppkey") % 7) != 0).alias("is_active"))


def _org_memberships(spark, d):
    s = read(spark, d, "supplier")
    n = read(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").cast("long").alias("org_id"), F.col("s_suppkey").alias("user_id"),
        _pick(MEMBER_ROLES, F.col("s_suppkey") % 4).alias("role"))


def _project_memberships(spark, d):
    s = read(spark, d, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("project_id"),
                    F.col("s_suppkey").alias("user_id"),
                    _pick(MEMBER_ROLES, (F.col("s_suppkey") + 1) % 4).alias("role"))


def _payload(k: Column) -> Column:
    return F.concat(
        F.lit('{"type":"'), _pick(PAYLOAD_TYPES, k % 5), F.lit('"'),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(',"secs":'), (k % 6).cast("string"))),
        F.when(k % 8 == 3, F.lit(',"force_unknown":true')).otherwise(F.lit("")),
        F.lit("}"))


def _jobs(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        k.alias("job_id"), F.col("o_custkey").alias("queue_id"),
        F.expr("o_orderkey div 20").alias("batch_id"), F.col("o_custkey").alias("workflow_id"),
        (k % 4).alias("shard_id"), _pick(JOB_STATUSES, k % 10).alias("status"),
        _payload(k).alias("payload"),
        ((5 - F.substring("o_orderpriority", 1, 1).cast("long")) * 5).alias("priority"),
        (k % 4).alias("attempt"), _L(3).alias("max_attempts"),
        _pick(RETRY_STRATEGIES, k % 3).alias("retry_strategy"),
        _L(5).alias("base_delay_secs"), _L(3600).alias("max_delay_secs"),
        (F.col("o_orderdate") + secs(k % 86400)).alias("created_at"),
        _pick(ERROR_KINDS, k % 7).alias("ek"))
    j = F.col("job_id")
    st = F.col("status")
    leased = st.isin("CLAIMED", "RUNNING")
    failed = st.isin("FAILED", "RETRY_WAIT")
    return base.select(
        "job_id", "queue_id", "batch_id", "workflow_id", "shard_id",
        F.when(st == "SCHEDULED", "scheduled").otherwise("immediate").alias("kind"),
        "status", "payload", "priority", "attempt", "max_attempts", "retry_strategy",
        "base_delay_secs", "max_delay_secs",
        F.when(leased, j % 100).alias("lease_owner"), F.col("attempt").alias("lease_epoch"),
        F.when(leased, F.col("created_at") + secs(30)).alias("lease_expires_at"),
        F.when(st == "SCHEDULED", F.col("created_at") + secs((j % 7) * 86400)).alias("scheduled_for"),
        F.when(st == "RETRY_WAIT", F.col("created_at") + secs(j % 600)).alias("next_retry_at"),
        F.when(j % 4 != 0, F.concat(F.lit("k"), (j % 5).cast("string"))).alias("idempotency_key"),
        "created_at",
        F.when(~st.isin("SCHEDULED", "WAITING"), F.col("created_at")).alias("queued_at"),
        F.col("created_at").alias("updated_at"),
        F.when(failed, F.concat(F.lit("failed: "), F.col("ek"))).alias("error_message"),
        F.when(failed, F.col("ek")).alias("error_kind"))


_EXEC_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag",
                 "l_linestatus", "l_linenumber", "l_quantity"]


def _execution_status() -> Column:
    rf = F.col("l_returnflag")
    return (F.when(rf == "A", "COMPLETED").when(rf == "R", "FAILED")
            .when(F.col("l_linestatus") == "O", "STARTED").otherwise("ABANDONED"))


def _execution_facts(spark, d):
    """Executions without their number inside the job, for uses that need none."""
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("worker_id"),
        _execution_status().alias("status"), F.col("l_shipdate").alias("started_at"),
        F.floor("l_extendedprice").cast("long").alias("duration_ms"))


def _executions(spark, d):
    from ..operators.windows import row_number_in_groups
    li = read(spark, d, "lineitem").select(*_EXEC_COLUMNS)
    # attempt = position of the line inside its order; an order's lines are cut by year
    x = row_number_in_groups(li, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber",
                                                  "l_quantity", "l_extendedprice"], [F.year("l_shipdate")], "attempt")
    return x.select(
        (F.col("l_orderkey") * 100 + F.col("attempt")).alias("execution_id"),
        F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("worker_id"),
        "attempt", F.col("attempt").alias("lease_epoch"), _execution_status().alias("status"),
        F.col("l_shipdate").alias("started_at"),
        F.floor("l_extendedprice").cast("long").alias("duration_ms"),
        F.when(F.col("l_returnflag") == "R", _pick(ERROR_KINDS, F.col("l_linenumber") % 7)).alias("error_kind"))


def _outbox_events(spark, d):
    li = read(spark, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"),
                                     F.max("l_shipdate").alias("last"),
                                     F.count(F.lit(1)).alias("n"))
    k = F.col("l_orderkey")
    owned = (k % 4) == 1
    return g.select(
        k.alias("event_id"), k.alias("job_id"), ((F.col("n") % 5) * 5).alias("priority"),
        F.col("first").alias("created_at"),
        F.when(k % 3 == 0, F.col("first") + secs(60)).alias("published_at"),
        F.when(owned, F.concat(F.lit("relay-"), (k % 2).cast("string"))).alias("relay_owner_id"),
        F.when(owned, F.col("last")).alias("relay_locked_until"),
        F.concat(F.lit("m-"), k.cast("string")).alias("nats_msg_id"))


def _dead_letter_entries(spark, d):
    j = build(spark, d, "jobs").filter(F.col("status") == "FAILED")
    k = F.col("job_id")
    return j.select(
        k.alias("dlq_id"), "job_id", "queue_id", _pick(DLQ_REASONS, k % 3).alias("reason"),
        "error_kind", _L(3).alias("attempt"), F.col("error_message").alias("final_error"),
        "payload", (F.col("created_at") + secs(3600)).alias("moved_at"),
        F.when(k % 20 == 6, k + 1).alias("replayed_to_job_id"))


def _failure_summaries(spark, d):
    dl = build(spark, d, "dead_letter_entries").filter(F.col("dlq_id") % 3 == 0)
    return dl.select("dlq_id", F.concat(F.lit("summary: "), F.col("error_kind")).alias("summary"))


def _workers(spark, d):
    e = read(spark, d, "events")
    g = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_heartbeat_at"))
    return g.select(F.col("user_id").alias("worker_id"),
                    F.concat(F.lit("worker-"), F.col("user_id").cast("string")).alias("worker_name"),
                    (F.col("user_id") % 4 + 1).alias("max_concurrency"),
                    "started_at", "last_heartbeat_at")


def _worker_heartbeats(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("heartbeat_id"), F.col("user_id").alias("worker_id"),
                    F.col("ts").alias("heartbeat_at"),
                    (F.floor("value").cast("long") % 8).alias("running_jobs"))


def _job_logs(spark, d):
    e = read(spark, d, "events")
    et = F.col("event_type")
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("job_id"),
                    F.when(et == "error", "ERROR").when(et == "purchase", "WARN")
                     .otherwise("INFO").alias("level"),
                    F.col("props").alias("message"), F.col("ts").alias("created_at"))


_STATUS_OF_EVENT = {"signup": "QUEUED", "view": "CLAIMED", "click": "RUNNING",
                    "purchase": "COMPLETED", "error": "FAILED"}


def _status_events(spark, d):
    """epoch = the user-wise count of view (claim) events so far, as a skew-safe
    running sum (one user may own a large share of the events)."""
    from ..operators.windows import running_sum_in_groups
    e = read(spark, d, "events")
    et = F.col("event_type")
    st = F.when(et == "signup", "QUEUED").when(et == "view", "CLAIMED") \
        .when(et == "click", "RUNNING").when(et == "purchase", "COMPLETED").otherwise("FAILED")
    x = e.select(F.col("event_id"), F.col("user_id").alias("job_id"), st.alias("status"),
                 F.col("ts").alias("event_ts"), F.when(et == "view", 1).otherwise(0).alias("__v"))
    return running_sum_in_groups(x, ["job_id"], ["event_ts", "event_id"], "__v", "epoch",
                                 [F.to_date("event_ts")]).drop("__v")


def _arrivals(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("arrival_id"), F.col("event_type").alias("queue_id"),
                    F.col("ts").alias("event_ts"))


def _lease_events(spark, d):
    e = read(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    et = F.col("event_type")
    return e.select(F.col("event_id"), F.col("user_id").alias("job_id"),
                    (F.col("event_id") % 5).alias("worker_id"),
                    F.when(et == "view", "claim").when(et == "click", "renew")
                     .otherwise("complete").alias("kind"),
                    F.col("ts").alias("event_ts"))


def _messages(spark, d):
    e = read(spark, d, "events")
    k = F.col("event_id")
    m = e.select(k.alias("msg_id"),
                 F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("header_job_id"),
                 F.when(k % 6 != 0, F.col("props")).alias("body"), F.col("ts"))
    # redelivered copies one minute later (inside the broker's dedup window)
    dup = m.filter(k % 10 == 0).withColumn("ts", F.col("ts") + secs(60))
    return m.unionByName(dup)


def _scheduled_jobs(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("schedule_id"), (k % 1500).alias("queue_id"),
                    _pick(FIXTURE_CRONS, k % 5).alias("cron_expr"),
                    _pick(FIXTURE_ZONES, k % 4).alias("timezone"),
                    F.lit(None).cast("timestamp_ntz").alias("run_once_at"),
                    ((k % 6) != 0).alias("is_active"), (F.col("p_size") % 10).cast("long").alias("priority"),
                    F.lit('{"type":"echo"}').alias("payload"),
                    F.when(k % 3 == 0, ts(JOBS_NOW) - secs((k % 7) * 3600)).alias("next_fire_at"))


def _workflow_edges(spark, d):
    """Consecutive orders of a customer: lag 1 → order and lag 2 → order.

    Positions come from skew-safe numbering (a customer may own a large share of
    all orders) and predecessors from equi-joins on (customer, position)."""
    from ..operators.windows import id_range, row_number_in_groups
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    r = row_number_in_groups(o, ["o_custkey"], ["o_orderkey"], [id_range("o_orderkey")], "__rn")
    parts = []
    for lag in (1, 2):
        prev = r.select("o_custkey", (F.col("__rn") + lag).alias("__rn"), F.col("o_orderkey").alias("parent_id"))
        parts.append(r.join(prev, ["o_custkey", "__rn"]).select("parent_id", F.col("o_orderkey").alias("child_id")))
    return parts[0].unionByName(parts[1])


def _cyclic_edges(spark, d):
    o = read(spark, d, "orders")
    back = (o.filter(F.col("o_custkey") % 10 == 0).groupBy("o_custkey")
             .agg(F.max("o_orderkey").alias("parent_id"), F.min("o_orderkey").alias("child_id"),
                  F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).select("parent_id", "child_id"))
    return build(spark, d, "workflow_edges").unionByName(back)


def _capacity_tokens(spark, d):
    """Slots of every queue; CLAIMED and RUNNING jobs hold the first ones by job id, with
    their job's epoch and lease end."""
    from ..operators.windows import id_range, row_number_in_groups
    q = build(spark, d, "queues").select("queue_id", "max_concurrency")
    slots = q.select("queue_id", F.explode(F.sequence(_L(0), F.col("max_concurrency") - 1)).alias("slot_index"))
    held = build(spark, d, "jobs").filter(F.col("status").isin("CLAIMED", "RUNNING")) \
        .select("queue_id", "job_id", "lease_owner", "lease_epoch", "lease_expires_at")
    h = row_number_in_groups(held, ["queue_id"], ["job_id"], [id_range("job_id")]) \
        .select("queue_id", (F.col("rn") - 1).alias("slot_index"), F.col("lease_owner").alias("worker_id"),
                "job_id", F.col("lease_epoch").alias("epoch"), F.col("lease_expires_at").alias("lease_until"))
    return slots.join(h, ["queue_id", "slot_index"], "left").withColumn("epoch", F.coalesce("epoch", _L(0)))


def _batches(spark, d):
    o = read(spark, d, "orders")
    return (o.groupBy(F.expr("o_orderkey div 20").alias("batch_id"))
             .agg(F.count(F.lit(1)).alias("total_jobs")))


_BUILDERS = {
    "organizations": _organizations, "projects": _projects, "queues": _queues, "users": _users,
    "org_memberships": _org_memberships, "project_memberships": _project_memberships,
    "jobs": _jobs, "executions": _executions, "execution_facts": _execution_facts, "outbox_events": _outbox_events,
    "dead_letter_entries": _dead_letter_entries, "failure_summaries": _failure_summaries,
    "workers": _workers, "worker_heartbeats": _worker_heartbeats, "job_logs": _job_logs,
    "status_events": _status_events, "arrivals": _arrivals, "lease_events": _lease_events,
    "messages": _messages, "scheduled_jobs": _scheduled_jobs, "workflow_edges": _workflow_edges,
    "cyclic_edges": _cyclic_edges, "capacity_tokens": _capacity_tokens, "batches": _batches,
}


def build(spark: SparkSession, d: str, name: str, stream: bool = False) -> DataFrame:
    """A view as a batch DataFrame, or (``stream=True``) as a streaming one over
    the same files; only projection/filter views can stream."""
    tok = _STREAM.set(stream)
    try:
        return _BUILDERS[name](spark, d)
    finally:
        _STREAM.reset(tok)


class Ops:
    """Lazy access to every view of one data directory: ``Ops(spark, d).jobs``."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.dir = spark, d
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _BUILDERS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = build(self.spark, self.dir, name)
        return self._cache[name]


# ------------------------------------------------------------------ DuckDB text
_ST = _sql_list(JOB_STATUSES)
_EK = _sql_list(ERROR_KINDS)
_PT = _sql_list(PAYLOAD_TYPES)

VIEW_SQL: dict[str, str] = {
    "organizations": "SELECT CAST(r_regionkey AS BIGINT) AS org_id, r_name AS name FROM region",
    "projects": """SELECT CAST(n_nationkey AS BIGINT) AS project_id, CAST(n_regionkey AS BIGINT) AS org_id,
        n_name AS name, (n_nationkey % 10 = 9) AS is_archived FROM nation""",
    "queues": """SELECT c_custkey AS queue_id, CAST(c_nationkey AS BIGINT) AS project_id, c_name AS name,
        c_custkey % 8 + 1 AS max_concurrency, (c_custkey % 11 = 0) AS is_paused,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(3 AS BIGINT) END AS rate_limit,
        CAST(3600 AS BIGINT) AS rate_window_secs, c_custkey % 4 + 1 AS shard_count,
        CAST(5 AS BIGINT) AS default_priority, CAST(60 AS BIGINT) AS ack_wait_secs,
        CAST(3 AS BIGINT) AS max_receives FROM customer""",
    "users": """SELECT s_suppkey AS user_id, lower(replace(s_name, '#', '')) || '@example.com' AS email,
        s_name AS name, (s_suppkey % 7 <> 0) AS is_active FROM supplier""",
    "org_memberships": f"""SELECT CAST(n_regionkey AS BIGINT) AS org_id, s_suppkey AS user_id,
        {_sql_list(MEMBER_ROLES)}[s_suppkey % 4 + 1] AS role
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "project_memberships": f"""SELECT CAST(s_nationkey AS BIGINT) AS project_id, s_suppkey AS user_id,
        {_sql_list(MEMBER_ROLES)}[(s_suppkey + 1) % 4 + 1] AS role FROM supplier""",
    "jobs": f"""SELECT job_id, queue_id, batch_id, workflow_id, shard_id,
        CASE WHEN status = 'SCHEDULED' THEN 'scheduled' ELSE 'immediate' END AS kind,
        status, payload, priority, attempt, max_attempts, retry_strategy, base_delay_secs, max_delay_secs,
        CASE WHEN status IN ('CLAIMED', 'RUNNING') THEN job_id % 100 END AS lease_owner,
        attempt AS lease_epoch,
        CASE WHEN status IN ('CLAIMED', 'RUNNING') THEN created_at + to_seconds(30) END AS lease_expires_at,
        CASE WHEN status = 'SCHEDULED' THEN created_at + to_seconds((job_id % 7) * 86400) END AS scheduled_for,
        CASE WHEN status = 'RETRY_WAIT' THEN created_at + to_seconds(job_id % 600) END AS next_retry_at,
        CASE WHEN job_id % 4 <> 0 THEN 'k' || CAST(job_id % 5 AS VARCHAR) END AS idempotency_key,
        created_at,
        CASE WHEN status NOT IN ('SCHEDULED', 'WAITING') THEN created_at END AS queued_at,
        created_at AS updated_at,
        CASE WHEN status IN ('FAILED', 'RETRY_WAIT') THEN 'failed: ' || ek END AS error_message,
        CASE WHEN status IN ('FAILED', 'RETRY_WAIT') THEN ek END AS error_kind
      FROM (SELECT o_orderkey AS job_id, o_custkey AS queue_id, o_orderkey // 20 AS batch_id,
              o_custkey AS workflow_id, o_orderkey % 4 AS shard_id,
              {_ST}[o_orderkey % 10 + 1] AS status,
              '{{"type":"' || {_PT}[o_orderkey % 5 + 1] || '"'
                || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ',"secs":' || CAST(o_orderkey % 6 AS VARCHAR) END
                || CASE WHEN o_orderkey % 8 = 3 THEN ',"force_unknown":true' ELSE '' END || '}}' AS payload,
              (5 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) * 5 AS priority,
              o_orderkey % 4 AS attempt, CAST(3 AS BIGINT) AS max_attempts,
              {_sql_list(RETRY_STRATEGIES)}[o_orderkey % 3 + 1] AS retry_strategy,
              CAST(5 AS BIGINT) AS base_delay_secs, CAST(3600 AS BIGINT) AS max_delay_secs,
              o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
              {_EK}[o_orderkey % 7 + 1] AS ek
            FROM orders) o""",
    "executions": f"""SELECT l_orderkey * 100 + attempt AS execution_id, l_orderkey AS job_id,
        l_suppkey AS worker_id, attempt, attempt AS lease_epoch,
        CASE WHEN l_returnflag = 'A' THEN 'COMPLETED' WHEN l_returnflag = 'R' THEN 'FAILED'
             WHEN l_linestatus = 'O' THEN 'STARTED' ELSE 'ABANDONED' END AS status,
        l_shipdate AS started_at, CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms,
        CASE WHEN l_returnflag = 'R' THEN {_EK}[l_linenumber % 7 + 1] END AS error_kind
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey,
              l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS BIGINT) AS attempt FROM lineitem) li""",
    "outbox_events": """SELECT l_orderkey AS event_id, l_orderkey AS job_id, (n % 5) * 5 AS priority,
        first AS created_at, CASE WHEN l_orderkey % 3 = 0 THEN first + to_seconds(60) END AS published_at,
        CASE WHEN l_orderkey % 4 = 1 THEN 'relay-' || CAST(l_orderkey % 2 AS VARCHAR) END AS relay_owner_id,
        CASE WHEN l_orderkey % 4 = 1 THEN last END AS relay_locked_until,
        'm-' || CAST(l_orderkey AS VARCHAR) AS nats_msg_id
      FROM (SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n
            FROM lineitem GROUP BY l_orderkey) g""",
    "dead_letter_entries": f"""SELECT job_id AS dlq_id, job_id, queue_id,
        {_sql_list(DLQ_REASONS)}[job_id % 3 + 1] AS reason, error_kind, CAST(3 AS BIGINT) AS attempt,
        error_message AS final_error, payload, created_at + to_seconds(3600) AS moved_at,
        CASE WHEN job_id % 20 = 6 THEN job_id + 1 END AS replayed_to_job_id
      FROM jobs WHERE status = 'FAILED'""",
    "failure_summaries": """SELECT dlq_id, 'summary: ' || error_kind AS summary
      FROM dead_letter_entries WHERE dlq_id % 3 = 0""",
    "workers": """SELECT user_id AS worker_id, 'worker-' || CAST(user_id AS VARCHAR) AS worker_name,
        user_id % 4 + 1 AS max_concurrency, min(ts) AS started_at, max(ts) AS last_heartbeat_at
      FROM events GROUP BY user_id""",
    "worker_heartbeats": """SELECT event_id AS heartbeat_id, user_id AS worker_id, ts AS heartbeat_at,
        CAST(floor(value) AS BIGINT) % 8 AS running_jobs FROM events""",
    "job_logs": """SELECT event_id AS log_id, user_id AS job_id,
        CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
        props AS message, ts AS created_at FROM events""",
    "status_events": """SELECT event_id, user_id AS job_id,
        CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'CLAIMED' WHEN 'click' THEN 'RUNNING'
             WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts AS event_ts,
        CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM events""",
    "arrivals": "SELECT event_id AS arrival_id, event_type AS queue_id, ts AS event_ts FROM events",
    "lease_events": """SELECT event_id, user_id AS job_id, event_id % 5 AS worker_id,
        CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' ELSE 'complete' END AS kind,
        ts AS event_ts FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
    "messages": """SELECT * FROM (SELECT event_id AS msg_id,
          CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS header_job_id,
          CASE WHEN event_id % 6 <> 0 THEN props END AS body, ts FROM events) m
      UNION ALL
      SELECT msg_id, header_job_id, body, ts + to_seconds(60) FROM (SELECT event_id AS msg_id,
          CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS header_job_id,
          CASE WHEN event_id % 6 <> 0 THEN props END AS body, ts FROM events WHERE event_id % 10 = 0) d""",
    "scheduled_jobs": f"""SELECT p_partkey AS schedule_id, p_partkey % 1500 AS queue_id,
        {_sql_list(FIXTURE_CRONS)}[p_partkey % 5 + 1] AS cron_expr,
        {_sql_list(FIXTURE_ZONES)}[p_partkey % 4 + 1] AS timezone,
        CAST(NULL AS TIMESTAMP) AS run_once_at, (p_partkey % 6 <> 0) AS is_active,
        CAST(p_size % 10 AS BIGINT) AS priority, '{{"type":"echo"}}' AS payload,
        CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '{JOBS_NOW}' - to_seconds((p_partkey % 7) * 3600) END AS next_fire_at FROM part""",
    "workflow_edges": """SELECT parent_id, child_id FROM (
        SELECT lag(o_orderkey, 1) OVER w AS parent_id, o_orderkey AS child_id FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
        UNION ALL
        SELECT lag(o_orderkey, 2) OVER w AS parent_id, o_orderkey AS child_id FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) e WHERE parent_id IS NOT NULL""",
    "cyclic_edges": """SELECT parent_id, child_id FROM workflow_edges UNION ALL
        SELECT max(o_orderkey) AS parent_id, min(o_orderkey) AS child_id FROM orders
        WHERE o_custkey % 10 = 0 GROUP BY o_custkey HAVING count(*) > 1""",
    "capacity_tokens": """SELECT s.queue_id, s.slot_index, h.worker_id, h.job_id, coalesce(h.epoch, 0) AS epoch, h.lease_until
      FROM (SELECT queue_id, CAST(unnest(range(0, max_concurrency)) AS BIGINT) AS slot_index FROM queues) s
      LEFT JOIN (SELECT queue_id, CAST(row_number() OVER (PARTITION BY queue_id ORDER BY job_id) - 1 AS BIGINT) AS slot_index,
                        lease_owner AS worker_id, job_id, lease_epoch AS epoch, lease_expires_at AS lease_until
                 FROM jobs WHERE status IN ('CLAIMED', 'RUNNING')) h
      ON s.queue_id = h.queue_id AND s.slot_index = h.slot_index""",
    "batches": "SELECT o_orderkey // 20 AS batch_id, count(*) AS total_jobs FROM orders GROUP BY o_orderkey // 20",
}

VIEW_DEPS = {
    "dead_letter_entries": ["jobs"], "failure_summaries": ["dead_letter_entries"],
    "cyclic_edges": ["workflow_edges"], "capacity_tokens": ["queues", "jobs"],
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views (dependencies first)."""
    order: list[str] = []

    def add(n):
        for dep in VIEW_DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def jobs_now():
    return ts(JOBS_NOW)


def events_now():
    return ts(EVENTS_NOW)
