"""Canonical table schemas, enum domains and transition matrices.

Keys are LongType in the supplied fixtures; every operator is key-type agnostic."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the reference's domains) --------------------------
JOB_STATUSES = [
    "SCHEDULED", "QUEUED", "CLAIMED", "RUNNING", "RETRY_WAIT", "COMPLETED",
    "FAILED", "CANCELLED", "WAITING", "UNKNOWN_EXTERNAL_RESULT",
]
JOB_KINDS = ["immediate", "delayed", "scheduled", "recurring", "batch"]
EXECUTION_STATUSES = ["STARTED", "COMPLETED", "FAILED", "ABANDONED"]
BATCH_STATUSES = ["QUEUED", "RUNNING", "PARTIALLY_COMPLETED", "COMPLETED", "FAILED"]
DLQ_REASONS = ["max_attempts_exceeded", "permanent_failure", "cancelled"]
RETRY_STRATEGIES = ["fixed", "linear", "exponential"]
WORKER_STATUSES = ["ONLINE", "STALE", "OFFLINE"]
MEMBER_ROLES = ["owner", "admin", "member", "viewer"]
LOG_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]

# Transitions the domain model declares (from, to).
DECLARED_TRANSITIONS = [
    ("SCHEDULED", "QUEUED"), ("WAITING", "QUEUED"), ("QUEUED", "CLAIMED"),
    ("CLAIMED", "RUNNING"), ("RUNNING", "COMPLETED"), ("RUNNING", "RETRY_WAIT"),
    ("RUNNING", "FAILED"), ("RUNNING", "UNKNOWN_EXTERNAL_RESULT"),
    ("RETRY_WAIT", "QUEUED"), ("RETRY_WAIT", "FAILED"), ("QUEUED", "CANCELLED"),
    ("SCHEDULED", "CANCELLED"), ("WAITING", "CANCELLED"), ("RETRY_WAIT", "CANCELLED"),
]
# Edges the data-modifying statements actually perform on top of the declared ones.
EFFECTIVE_TRANSITIONS = DECLARED_TRANSITIONS + [
    ("RETRY_WAIT", "CLAIMED"), ("RUNNING", "QUEUED"), ("CLAIMED", "QUEUED"),
    ("FAILED", "QUEUED"),
]

# Service defaults.
DEFAULT_LEASE_SECS = 30
RECLAIM_GRACE_SECS = 10
BACKFILL_AGE_SECS = 30
OUTBOX_BATCH = 100
OUTBOX_LOCK_SECS = 30
WORKER_ONLINE_SECS = 15
WORKER_STALE_SECS = 60
# -------------------------------------------------------------------------------

_L, _I, _S, _D, _B, _TS = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(),
                           T.BooleanType(), T.TimestampNTZType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "organizations": _st(("org_id", _L), ("name", _S)),
    "projects": _st(("project_id", _L), ("org_id", _L), ("name", _S), ("is_archived", _B)),
    "users": _st(("user_id", _L), ("email", _S), ("name", _S), ("is_active", _B)),
    "org_memberships": _st(("org_id", _L), ("user_id", _L), ("role", _S)),
    "project_memberships": _st(("project_id", _L), ("user_id", _L), ("role", _S)),
    "queues": _st(("queue_id", _L), ("project_id", _L), ("name", _S), ("max_concurrency", _L),
                  ("is_paused", _B), ("rate_limit", _L), ("rate_window_secs", _L),
                  ("shard_count", _L), ("default_priority", _L), ("ack_wait_secs", _L),
                  ("max_receives", _L)),
    "jobs": _st(("job_id", _L), ("queue_id", _L), ("batch_id", _L), ("workflow_id", _L),
                ("shard_id", _L), ("kind", _S), ("status", _S), ("payload", _S),
                ("priority", _L), ("attempt", _L), ("max_attempts", _L),
                ("retry_strategy", _S), ("base_delay_secs", _L), ("max_delay_secs", _L),
                ("lease_owner", _L), ("lease_epoch", _L), ("lease_expires_at", _TS),
                ("scheduled_for", _TS), ("next_retry_at", _TS), ("idempotency_key", _S),
                ("created_at", _TS), ("queued_at", _TS), ("updated_at", _TS),
                ("error_message", _S), ("error_kind", _S)),
    "executions": _st(("execution_id", _L), ("job_id", _L), ("worker_id", _L), ("attempt", _L),
                      ("lease_epoch", _L), ("status", _S), ("started_at", _TS),
                      ("duration_ms", _L), ("error_kind", _S)),
    "job_logs": _st(("log_id", _L), ("job_id", _L), ("level", _S), ("message", _S),
                    ("created_at", _TS)),
    "outbox_events": _st(("event_id", _L), ("job_id", _L), ("priority", _L),
                         ("created_at", _TS), ("published_at", _TS), ("relay_owner_id", _S),
                         ("relay_locked_until", _TS), ("nats_msg_id", _S)),
    "dead_letter_entries": _st(("dlq_id", _L), ("job_id", _L), ("queue_id", _L), ("reason", _S),
                               ("error_kind", _S), ("attempt", _L), ("final_error", _S),
                               ("payload", _S), ("moved_at", _TS), ("replayed_to_job_id", _L)),
    "failure_summaries": _st(("dlq_id", _L), ("summary", _S)),
    "workers": _st(("worker_id", _L), ("worker_name", _S), ("max_concurrency", _L),
                   ("started_at", _TS), ("last_heartbeat_at", _TS)),
    "worker_heartbeats": _st(("heartbeat_id", _L), ("worker_id", _L), ("heartbeat_at", _TS),
                             ("running_jobs", _L)),
    "capacity_tokens": _st(("queue_id", _L), ("slot_index", _L), ("worker_id", _L),
                           ("job_id", _L)),
    "scheduled_jobs": _st(("schedule_id", _L), ("queue_id", _L), ("cron_expr", _S),
                          ("timezone", _S), ("run_once_at", _TS), ("is_active", _B),
                          ("priority", _L), ("payload", _S), ("next_fire_at", _TS)),
    "workflow_edges": _st(("parent_id", _L), ("child_id", _L)),
    "edge_satisfaction": _st(("parent_id", _L), ("child_id", _L)),
    "batches": _st(("batch_id", _L), ("total_jobs", _L)),
}
