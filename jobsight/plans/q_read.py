"""Registered read-side queries: sources, filters, joins, aggregates, windows, pages, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..session import checkpoint_dir
from ..sources.fixtures import Ops, with_views
from ..sources.tables import load_ops, save_ops
from .registry import register

# ---------------------------------------------------------------- S1 typed scans
for _v in ["queues", "jobs", "executions", "outbox_events", "dead_letter_entries",
           "capacity_tokens", "workflow_edges", "status_events"]:
    register(f"s1_{_v}", with_views(f"SELECT * FROM {_v}", _v))(
        (lambda v: lambda spark, d: getattr(Ops(spark, d), v))(_v))


# ---------------------------------------------------------------- A1 (flagship)
@register("a1_tenant_queue_stats", with_views("""
SELECT q.queue_id, p.project_id, p.org_id,
  coalesce(j.queued, 0) AS queued, coalesce(j.running, 0) AS running, coalesce(j.retry_wait, 0) AS retry_wait,
  coalesce(j.completed, 0) AS completed, coalesce(j.failed, 0) AS failed,
  coalesce(j.scheduled, 0) AS scheduled, coalesce(j.claimed, 0) AS claimed, coalesce(d.dlq, 0) AS dlq
FROM queues q JOIN projects p ON p.project_id = q.project_id
LEFT JOIN (SELECT queue_id,
    CAST(sum(CASE WHEN status = 'QUEUED' THEN 1 ELSE 0 END) AS BIGINT) AS queued,
    CAST(sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS running,
    CAST(sum(CASE WHEN status = 'RETRY_WAIT' THEN 1 ELSE 0 END) AS BIGINT) AS retry_wait,
    CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
    CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CAST(sum(CASE WHEN status = 'SCHEDULED' THEN 1 ELSE 0 END) AS BIGINT) AS scheduled,
    CAST(sum(CASE WHEN status = 'CLAIMED' THEN 1 ELSE 0 END) AS BIGINT) AS claimed
  FROM jobs GROUP BY queue_id) j ON j.queue_id = q.queue_id
LEFT JOIN (SELECT queue_id, count(*) AS dlq FROM dead_letter_entries GROUP BY queue_id) d ON d.queue_id = q.queue_id
""", "queues", "projects", "jobs", "dead_letter_entries"))
def a1_tenant_queue_stats(spark, d):
    o = Ops(spark, d)
    return A.tenant_queue_stats(o.queues, o.projects, o.jobs, o.dead_letter_entries)


# ================================================================== shared bits
from ..operators import filters as Fl  # noqa: E402
from ..operators import merge as U  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..schema import DECLARED_TRANSITIONS  # noqa: E402
from ..sources.fixtures import EVENTS_NOW, JOBS_NOW, read  # noqa: E402

NOW_SQL = f"TIMESTAMP '{JOBS_NOW}'"
ENOW_SQL = f"TIMESTAMP '{EVENTS_NOW}'"


# ---------------------------------------------------------------- S3
@register("s3_decode_messages_good", with_views("""
SELECT * FROM (SELECT msg_id, header_job_id, body, ts,
  coalesce(TRY_CAST(header_job_id AS BIGINT), TRY_CAST(json_extract_string(body, '$.k') AS BIGINT)) AS job_id
  FROM messages) m WHERE job_id IS NOT NULL""", "messages"))
def s3_good(spark, d):
    good, _ = Fl.decode_messages(Ops(spark, d).messages, body_path="$.k")
    return good


@register("s3_decode_messages_rejected", with_views("""
SELECT msg_id, header_job_id, body, ts,
  CASE WHEN TRY_CAST(header_job_id AS BIGINT) IS NULL AND (body IS NULL OR NOT coalesce(json_valid(body), false))
       THEN 'bad_payload' ELSE 'no_job_id' END AS reject_reason
FROM messages WHERE coalesce(TRY_CAST(header_job_id AS BIGINT), TRY_CAST(json_extract_string(body, '$.k') AS BIGINT)) IS NULL
""", "messages"))
def s3_rejected(spark, d):
    _, rej = Fl.decode_messages(Ops(spark, d).messages, body_path="$.k")
    return rej


# ---------------------------------------------------------------- F
@register("f1_replayed_jobs_by_key", with_views("""
SELECT job_id, queue_id, status FROM jobs
WHERE job_id IN (SELECT replayed_to_job_id FROM dead_letter_entries)""", "jobs", "dead_letter_entries"))
def f1(spark, d):
    o = Ops(spark, d)
    keys = o.dead_letter_entries.select(F.col("replayed_to_job_id").alias("job_id"))
    return Fl.by_keys(o.jobs, keys, "job_id").select("job_id", "queue_id", "status")


@register("f2_filter_jobs", with_views("""
SELECT job_id, queue_id, priority, status FROM jobs WHERE status = 'QUEUED' AND priority >= 10""", "jobs"))
def f2(spark, d):
    return Fl.filter_jobs(Ops(spark, d).jobs, status="QUEUED", priority_min=10) \
        .select("job_id", "queue_id", "priority", "status")


_F3_REQ = """(SELECT o_orderkey // {g} {sign} AS request_id,
   string_agg(CAST(o_orderkey AS VARCHAR), ',') || ',bad,' AS ids FROM orders GROUP BY o_orderkey // {g})"""


def _f3_requests(spark, d):
    o = read(spark, d, "orders")

    def reqs(g, sign):
        return (o.groupBy(F.expr(f"o_orderkey div {g}").alias("g"))
                 .agg(F.concat(F.concat_ws(",", F.collect_list(F.col("o_orderkey").cast("string"))),
                               F.lit(",bad,")).alias("ids"))
                 .select((F.col("g") * sign).alias("request_id"), "ids"))
    # 50-id requests (accepted) and 120-id requests (over the 100-id limit)
    return reqs(50, 1).unionByName(reqs(120, -1))


_F3_PARSED = f"""(SELECT request_id, list_filter(list_transform(string_split(ids, ','),
      lambda s: TRY_CAST(s AS BIGINT)), lambda x: x IS NOT NULL) AS l
   FROM ({_F3_REQ.format(g=50, sign='')} UNION ALL {_F3_REQ.format(g=120, sign='* -1')}) r)"""


@register("f3_id_list_accepted", f"""SELECT request_id, unnest(l) AS id FROM {_F3_PARSED} p WHERE len(l) <= 100""")
def f3_ok(spark, d):
    ok, _ = Fl.parse_id_list(_f3_requests(spark, d))
    return ok


@register("f3_id_list_rejected", f"""SELECT request_id, CAST(len(l) AS BIGINT) AS n_ids FROM {_F3_PARSED} p WHERE len(l) > 100""")
def f3_rej(spark, d):
    _, rej = Fl.parse_id_list(_f3_requests(spark, d))
    return rej


@register("f4_live_queues", with_views("""
SELECT queue_id, project_id FROM queues WHERE NOT is_paused
  AND project_id IN (SELECT project_id FROM projects WHERE NOT is_archived)""", "queues", "projects"))
def f4(spark, d):
    o = Ops(spark, d)
    return Fl.unpaused(o.queues).join(Fl.non_archived(o.projects).select("project_id"), "project_id",
                                      "left_semi").select("queue_id", "project_id")


@register("f5_due_work", with_views(f"""
SELECT 'scheduled' AS rule, job_id FROM jobs WHERE status = 'SCHEDULED' AND scheduled_for IS NOT NULL AND scheduled_for <= {NOW_SQL}
UNION ALL SELECT 'retry', job_id FROM jobs WHERE status = 'RETRY_WAIT' AND next_retry_at IS NOT NULL AND next_retry_at <= {NOW_SQL}
UNION ALL SELECT 'stale_lease', job_id FROM jobs WHERE status IN ('RUNNING', 'CLAIMED') AND lease_expires_at IS NOT NULL
  AND lease_expires_at < {NOW_SQL} - INTERVAL 10 SECOND
UNION ALL SELECT 'queued_aged', job_id FROM jobs WHERE status = 'QUEUED' AND queued_at < {NOW_SQL} - INTERVAL 30 SECOND""", "jobs"))
def f5(spark, d):
    j = Ops(spark, d).jobs
    return W.union_all([Fl.due(j, r, JOBS_NOW).select(F.lit(r).alias("rule"), "job_id")
                        for r in ("scheduled", "retry", "stale_lease", "queued_aged")])


@register("f6_search_jobs", with_views("""
SELECT job_id, idempotency_key FROM jobs
WHERE contains(lower(concat_ws(' ', CAST(job_id AS VARCHAR), idempotency_key)), lower('K1'))""", "jobs"))
def f6(spark, d):
    return Fl.search_jobs(Ops(spark, d).jobs, "K1").select("job_id", "idempotency_key")


@register("f7_violations", with_views("""
SELECT 'jobs' AS tbl, job_id AS id, 'duplicate_idempotency_key' AS rule FROM jobs
  WHERE idempotency_key IS NOT NULL AND (queue_id, idempotency_key) IN
    (SELECT queue_id, idempotency_key FROM jobs WHERE idempotency_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'jobs', job_id, r FROM (SELECT job_id, unnest([
    CASE WHEN NOT (priority BETWEEN 0 AND 100) THEN 'priority_0_100' END,
    CASE WHEN NOT (max_attempts BETWEEN 1 AND 100) THEN 'max_attempts_1_100' END,
    CASE WHEN NOT (base_delay_secs >= 0) THEN 'base_delay_nonnegative' END,
    CASE WHEN NOT (base_delay_secs <= max_delay_secs) THEN 'base_delay_le_max' END,
    CASE WHEN NOT (shard_id >= 0) THEN 'shard_id_nonnegative' END]) AS r FROM jobs) x WHERE r IS NOT NULL
UNION ALL SELECT 'queues', queue_id, r FROM (SELECT queue_id, unnest([
    CASE WHEN NOT (max_concurrency BETWEEN 1 AND 1000) THEN 'max_concurrency_1_1000' END,
    CASE WHEN NOT (shard_count BETWEEN 1 AND 128) THEN 'shard_count_1_128' END,
    CASE WHEN NOT (rate_limit > 0) THEN 'rate_limit_positive' END,
    CASE WHEN NOT (length(name) BETWEEN 1 AND 100) THEN 'name_length_1_100' END]) AS r FROM queues) y WHERE r IS NOT NULL
UNION ALL SELECT 'workflow_edges', child_id, 'no_self_edge' FROM cyclic_edges WHERE parent_id = child_id
""", "jobs", "queues", "cyclic_edges"))
def f7(spark, d):
    o = Ops(spark, d)
    jr = Fl.rules("jobs")
    qr = Fl.rules("queues")
    jobs_rules = {k: jr[k] for k in ("priority_0_100", "max_attempts_1_100", "base_delay_nonnegative",
                                     "base_delay_le_max", "shard_id_nonnegative")}
    queue_rules = {k: qr[k] for k in ("max_concurrency_1_1000", "shard_count_1_128", "rate_limit_positive",
                                      "name_length_1_100")}
    parts = [
        Fl.unique_violations(o.jobs, ["queue_id", "idempotency_key"], "job_id", "duplicate_idempotency_key")
          .select(F.lit("jobs").alias("tbl"), F.col("job_id").alias("id"), "rule"),
        Fl.violations(o.jobs, jobs_rules, "job_id").select(F.lit("jobs").alias("tbl"),
                                                           F.col("job_id").alias("id"), "rule"),
        Fl.violations(o.queues, queue_rules, "queue_id").select(F.lit("queues").alias("tbl"),
                                                                F.col("queue_id").alias("id"), "rule"),
        Fl.violations(o.cyclic_edges, Fl.rules("workflow_edges"), "child_id")
          .select(F.lit("workflow_edges").alias("tbl"), F.col("child_id").alias("id"), "rule"),
    ]
    return W.union_all(parts)


_POLICIES_SQL = """(SELECT c_custkey AS policy_id, CAST(c_nationkey AS BIGINT) AS project_id, 'policy-' || CAST(c_custkey % 40 AS VARCHAR) AS name,
  c_custkey % 103 AS max_attempts, c_custkey % 50 - 2 AS base_delay_secs, (c_custkey % 7) * 10 AS max_delay_secs,
  ['fixed', 'linear', 'exponential', 'never'][c_custkey % 4 + 1] AS strategy FROM customer)"""


@register("f7_policy_violations", f"""
SELECT 'retry_policies' AS tbl, policy_id AS id, r AS rule FROM (SELECT policy_id, unnest([
    CASE WHEN NOT (max_attempts BETWEEN 1 AND 100) THEN 'max_attempts_1_100' END,
    CASE WHEN NOT (base_delay_secs >= 0) THEN 'base_delay_nonnegative' END,
    CASE WHEN NOT (base_delay_secs <= max_delay_secs) THEN 'base_delay_le_max' END,
    CASE WHEN strategy NOT IN ('fixed', 'linear', 'exponential') THEN 'strategy_domain' END]) AS r FROM {_POLICIES_SQL} p) x
  WHERE r IS NOT NULL
UNION ALL SELECT 'retry_policies', policy_id, 'duplicate_name' FROM {_POLICIES_SQL} p WHERE (project_id, name) IN
  (SELECT project_id, name FROM {_POLICIES_SQL} q GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'projects', CAST(n_nationkey AS BIGINT), 'slug_length_2_50' FROM nation
  WHERE NOT (length(lower(substr(n_name, 1, CAST(n_nationkey % 4 AS INTEGER)))) BETWEEN 2 AND 50)""")
def f7p(spark, d):
    """Retry policies (one per customer row) and project slugs against their rules."""
    k = F.col("c_custkey")
    strategies = F.array(*[F.lit(v) for v in ("fixed", "linear", "exponential", "never")])
    pol = read(spark, d, "customer").select(
        k.alias("policy_id"), F.col("c_nationkey").cast("long").alias("project_id"),
        F.concat(F.lit("policy-"), (k % 40).cast("string")).alias("name"), (k % 103).alias("max_attempts"),
        (k % 50 - 2).alias("base_delay_secs"), ((k % 7) * 10).alias("max_delay_secs"),
        F.get(strategies, (k % 4).cast("int")).alias("strategy"))
    n = F.col("n_nationkey")
    projects = read(spark, d, "nation").select(n.cast("long").alias("project_id"), F.col("n_name").alias("name"),
                                               F.lower(F.substr("n_name", F.lit(1), (n % 4).cast("int"))).alias("slug"))
    parts = [(Fl.violations(pol, Fl.rules("retry_policies"), "policy_id"), "retry_policies", "policy_id"),
             (Fl.unique_violations(pol, ["project_id", "name"], "policy_id", "duplicate_name"), "retry_policies", "policy_id"),
             (Fl.violations(projects, Fl.rules("projects"), "project_id"), "projects", "project_id")]
    return W.union_all([v.select(F.lit(t).alias("tbl"), F.col(c).alias("id"), "rule") for v, t, c in parts])


@register("f8_orphans", with_views("""
SELECT 'jobs.lease_owner' AS fk, job_id AS id FROM jobs WHERE lease_owner IS NOT NULL
  AND lease_owner NOT IN (SELECT worker_id FROM workers)
UNION ALL SELECT 'dead_letter_entries.replayed_to_job_id', dlq_id FROM dead_letter_entries
  WHERE replayed_to_job_id IS NOT NULL AND replayed_to_job_id NOT IN (SELECT job_id FROM jobs)
UNION ALL SELECT 'schedules.schedule_id as queue', schedule_id FROM scheduled_jobs
  WHERE schedule_id NOT IN (SELECT queue_id FROM queues)""",
    "jobs", "workers", "dead_letter_entries", "scheduled_jobs", "queues"))
def f8(spark, d):
    o = Ops(spark, d)
    a = Fl.orphans(o.jobs, "lease_owner", o.workers, "worker_id").select(
        F.lit("jobs.lease_owner").alias("fk"), F.col("job_id").alias("id"))
    b = Fl.orphans(o.dead_letter_entries, "replayed_to_job_id", o.jobs, "job_id").select(
        F.lit("dead_letter_entries.replayed_to_job_id").alias("fk"), F.col("dlq_id").alias("id"))
    # a positive case: schedule ids run past the queue ids
    c = Fl.orphans(o.scheduled_jobs.select(F.col("schedule_id").alias("queue_id")), "queue_id", o.queues, "queue_id") \
        .select(F.lit("schedules.schedule_id as queue").alias("fk"), F.col("queue_id").alias("id"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- J
@register("j1_job_context", with_views("""
SELECT j.job_id, j.queue_id, p.project_id, p.org_id FROM jobs j JOIN queues q ON q.queue_id = j.queue_id
JOIN projects p ON p.project_id = q.project_id""", "jobs", "queues", "projects"))
def j1(spark, d):
    o = Ops(spark, d)
    return J.with_context(o.jobs.select("job_id", "queue_id"), o.queues, o.projects)


@register("j2_visible_orgs", with_views("""
SELECT o.org_id, o.name, m.user_id, m.role FROM organizations o JOIN org_memberships m ON m.org_id = o.org_id""",
    "organizations", "org_memberships"))
def j2(spark, d):
    o = Ops(spark, d)
    return J.orgs_visible_to(o.organizations, o.org_memberships)


_PAIRS_SQL = """(SELECT DISTINCT j.lease_owner AS user_id, p.org_id FROM jobs j JOIN queues q ON q.queue_id = j.queue_id
  JOIN projects p ON p.project_id = q.project_id WHERE j.lease_owner IS NOT NULL)"""


def _pairs(o):
    j = o.jobs.filter(F.col("lease_owner").isNotNull()).select("queue_id", F.col("lease_owner").alias("user_id"))
    return J.with_context(j, o.queues, o.projects).select("user_id", "org_id").distinct()


@register("j3_has_access", with_views(f"""
SELECT r.user_id, r.org_id, EXISTS (SELECT 1 FROM org_memberships m WHERE m.user_id = r.user_id AND m.org_id = r.org_id) AS allowed
FROM {_PAIRS_SQL} r""", "jobs", "queues", "projects", "org_memberships"))
def j3(spark, d):
    o = Ops(spark, d)
    return J.has_access(_pairs(o), o.org_memberships)


@register("j4_role_allows", with_views(f"""
SELECT r.user_id, r.org_id,
  CASE WHEN m.role IS NULL THEN 'not_in_org' WHEN m.role IN ('owner', 'admin') THEN 'ok' ELSE 'insufficient' END AS reason,
  coalesce(m.role IN ('owner', 'admin'), false) AS allowed
FROM {_PAIRS_SQL} r LEFT JOIN org_memberships m ON m.user_id = r.user_id AND m.org_id = r.org_id""",
    "jobs", "queues", "projects", "org_memberships"))
def j4(spark, d):
    o = Ops(spark, d)
    return J.role_allows(_pairs(o), o.org_memberships)


@register("j4_role_writers", with_views(f"""
SELECT r.user_id, r.org_id,
  CASE WHEN m.role IS NULL THEN 'not_in_org' WHEN m.role IN ('owner', 'admin', 'member') THEN 'ok' ELSE 'insufficient' END AS reason,
  coalesce(m.role IN ('owner', 'admin', 'member'), false) AS allowed
FROM {_PAIRS_SQL} r LEFT JOIN org_memberships m ON m.user_id = r.user_id AND m.org_id = r.org_id""",
    "jobs", "queues", "projects", "org_memberships"))
def j4w(spark, d):
    o = Ops(spark, d)
    return J.role_allows(_pairs(o), o.org_memberships, J.WRITER_ROLES)


@register("j5_queued_without_outbox", with_views(f"""
SELECT job_id, queue_id FROM jobs j WHERE status = 'QUEUED' AND queued_at < {NOW_SQL} - INTERVAL 30 SECOND
  AND NOT EXISTS (SELECT 1 FROM outbox_events e WHERE e.job_id = j.job_id)""", "jobs", "outbox_events"))
def j5(spark, d):
    o = Ops(spark, d)
    return J.missing(Fl.due(o.jobs, "queued_aged", JOBS_NOW), o.outbox_events, "job_id").select("job_id", "queue_id")


@register("j6_worker_view", with_views(f"""
SELECT w.worker_id, w.worker_name, w.last_heartbeat_at,
  CASE WHEN w.last_heartbeat_at IS NULL THEN 'OFFLINE'
       WHEN w.last_heartbeat_at > {ENOW_SQL} - INTERVAL 3600 SECOND THEN 'ONLINE'
       WHEN w.last_heartbeat_at > {ENOW_SQL} - INTERVAL 43200 SECOND THEN 'STALE' ELSE 'OFFLINE' END AS status,
  coalesce(r.n, 0) AS running_jobs
FROM workers w LEFT JOIN (SELECT lease_owner, count(*) AS n FROM jobs WHERE status = 'RUNNING' GROUP BY lease_owner) r
  ON r.lease_owner = w.worker_id""", "workers", "jobs"))
def j6(spark, d):
    o = Ops(spark, d)
    return J.worker_view(o.workers, o.jobs, EVENTS_NOW, 3600, 43200).select(
        "worker_id", "worker_name", "last_heartbeat_at", "status", "running_jobs")


@register("j7_capacity_slots", with_views("""
SELECT queue_id, CAST(unnest(range(0, max_concurrency)) AS BIGINT) AS slot_index FROM queues""", "queues"))
def j7(spark, d):
    return J.capacity_slots(Ops(spark, d).queues)


def _renewals(o):
    j = o.jobs.filter(F.col("status").isin("RUNNING", "CLAIMED"))
    return j.select("job_id", F.col("lease_owner").alias("worker_id"),
                    F.when(F.col("job_id") % 3 == 0, F.col("lease_epoch") + 1)
                     .otherwise(F.col("lease_epoch")).alias("epoch"))


@register("j8_lease_renewals", with_views(f"""
WITH r AS (SELECT job_id, lease_owner AS worker_id,
    CASE WHEN job_id % 3 = 0 THEN lease_epoch + 1 ELSE lease_epoch END AS epoch
  FROM jobs WHERE status IN ('RUNNING', 'CLAIMED'))
SELECT r.job_id, r.worker_id, r.epoch, {NOW_SQL} + INTERVAL 30 SECOND AS lease_expires_at
FROM r JOIN jobs j ON j.job_id = r.job_id AND j.lease_owner = r.worker_id AND j.lease_epoch = r.epoch
  AND j.status = 'RUNNING'
WHERE EXISTS (SELECT 1 FROM capacity_tokens t WHERE t.job_id = r.job_id AND t.worker_id = r.worker_id)""",
    "jobs", "capacity_tokens"))
def j8(spark, d):
    o = Ops(spark, d)
    new_jobs, _, ok = J.apply_renewals(o.jobs, o.capacity_tokens, _renewals(o), JOBS_NOW)
    return ok.join(new_jobs.select("job_id", "lease_expires_at"), "job_id")


def _reports(o):
    j = o.jobs.filter(F.col("status").isin("CLAIMED", "RUNNING", "COMPLETED"))
    k = F.col("job_id")
    return j.select(F.when(k % 5 == 2, k + 1_000_000_000).otherwise(k).alias("job_id"),
                    F.when(k % 5 == 0, k % 100 + 1).otherwise(k % 100).alias("worker_id"),
                    F.when(k % 5 == 1, F.col("lease_epoch") - 1).otherwise(F.col("lease_epoch")).alias("epoch"))


@register("j9_fence_reports", with_views("""
WITH r AS (SELECT CASE WHEN job_id % 5 = 2 THEN job_id + 1000000000 ELSE job_id END AS job_id,
    CASE WHEN job_id % 5 = 0 THEN job_id % 100 + 1 ELSE job_id % 100 END AS worker_id,
    CASE WHEN job_id % 5 = 1 THEN lease_epoch - 1 ELSE lease_epoch END AS epoch
  FROM jobs WHERE status IN ('CLAIMED', 'RUNNING', 'COMPLETED'))
SELECT r.job_id, r.worker_id, r.epoch,
  CASE WHEN j.job_id IS NULL THEN 'unknown_job' WHEN NOT coalesce(r.worker_id = j.lease_owner, false) THEN 'wrong_owner'
       WHEN NOT coalesce(r.epoch = j.lease_epoch, false) THEN 'stale_epoch' WHEN j.status <> 'RUNNING' THEN 'not_running'
       ELSE 'accepted' END AS verdict
FROM r LEFT JOIN jobs j ON j.job_id = r.job_id""", "jobs"))
def j9(spark, d):
    o = Ops(spark, d)
    return J.fence(_reports(o), o.jobs)


@register("j10_abandon_executions", with_views(f"""
SELECT execution_id, job_id, 'ABANDONED' AS status, {NOW_SQL} AS finished_at FROM executions
WHERE status = 'STARTED' AND job_id IN (SELECT job_id FROM jobs WHERE status IN ('RUNNING', 'CLAIMED')
  AND lease_expires_at IS NOT NULL AND lease_expires_at < {NOW_SQL} - INTERVAL 10 SECOND)""", "executions", "jobs"))
def j10(spark, d):
    o = Ops(spark, d)
    stale = Fl.due(o.jobs, "stale_lease", JOBS_NOW).select("job_id")
    out = J.abandon(o.executions, stale, JOBS_NOW)
    return out.filter(F.col("finished_at").isNotNull()).select("execution_id", "job_id", "status", "finished_at")


@register("j11_dlq_with_summary", with_views("""
SELECT d.dlq_id, d.error_kind, s.summary FROM dead_letter_entries d JOIN failure_summaries s ON s.dlq_id = d.dlq_id""",
    "dead_letter_entries", "failure_summaries"))
def j11(spark, d):
    o = Ops(spark, d)
    return J.dlq_with_summary(o.dead_letter_entries, o.failure_summaries, "inner").select("dlq_id", "error_kind", "summary")


@register("j12_workflow_view", with_views("""
SELECT j.workflow_id, e.parent_id, e.child_id FROM workflow_edges e JOIN jobs j ON j.job_id = e.parent_id
UNION SELECT j.workflow_id, e.parent_id, e.child_id FROM workflow_edges e JOIN jobs j ON j.job_id = e.child_id""",
    "workflow_edges", "jobs"))
def j12(spark, d):
    o = Ops(spark, d)
    return J.workflow_view(o.jobs, o.workflow_edges)


@register("j13_replay_lineage", with_views("""
SELECT d.dlq_id, d.replayed_to_job_id, j.status AS replay_status, j.attempt AS replay_attempt
FROM dead_letter_entries d LEFT JOIN jobs j ON j.job_id = d.replayed_to_job_id""", "dead_letter_entries", "jobs"))
def j13(spark, d):
    o = Ops(spark, d)
    return J.replay_lineage(o.dead_letter_entries, o.jobs).select(
        "dlq_id", "replayed_to_job_id", "replay_status", "replay_attempt")


# ---------------------------------------------------------------- A
_STATS_COLS = """CAST(sum(CASE WHEN status = 'QUEUED' THEN 1 ELSE 0 END) AS BIGINT) AS queued,
    CAST(sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS running,
    CAST(sum(CASE WHEN status = 'RETRY_WAIT' THEN 1 ELSE 0 END) AS BIGINT) AS retry_wait,
    CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
    CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CAST(sum(CASE WHEN status = 'SCHEDULED' THEN 1 ELSE 0 END) AS BIGINT) AS scheduled,
    CAST(sum(CASE WHEN status = 'CLAIMED' THEN 1 ELSE 0 END) AS BIGINT) AS claimed"""


@register("a2_batch_queue_stats", with_views(f"""
SELECT j.*, coalesce(d.dlq, 0) AS dlq FROM (SELECT queue_id, {_STATS_COLS} FROM jobs
  WHERE queue_id IN (SELECT queue_id FROM queues WHERE NOT is_paused) GROUP BY queue_id) j
LEFT JOIN (SELECT queue_id, count(*) AS dlq FROM dead_letter_entries GROUP BY queue_id) d ON d.queue_id = j.queue_id""",
    "jobs", "queues", "dead_letter_entries"))
def a2(spark, d):
    o = Ops(spark, d)
    return A.batch_queue_stats(o.jobs, o.dead_letter_entries, Fl.unpaused(o.queues).select("queue_id"))


_SNAP_SQL = """(SELECT q.project_id, j.status, count(*) AS n FROM jobs j JOIN queues q ON q.queue_id = j.queue_id
   JOIN projects p ON p.project_id = q.project_id GROUP BY ALL
 UNION ALL SELECT q.project_id, 'DLQ', count(*) FROM dead_letter_entries d JOIN queues q ON q.queue_id = d.queue_id
   JOIN projects p ON p.project_id = q.project_id GROUP BY ALL)"""


@register("a3_project_snapshot", with_views(f"SELECT * FROM {_SNAP_SQL} s",
                                            "jobs", "queues", "projects", "dead_letter_entries"))
def a3(spark, d):
    o = Ops(spark, d)
    return A.project_snapshot(o.jobs, o.dead_letter_entries, o.queues, o.projects)


@register("a3_snapshot_json", with_views(f"""
SELECT project_id, '{{' || string_agg('"' || status || '":' || CAST(n AS VARCHAR), ',' ORDER BY status) || '}}' AS snapshot
FROM {_SNAP_SQL} s GROUP BY project_id""", "jobs", "queues", "projects", "dead_letter_entries"))
def a3j(spark, d):
    o = Ops(spark, d)
    return A.snapshot_json(A.project_snapshot(o.jobs, o.dead_letter_entries, o.queues, o.projects))


@register("a4_user_metrics", with_views("""
WITH po AS (SELECT p.org_id, count(*) AS total_jobs,
    sum(CASE WHEN status = 'QUEUED' THEN 1 ELSE 0 END) AS queued, sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) AS running,
    sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS completed, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS failed,
    sum(CASE WHEN status = 'RETRY_WAIT' THEN 1 ELSE 0 END) AS retry_wait
  FROM jobs j JOIN queues q ON q.queue_id = j.queue_id JOIN projects p ON p.project_id = q.project_id GROUP BY p.org_id),
pd AS (SELECT p.org_id, count(*) AS dlq FROM dead_letter_entries d JOIN queues q ON q.queue_id = d.queue_id
  JOIN projects p ON p.project_id = q.project_id GROUP BY p.org_id)
SELECT m.user_id, CAST(coalesce(sum(total_jobs), 0) AS BIGINT) AS total_jobs, CAST(coalesce(sum(queued), 0) AS BIGINT) AS queued,
  CAST(coalesce(sum(running), 0) AS BIGINT) AS running, CAST(coalesce(sum(completed), 0) AS BIGINT) AS completed,
  CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed, CAST(coalesce(sum(retry_wait), 0) AS BIGINT) AS retry_wait,
  CAST(coalesce(sum(dlq), 0) AS BIGINT) AS dlq
FROM org_memberships m LEFT JOIN po ON po.org_id = m.org_id LEFT JOIN pd ON pd.org_id = m.org_id GROUP BY m.user_id""",
    "jobs", "queues", "projects", "dead_letter_entries", "org_memberships"))
def a4(spark, d):
    o = Ops(spark, d)
    return A.user_metrics(o.jobs, o.dead_letter_entries, o.queues, o.projects, o.org_memberships)


@register("a5_count_pages_by_queue", with_views("""
SELECT queue_id, count(*) AS total, (count(*) + 19) // 20 AS pages FROM jobs WHERE status = 'FAILED' GROUP BY queue_id""",
    "jobs"))
def a5(spark, d):
    return A.count_by(Fl.filter_jobs(Ops(spark, d).jobs, status="FAILED"), "queue_id", 20)


@register("a5_count_pages_total", with_views("""
SELECT count(*) AS total, CAST(20 AS BIGINT) AS page_size, (count(*) + 19) // 20 AS pages FROM jobs
WHERE status = 'QUEUED' AND priority >= 5""", "jobs"))
def a5t(spark, d):
    return A.count_pages(Fl.filter_jobs(Ops(spark, d).jobs, status="QUEUED", priority_min=5), 20)


def _access_requests(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.expr("o_orderkey div 10").alias("request_id"),
                    F.expr("(o_orderkey div 10) % 100").alias("user_id"), F.col("o_custkey").alias("queue_id"))


@register("a6_can_access_all", with_views("""
WITH r AS (SELECT DISTINCT o_orderkey // 10 AS request_id, (o_orderkey // 10) % 100 AS user_id, o_custkey AS queue_id FROM orders),
v AS (SELECT r.request_id, count(*) AS visible FROM r JOIN queues q ON q.queue_id = r.queue_id
  JOIN projects p ON p.project_id = q.project_id JOIN org_memberships m ON m.org_id = p.org_id AND m.user_id = r.user_id
  GROUP BY r.request_id)
SELECT w.request_id, w.user_id, w.requested, coalesce(v.visible, 0) AS visible, coalesce(v.visible, 0) = w.requested AS all_visible
FROM (SELECT request_id, user_id, count(*) AS requested FROM r GROUP BY ALL) w LEFT JOIN v ON v.request_id = w.request_id""",
    "queues", "projects", "org_memberships"))
def a6(spark, d):
    o = Ops(spark, d)
    return A.can_access_all(_access_requests(spark, d), o.queues, o.projects, o.org_memberships)


@register("a7_batch_progress", with_views("""
SELECT b.batch_id, b.total_jobs, coalesce(c, 0) AS completed_jobs, coalesce(f, 0) AS failed_jobs,
  CASE WHEN coalesce(c, 0) + coalesce(f, 0) >= b.total_jobs AND coalesce(f, 0) = 0 THEN 'COMPLETED'
       WHEN coalesce(c, 0) + coalesce(f, 0) >= b.total_jobs AND coalesce(c, 0) = 0 THEN 'FAILED'
       WHEN coalesce(c, 0) + coalesce(f, 0) >= b.total_jobs OR coalesce(f, 0) > 0 THEN 'PARTIALLY_COMPLETED'
       WHEN coalesce(c, 0) > 0 THEN 'RUNNING' ELSE 'QUEUED' END AS status
FROM batches b LEFT JOIN (SELECT batch_id, CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS c,
  CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM jobs GROUP BY batch_id) g ON g.batch_id = b.batch_id""",
    "batches", "jobs"))
def a7(spark, d):
    o = Ops(spark, d)
    return A.batch_progress(o.batches, o.jobs)


@register("a8_capacity_usage", with_views("""
SELECT q.queue_id, q.max_concurrency, coalesce(r.n, 0) AS running, greatest(q.max_concurrency - coalesce(r.n, 0), 0) AS free_slots,
  CAST(least(100, round(coalesce(r.n, 0) / greatest(q.max_concurrency, 1) * 100)) AS BIGINT) AS pct_used
FROM queues q LEFT JOIN (SELECT queue_id, count(*) AS n FROM jobs WHERE status IN ('CLAIMED', 'RUNNING') GROUP BY queue_id) r
  ON r.queue_id = q.queue_id""", "queues", "jobs"))
def a8(spark, d):
    o = Ops(spark, d)
    return A.capacity_usage(o.queues, o.jobs)


@register("a9_running_per_worker", with_views("""
SELECT lease_owner AS worker_id, count(*) AS running_jobs FROM jobs WHERE status = 'RUNNING' AND lease_owner IS NOT NULL
GROUP BY lease_owner""", "jobs"))
def a9(spark, d):
    return A.running_per_worker(Ops(spark, d).jobs)


_TREND_SQL = """count(duration_ms) AS n, round(avg(duration_ms), 2) AS avg, round(min(duration_ms), 2) AS min,
  round(quantile_cont(duration_ms, 0.5), 2) AS med, round(max(duration_ms), 2) AS max,
  round(quantile_cont(duration_ms, 0.9), 2) AS p90, round(quantile_cont(duration_ms, 0.95), 2) AS p95,
  round(quantile_cont(duration_ms, 0.99), 2) AS p99"""


@register("a10_duration_trend", with_views(f"""
SELECT status, {_TREND_SQL.replace('duration_ms', 'CAST(duration_ms AS DOUBLE)')} FROM executions GROUP BY status""",
    "executions"))
def a10(spark, d):
    return A.trend(Ops(spark, d).execution_facts, "duration_ms", ["status"])


@register("a11_worker_slo", with_views("""
SELECT worker_id, count(duration_ms) AS n, round(avg(CASE WHEN status = 'COMPLETED' THEN 1.0 ELSE 0.0 END), 4) AS success_rate,
  round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 2) AS p95, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.99), 2) AS p99,
  round(avg(CASE WHEN status = 'COMPLETED' THEN 1.0 ELSE 0.0 END), 4) > 0.99 AS rate_ok,
  round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 2) < 100000.0 AS p95_ok,
  round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.99), 2) < 100000.0 AS p99_ok
FROM executions GROUP BY worker_id""", "executions"))
def a11(spark, d):
    e = Ops(spark, d).execution_facts.withColumn("ok", F.col("status") == "COMPLETED")
    return A.slo(e, "duration_ms", "ok", ["worker_id"], 0.99, 100000.0, 100000.0)


@register("a12_attempt_summary", with_views("""
SELECT job_id, count(*) AS attempts,
  CAST(sum(CASE WHEN status = 'STARTED' THEN 1 ELSE 0 END) AS BIGINT) AS started,
  CAST(sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
  CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN status = 'ABANDONED' THEN 1 ELSE 0 END) AS BIGINT) AS abandoned,
  arg_max(status, (started_at, attempt, execution_id)) AS last_status,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_duration_ms
FROM executions GROUP BY job_id""", "executions"))
def a12(spark, d):
    return A.attempt_summary(Ops(spark, d).executions)


@register("a13_dlq_rollup", with_views("""
SELECT queue_id, error_kind, reason, count(*) AS entries,
  CAST(sum(CASE WHEN replayed_to_job_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS replayed,
  round(avg(CASE WHEN replayed_to_job_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS replayed_share
FROM dead_letter_entries GROUP BY ALL""", "dead_letter_entries"))
def a13(spark, d):
    return A.dlq_rollup(Ops(spark, d).dead_letter_entries)


# ---------------------------------------------------------------- W
@register("w1_latest_logs", with_views("""
SELECT log_id, job_id, created_at, rn FROM (SELECT log_id, job_id, created_at,
  row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, log_id DESC) AS rn FROM job_logs) x WHERE rn <= 3""",
    "job_logs"))
def w1(spark, d):
    return W.latest_logs(Ops(spark, d).job_logs, 3).select("log_id", "job_id", "created_at", "rn")


@register("w2_dispatch_rank", with_views("""
SELECT job_id, queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY priority DESC, created_at, job_id) AS dispatch_rank
FROM jobs WHERE status = 'QUEUED'""", "jobs"))
def w2(spark, d):
    return W.dispatch_rank(Ops(spark, d).jobs).select("job_id", "queue_id", "dispatch_rank")


_CLAIMS_SQL = f"""live AS (SELECT queue_id FROM queues WHERE NOT is_paused),
c AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY priority DESC, created_at, job_id) AS rk FROM jobs
  WHERE status IN ('QUEUED', 'RETRY_WAIT') AND (lease_expires_at IS NULL OR lease_expires_at < {NOW_SQL})
    AND queue_id IN (SELECT queue_id FROM live)),
f AS (SELECT queue_id, slot_index, row_number() OVER (PARTITION BY queue_id ORDER BY slot_index) AS rk FROM capacity_tokens
  WHERE worker_id IS NULL AND job_id IS NULL AND queue_id IN (SELECT queue_id FROM live)),
m AS (SELECT c.*, f.slot_index FROM c JOIN f ON f.queue_id = c.queue_id AND f.rk = c.rk)"""


@register("w3_allocate_tokens", with_views(f"""
WITH {_CLAIMS_SQL}
SELECT t.queue_id, t.slot_index, coalesce(m.job_id, t.job_id) AS job_id,
  CASE WHEN m.job_id IS NOT NULL THEN 7 ELSE t.worker_id END AS worker_id,
  t.epoch + CASE WHEN m.job_id IS NOT NULL THEN 1 ELSE 0 END AS epoch,
  CASE WHEN m.job_id IS NOT NULL THEN {NOW_SQL} + INTERVAL 30 SECOND ELSE t.lease_until END AS lease_until
FROM capacity_tokens t LEFT JOIN m ON m.queue_id = t.queue_id AND m.slot_index = t.slot_index""",
    "queues", "jobs", "capacity_tokens"))
def w3t(spark, d):
    o = Ops(spark, d)
    return W.allocate(o.queues, o.capacity_tokens, o.jobs, JOBS_NOW, worker_id=7)[1].select(
        "queue_id", "slot_index", "job_id", "worker_id", "epoch", "lease_until")


@register("w3_allocate_executions", with_views(f"""
WITH {_CLAIMS_SQL}
SELECT sha256('exec:' || CAST(job_id AS VARCHAR) || ':' || CAST(attempt + 1 AS VARCHAR)) AS execution_id, job_id,
  CAST(7 AS BIGINT) AS worker_id, attempt + 1 AS attempt, lease_epoch + 1 AS lease_epoch, 'STARTED' AS status,
  {NOW_SQL} AS started_at FROM m""", "queues", "jobs", "capacity_tokens"))
def w3e(spark, d):
    o = Ops(spark, d)
    return W.allocate(o.queues, o.capacity_tokens, o.jobs, JOBS_NOW, worker_id=7)[2]


@register("j8_renewed_tokens", with_views(f"""
SELECT t.queue_id, t.slot_index, {NOW_SQL} + INTERVAL 30 SECOND AS lease_until FROM capacity_tokens t
JOIN jobs j ON j.job_id = t.job_id AND j.lease_owner = t.worker_id AND j.status = 'RUNNING' AND j.job_id % 3 <> 0""",
    "jobs", "capacity_tokens"))
def j8t(spark, d):
    o = Ops(spark, d)
    _, tokens, ok = J.apply_renewals(o.jobs, o.capacity_tokens, _renewals(o), JOBS_NOW)
    return tokens.join(ok.select("job_id"), "job_id", "left_semi").select("queue_id", "slot_index", "lease_until")


@register("w3_allocate_claims", with_views(f"""
WITH live AS (SELECT queue_id FROM queues WHERE NOT is_paused),
c AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY priority DESC, created_at, job_id) AS rk FROM jobs
  WHERE status IN ('QUEUED', 'RETRY_WAIT') AND (lease_expires_at IS NULL OR lease_expires_at < {NOW_SQL})
    AND queue_id IN (SELECT queue_id FROM live)),
f AS (SELECT queue_id, slot_index, row_number() OVER (PARTITION BY queue_id ORDER BY slot_index) AS rk FROM capacity_tokens
  WHERE worker_id IS NULL AND job_id IS NULL AND queue_id IN (SELECT queue_id FROM live))
SELECT c.job_id, c.queue_id, f.slot_index, 'CLAIMED' AS status, c.attempt + 1 AS attempt, c.lease_epoch + 1 AS lease_epoch,
  CAST(7 AS BIGINT) AS lease_owner, {NOW_SQL} + INTERVAL 30 SECOND AS lease_expires_at
FROM c JOIN f ON f.queue_id = c.queue_id AND f.rk = c.rk""", "queues", "jobs", "capacity_tokens"))
def w3(spark, d):
    o = Ops(spark, d)
    claimed, _, _ = W.allocate(o.queues, o.capacity_tokens, o.jobs, JOBS_NOW, worker_id=7)
    return claimed.select("job_id", "queue_id", "slot_index", "status", "attempt", "lease_epoch",
                          "lease_owner", "lease_expires_at")


@register("w4_offered_load", with_views("""
SELECT arrival_id, queue_id, event_ts, offered, offered > 3 AS over_limit FROM (SELECT arrival_id, queue_id, event_ts,
  count(*) OVER (PARTITION BY queue_id ORDER BY event_ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS offered
  FROM arrivals) x""", "arrivals"))
def w4(spark, d):
    return W.offered_load(Ops(spark, d).arrivals, 3600, 3)


_MATRIX_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DECLARED_TRANSITIONS) + ") m(from_status, to_status)"


@register("w5_audit_transitions", with_views(f"""
SELECT x.event_id, x.job_id, x.event_ts, x.from_status, x.status,
  CASE WHEN x.from_status IS NULL THEN x.status IN ('QUEUED', 'SCHEDULED', 'WAITING') ELSE m.to_status IS NOT NULL END AS allowed
FROM (SELECT event_id, job_id, event_ts, status, lag(status) OVER (PARTITION BY job_id ORDER BY event_ts, event_id) AS from_status
  FROM status_events) x LEFT JOIN {_MATRIX_SQL} ON m.from_status = x.from_status AND m.to_status = x.status""",
    "status_events"))
def w5(spark, d):
    o = Ops(spark, d)
    ev = o.status_events.select("event_id", "job_id", "event_ts", "status")
    return W.audit_transitions(ev, W.transition_matrix(spark)).select(
        "event_id", "job_id", "event_ts", "from_status", "status", "allowed")


@register("w6_lease_epochs", with_views("""
SELECT event_id, job_id, worker_id, event_ts, epoch, prev_owner, coalesce(prev_owner <> worker_id, false) AS takeover FROM (
  SELECT event_id, job_id, worker_id, event_ts, row_number() OVER w AS epoch, lag(worker_id) OVER w AS prev_owner
  FROM lease_events WHERE kind = 'claim' WINDOW w AS (PARTITION BY job_id ORDER BY event_ts, event_id)) x""", "lease_events"))
def w6(spark, d):
    c = Ops(spark, d).lease_events.filter(F.col("kind") == "claim").select("event_id", "job_id", "worker_id", "event_ts")
    return W.lease_epochs(c)


@register("w7_latest_heartbeat", with_views("""
SELECT worker_id, heartbeat_id, heartbeat_at, running_jobs FROM (SELECT *,
  row_number() OVER (PARTITION BY worker_id ORDER BY heartbeat_at DESC, heartbeat_id DESC) AS rn FROM worker_heartbeats) x
WHERE rn = 1""", "worker_heartbeats"))
def w7(spark, d):
    return W.latest_by(Ops(spark, d).worker_heartbeats, "worker_id", "heartbeat_at", "heartbeat_id")


# ---------------------------------------------------------------- L
@register("l1_page_failed_jobs", with_views("""
SELECT job_id, queue_id, created_at FROM jobs WHERE status = 'FAILED' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40""",
    "jobs"))
def l1(spark, d):
    j = Fl.filter_jobs(Ops(spark, d).jobs, status="FAILED").select("job_id", "queue_id", "created_at")
    return W.page(j, W.LISTING_ORDERS["jobs"], 3, 20)


@register("l2_dlq_listing", with_views("""
SELECT dlq_id, queue_id, moved_at, row_number() OVER (PARTITION BY queue_id ORDER BY moved_at DESC, dlq_id) AS position
FROM dead_letter_entries""", "dead_letter_entries"))
def l2(spark, d):
    dl = Ops(spark, d).dead_letter_entries.select("dlq_id", "queue_id", "moved_at")
    return W.listing_ranked(dl, W.LISTING_ORDERS["dead_letter_entries"], "queue_id")


@register("l4_outbox_batch", with_views(f"""
SELECT event_id, job_id, priority, created_at, 'relay-9' AS relay_owner_id, {NOW_SQL} + INTERVAL 30 SECOND AS relay_locked_until
FROM outbox_events WHERE published_at IS NULL AND (relay_locked_until IS NULL OR relay_locked_until < {NOW_SQL})
ORDER BY priority DESC, created_at, event_id LIMIT 100""", "outbox_events"))
def l4(spark, d):
    ob = Ops(spark, d).outbox_events
    return W.outbox_batch(ob, "relay-9", JOBS_NOW).select(
        "event_id", "job_id", "priority", "created_at", "relay_owner_id", "relay_locked_until")


@register("l5_pending_summaries", with_views("""
SELECT dlq_id, error_kind, final_error, attempt, moved_at,
  format('Summarize this failed background job for an operator. Do not invent facts. Return JSON only with summary, root_cause, remediation. Error kind: {}. Final error: {}. Attempts: {}.',
    coalesce(error_kind, 'unknown'), coalesce(final_error, 'no error message recorded'), CAST(attempt AS VARCHAR)) AS prompt
FROM dead_letter_entries d WHERE NOT EXISTS (SELECT 1 FROM failure_summaries s WHERE s.dlq_id = d.dlq_id)
ORDER BY moved_at, dlq_id LIMIT 5""", "dead_letter_entries", "failure_summaries"))
def l5(spark, d):
    o = Ops(spark, d)
    return W.pending_summaries(o.dead_letter_entries, o.failure_summaries).select(
        "dlq_id", "error_kind", "final_error", "attempt", "moved_at", "prompt")


# ---------------------------------------------------------------- U
@register("u1_union_counts", with_views("""
SELECT 'jobs' AS source, status AS label, count(*) AS n FROM jobs GROUP BY status
UNION ALL SELECT 'dead_letter_entries', reason, count(*) FROM dead_letter_entries GROUP BY reason""",
    "jobs", "dead_letter_entries"))
def u1(spark, d):
    o = Ops(spark, d)
    a = o.jobs.groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("source", F.lit("jobs"))
    b = o.dead_letter_entries.groupBy(F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("source", F.lit("dead_letter_entries"))
    return U.union_counts(a, b)


@register("u2_insert_ignore_satisfaction", with_views("""
WITH done AS (SELECT e.parent_id, e.child_id FROM workflow_edges e JOIN jobs j ON j.job_id = e.parent_id WHERE j.status = 'COMPLETED')
SELECT DISTINCT parent_id, child_id FROM done d WHERE NOT EXISTS
  (SELECT 1 FROM done t WHERE t.child_id % 2 = 0 AND t.parent_id = d.parent_id AND t.child_id = d.child_id)""",
    "workflow_edges", "jobs"))
def u2(spark, d):
    o = Ops(spark, d)
    done = o.workflow_edges.join(o.jobs.filter(F.col("status") == "COMPLETED")
                                 .select(F.col("job_id").alias("parent_id")), "parent_id", "left_semi")
    existing = done.filter(F.col("child_id") % 2 == 0)  # satisfaction rows already present
    _, inserted = U.insert_ignore(existing, done, ["parent_id", "child_id"])
    return inserted


@register("u3_upsert_workers", with_views("""
WITH n AS (SELECT worker_id, arg_max(started_at, (started_at, execution_id)) AS last_heartbeat_at FROM executions GROUP BY worker_id)
SELECT coalesce(w.worker_id, n.worker_id) AS worker_id, w.worker_name, w.max_concurrency, w.started_at,
  CASE WHEN n.worker_id IS NOT NULL THEN n.last_heartbeat_at ELSE w.last_heartbeat_at END AS last_heartbeat_at
FROM workers w FULL OUTER JOIN n ON n.worker_id = w.worker_id""", "workers", "executions"))
def u3(spark, d):
    o = Ops(spark, d)
    new = o.executions.select("worker_id", F.col("started_at").alias("last_heartbeat_at"), "execution_id")
    return U.upsert(o.workers, new, "worker_id", ["last_heartbeat_at", "execution_id"], ["last_heartbeat_at"])


_U4_SQL = """WITH k AS (SELECT job_id, queue_id, idempotency_key,
    first_value(job_id) OVER (PARTITION BY queue_id, idempotency_key ORDER BY created_at, job_id) AS w
  FROM jobs WHERE idempotency_key IS NOT NULL)"""


@register("u4_idempotency_conflicts", with_views(_U4_SQL + """
SELECT job_id, queue_id, idempotency_key, w AS conflicts_with FROM k WHERE job_id <> w""", "jobs"))
def u4c(spark, d):
    _, conflicts = U.idempotency_split(Ops(spark, d).jobs)
    return conflicts.select("job_id", "queue_id", "idempotency_key", "conflicts_with")


@register("u4_idempotency_accepted", with_views(_U4_SQL + """
SELECT job_id, queue_id, idempotency_key FROM k WHERE job_id = w
UNION ALL SELECT job_id, queue_id, idempotency_key FROM jobs WHERE idempotency_key IS NULL""", "jobs"))
def u4a(spark, d):
    accepted, _ = U.idempotency_split(Ops(spark, d).jobs)
    return accepted.select("job_id", "queue_id", "idempotency_key")


@register("u5_patch_queue_config", with_views("""
SELECT q.queue_id, coalesce(p.max_concurrency, q.max_concurrency) AS max_concurrency,
  coalesce(p.default_priority, q.default_priority) AS default_priority, q.is_paused, q.shard_count
FROM queues q LEFT JOIN (SELECT c_custkey AS queue_id,
    CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) % 100 + 1 END AS max_concurrency,
    CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(9 AS BIGINT) END AS default_priority FROM customer) p
  ON p.queue_id = q.queue_id""", "queues"))
def u5(spark, d):
    o = Ops(spark, d)
    c = read(spark, d, "customer")
    patches = c.select(F.col("c_custkey").alias("queue_id"),
                       F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("long") % 100 + 1).alias("max_concurrency"),
                       F.when(F.col("c_mktsegment") == "BUILDING", F.lit(9).cast("long")).alias("default_priority"))
    q = o.queues.select("queue_id", "max_concurrency", "default_priority", "is_paused", "shard_count")
    return U.patch(q, patches, "queue_id", "coalesce")


@register("u6_delete_published_outbox", with_views("""
SELECT event_id, job_id FROM outbox_events o WHERE NOT EXISTS (SELECT 1 FROM outbox_events k
  WHERE k.published_at IS NOT NULL AND k.relay_owner_id IS NOT NULL AND k.event_id = o.event_id AND k.relay_owner_id = o.relay_owner_id)""",
    "outbox_events"))
def u6(spark, d):
    ob = Ops(spark, d).outbox_events
    keys = ob.filter(F.col("published_at").isNotNull() & F.col("relay_owner_id").isNotNull()) \
        .select("event_id", "relay_owner_id")
    return U.delete_matching(ob, keys, ["event_id", "relay_owner_id"]).select("event_id", "job_id")


@register("u7_resync_slots", with_views("""
WITH nq AS (SELECT queue_id, queue_id % 5 + 1 AS max_concurrency FROM queues)
SELECT t.queue_id, t.slot_index, t.worker_id, t.job_id FROM capacity_tokens t LEFT JOIN nq ON nq.queue_id = t.queue_id
  WHERE t.slot_index < coalesce(nq.max_concurrency, 0) OR t.worker_id IS NOT NULL OR t.job_id IS NOT NULL
UNION ALL
SELECT s.queue_id, s.slot_index, NULL, NULL FROM (SELECT queue_id, CAST(unnest(range(0, max_concurrency)) AS BIGINT) AS slot_index FROM nq) s
  WHERE NOT EXISTS (SELECT 1 FROM capacity_tokens t WHERE t.queue_id = s.queue_id AND t.slot_index = s.slot_index)""",
    "capacity_tokens", "queues"))
def u7(spark, d):
    o = Ops(spark, d)
    nq = o.queues.select("queue_id", (F.col("queue_id") % 5 + 1).alias("max_concurrency"))
    return U.resync_slots(o.capacity_tokens, nq).select("queue_id", "slot_index", "worker_id", "job_id")


# ---------------------------------------------------------------- per-queue limits
def _job_arrivals(o):
    return o.jobs.select(F.col("job_id").alias("arrival_id"), "queue_id", F.col("created_at").alias("event_ts"))


@register("w4_offered_load_queues", with_views("""
SELECT arrival_id, queue_id, event_ts, offered, coalesce(offered > rate_limit, false) AS over_limit FROM (
  SELECT j.job_id AS arrival_id, j.queue_id, j.created_at AS event_ts, q.rate_limit,
    count(*) OVER (PARTITION BY j.queue_id ORDER BY j.created_at RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)
      AS offered
  FROM jobs j JOIN queues q ON q.queue_id = j.queue_id) x""", "jobs", "queues"))
def w4q(spark, d):
    """Offered load per real queue with each queue's own window and limit."""
    o = Ops(spark, d)
    return W.offered_load(_job_arrivals(o), queues=o.queues)


@register("a2_batch_queue_stats_reference", with_views(f"""
SELECT queue_id, {_STATS_COLS}, CAST(0 AS BIGINT) AS dlq FROM jobs
WHERE queue_id IN (SELECT queue_id FROM queues WHERE NOT is_paused) GROUP BY queue_id""", "jobs", "queues"))
def a2ref(spark, d):
    """A2 with the reference's constant dlq = 0 (parity flag)."""
    o = Ops(spark, d)
    return A.batch_queue_stats(o.jobs, o.dead_letter_entries, Fl.unpaused(o.queues).select("queue_id"), dlq_zero=True)


@register("u5_patch_overwrite", with_views("""
SELECT q.queue_id, CASE WHEN p.queue_id IS NOT NULL THEN p.rate_limit ELSE q.rate_limit END AS rate_limit, q.max_concurrency
FROM queues q LEFT JOIN (SELECT c_custkey AS queue_id,
    CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal / 1000) AS BIGINT) END AS rate_limit
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) p ON p.queue_id = q.queue_id""", "queues"))
def u5o(spark, d):
    """Overwrite mode: a matched NULL clears the value (as next_fire_at updates do)."""
    o = Ops(spark, d)
    c = read(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    patches = c.select(F.col("c_custkey").alias("queue_id"),
                       F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") / 1000).cast("long")).alias("rate_limit"))
    return U.patch(o.queues.select("queue_id", "rate_limit", "max_concurrency"), patches, "queue_id", "overwrite")


@register("j2_visible_dlq_counts", with_views("""
SELECT m.user_id, d.queue_id, count(*) AS entries FROM dead_letter_entries d JOIN queues q ON q.queue_id = d.queue_id
  JOIN projects p ON p.project_id = q.project_id JOIN org_memberships m ON m.org_id = p.org_id
GROUP BY m.user_id, d.queue_id""", "dead_letter_entries", "queues", "projects", "org_memberships"))
def j2d(spark, d):
    """DLQ rows visible to each user (membership-scoped), counted per queue."""
    o = Ops(spark, d)
    return J.visible_counts(o.dead_letter_entries, o.queues, o.projects, o.org_memberships)


_VISIBLE_SQL = """JOIN queues q ON q.queue_id = x.queue_id JOIN projects p ON p.project_id = q.project_id
  JOIN org_memberships m ON m.org_id = p.org_id"""


@register("j2_visible_failed_jobs", with_views(f"""
SELECT m.user_id, x.job_id, x.queue_id, p.org_id FROM (SELECT * FROM jobs WHERE status = 'FAILED') x {_VISIBLE_SQL}""",
    "jobs", "queues", "projects", "org_memberships"))
def j2j(spark, d):
    o = Ops(spark, d)
    failed = o.jobs.filter("status = 'FAILED'").select("job_id", "queue_id")
    return J.visible_to(failed, o.queues, o.projects, o.org_memberships).select("user_id", "job_id", "queue_id", "org_id")


@register("j2_visible_schedules", with_views(f"""
SELECT m.user_id, x.schedule_id, x.queue_id, x.cron_expr FROM scheduled_jobs x {_VISIBLE_SQL}""",
    "scheduled_jobs", "queues", "projects", "org_memberships"))
def j2s(spark, d):
    o = Ops(spark, d)
    s = o.scheduled_jobs.select("schedule_id", "queue_id", "cron_expr")
    return J.visible_to(s, o.queues, o.projects, o.org_memberships).select("user_id", "schedule_id", "queue_id", "cron_expr")


@register("j2_visible_queues", with_views(f"""
SELECT m.user_id, q.queue_id, p.project_id, p.org_id FROM queues x {_VISIBLE_SQL}""", "queues", "projects", "org_memberships"))
def j2q(spark, d):
    o = Ops(spark, d)
    return J.visible_to(o.queues.select("queue_id"), o.queues, o.projects, o.org_memberships) \
        .select("user_id", "queue_id", "project_id", "org_id")


@register("s1_stored_jobs", with_views("""
SELECT j.job_id, j.status, j.priority, q.max_concurrency FROM jobs j JOIN queues q ON q.queue_id = j.queue_id""", "jobs", "queues"))
def s1s(spark, d):
    """Tables stored as typed folders and read back with their declared schemas."""
    import uuid
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    save_ops(Ops(spark, d), path, ["jobs", "queues"])
    t = load_ops(spark, path)
    return t.jobs.join(t.queues, "queue_id").select("job_id", "status", "priority", "max_concurrency")
