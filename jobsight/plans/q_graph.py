"""Registered queries for the cron calendar (C2–C4, L3) and the workflow DAG (D1–D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import derived_id_sql
from ..operators import cron as C
from ..operators import dag as D
from ..operators.windows import due_schedules
from ..sources.fixtures import JOBS_NOW, Ops, read, with_views
from .registry import register

WIN = ("2024-02-29 12:00:00", "2024-03-02 12:00:00")
ADV_NOW = "2024-03-09 12:00:00"
FIRE_NOW = "2024-03-09 12:30:00"

# The oracle knows the fixture's fixed crons and zones: each cron as a rule on
# 15-minute local candidates, each valid zone by name.
_VALID_ZONES = "('UTC', 'Asia/Kolkata', 'America/New_York')"
_CRON_RULES = """((cron_expr = '0 0 * * * *' AND minute(t) = 0)
   OR (cron_expr = '0 */15 * * * *')
   OR (cron_expr = '0 30 9 * * *' AND hour(t) = 9 AND minute(t) = 30)
   OR (cron_expr = '0 0 0 1 * *' AND day(t) = 1 AND hour(t) = 0 AND minute(t) = 0))"""


def _fires_sql(from_day: str, to_day: str, active_only: bool) -> str:
    act = "is_active AND " if active_only else ""
    return f"""(SELECT schedule_id, queue_id, priority, payload, timezone('UTC', timezone(tz, t)) AS fire_time FROM (
    SELECT schedule_id, queue_id, priority, payload, timezone AS tz, cron_expr, t FROM scheduled_jobs,
      generate_series(TIMESTAMP '{from_day}', TIMESTAMP '{to_day}', INTERVAL 15 MINUTE) g(t)
    WHERE {act}timezone IN {_VALID_ZONES} AND cron_expr <> 'not a cron') c WHERE {_CRON_RULES})"""


@register("c2_cron_occurrences", with_views(f"""
SELECT schedule_id, fire_time, CAST(schedule_id AS VARCHAR) || ':' || strftime(fire_time, '%Y-%m-%d %H:%M:%S') || ' UTC'
  AS occurrence_key
FROM {_fires_sql('2024-02-27 00:00:00', '2024-03-04 00:00:00', True)} f
WHERE fire_time >= TIMESTAMP '{WIN[0]}' AND fire_time < TIMESTAMP '{WIN[1]}'""", "scheduled_jobs"))
def c2(spark, d):
    s = Ops(spark, d).scheduled_jobs.filter("is_active")
    return C.occurrences(s, *WIN)[0]


@register("c2_cron_rejects", with_views(f"""
SELECT schedule_id, CASE WHEN cron_expr = 'not a cron' THEN 'bad_cron' ELSE 'bad_timezone' END AS reason
FROM scheduled_jobs WHERE is_active AND (cron_expr = 'not a cron' OR timezone NOT IN {_VALID_ZONES})""", "scheduled_jobs"))
def c2r(spark, d):
    s = Ops(spark, d).scheduled_jobs.filter("is_active")
    return C.occurrences(s, *WIN)[1]


_NEXT_SQL = f"""(SELECT s.schedule_id, s.queue_id, s.priority, s.payload,
    (s.is_active AND n.next_fire_at IS NOT NULL) AS is_active,
    CASE WHEN s.is_active THEN n.next_fire_at END AS next_fire_at
  FROM scheduled_jobs s LEFT JOIN (SELECT schedule_id, min(fire_time) AS next_fire_at
    FROM {_fires_sql('2024-03-08 00:00:00', '2024-04-03 00:00:00', False)} f
    WHERE fire_time > TIMESTAMP '{ADV_NOW}' GROUP BY schedule_id) n ON n.schedule_id = s.schedule_id)"""


def _advanced(spark, d):
    return C.advance(Ops(spark, d).scheduled_jobs, ADV_NOW)


@register("c3_next_fire", with_views(f"SELECT schedule_id, is_active, next_fire_at FROM {_NEXT_SQL} x", "scheduled_jobs"))
def c3(spark, d):
    return _advanced(spark, d).select("schedule_id", "is_active", "next_fire_at")


@register("l3_due_schedules", with_views(f"""
SELECT schedule_id, next_fire_at FROM {_NEXT_SQL} x WHERE is_active AND next_fire_at <= TIMESTAMP '{FIRE_NOW}'
ORDER BY next_fire_at, schedule_id LIMIT 100""", "scheduled_jobs"))
def l3(spark, d):
    return due_schedules(_advanced(spark, d), FIRE_NOW, 100).select("schedule_id", "next_fire_at")


@register("c4_fire_jobs", with_views(f"""
SELECT {derived_id_sql("'cron'", "x.schedule_id", "CAST(x.next_fire_at AS VARCHAR)")} AS job_id, x.queue_id,
  x.schedule_id AS scheduled_job_id, x.next_fire_at AS fire_time, x.next_fire_at AS scheduled_for,
  coalesce(q.max_receives, 3) AS max_attempts, x.priority, 'recurring' AS kind, 'QUEUED' AS status
FROM {_NEXT_SQL} x JOIN queues q ON q.queue_id = x.queue_id
WHERE x.is_active AND x.next_fire_at <= TIMESTAMP '{FIRE_NOW}'""", "scheduled_jobs", "queues"))
def c4(spark, d):
    o = Ops(spark, d)
    empty = spark.createDataFrame([], "schedule_id long, fire_time timestamp_ntz")
    jobs, _, _, _ = C.fire(_advanced(spark, d), empty, o.queues, o.projects, FIRE_NOW)
    return jobs.select("job_id", "queue_id", "scheduled_job_id", "fire_time", "scheduled_for", "max_attempts",
                       "priority", "kind", "status")


# ---------------------------------------------------------------- D
def _wf_requests(spark, d):
    o = read(spark, d, "orders")
    item = F.struct(F.col("o_orderkey").alias("k"),
                    F.concat(F.lit('{"type":"echo","n":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
                    ((F.col("o_orderkey") % 3) * 5).alias("priority"))
    g = (o.groupBy(F.expr("o_orderkey div 10").alias("workflow_request_id"))  # 10 jobs per workflow
          .agg(F.min_by("o_custkey", "o_orderkey").alias("queue_id"), F.sort_array(F.collect_list(item)).alias("jobs")))
    n = F.size("jobs")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda i: F.struct((i - 1).alias("parent"), i.alias("child")))
    chain = F.filter(chain, lambda e: e["child"] < n)
    selfloop = F.when(F.col("workflow_request_id") % 7 == 0,
                      F.array(F.struct(F.lit(0).alias("parent"), F.lit(0).alias("child"))))
    none = F.array().cast("array<struct<parent:int,child:int>>")
    return g.withColumn("edges", F.concat(chain, F.coalesce(selfloop, none)))


@register("d1_workflow_jobs", with_views(f"""
SELECT {derived_id_sql("'wfjob'", "o_orderkey // 10", "pos")} AS job_id, {derived_id_sql("'workflow'", "o_orderkey // 10")}
  AS workflow_id, CAST(pos AS BIGINT) AS position, CASE WHEN pos = 0 THEN 'QUEUED' ELSE 'WAITING' END AS status
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) - 1 AS pos FROM orders) x
WHERE (o_orderkey // 10) % 7 <> 0""", "queues"))
def d1(spark, d):
    o = Ops(spark, d)
    jobs, _, _, _ = D.create_workflows(_wf_requests(spark, d), o.queues, o.projects, JOBS_NOW)
    return jobs.select("job_id", "workflow_id", "position", "status")


@register("d1_workflow_rejects", with_views("""
SELECT DISTINCT o_orderkey // 10 AS workflow_request_id, 'invalid_edges' AS reason FROM orders WHERE (o_orderkey // 10) % 7 = 0""",
    "queues"))
def d1r(spark, d):
    o = Ops(spark, d)
    return D.create_workflows(_wf_requests(spark, d), o.queues, o.projects, JOBS_NOW)[3]


@register("d2_ready_children", with_views("""
SELECT j.job_id, j.workflow_id FROM jobs j WHERE j.status = 'WAITING' AND j.job_id IN (
  SELECT e.child_id FROM workflow_edges e LEFT JOIN jobs p ON p.job_id = e.parent_id
  GROUP BY e.child_id HAVING bool_and(coalesce(p.status = 'COMPLETED', false)))""", "jobs", "workflow_edges"))
def d2(spark, d):
    o = Ops(spark, d)
    return D.ready_children(o.jobs, o.workflow_edges).select("job_id", "workflow_id")


def _release(spark, d):
    o = Ops(spark, d)
    empty = spark.createDataFrame([], "parent_id long, child_id long")
    return D.release(o.jobs, o.workflow_edges, empty, o.queues, o.projects, JOBS_NOW)


@register("d3_release_jobs", with_views(f"""
SELECT job_id, 'QUEUED' AS status, TIMESTAMP '{JOBS_NOW}' AS queued_at FROM jobs WHERE status = 'WAITING' AND job_id IN (
  SELECT e.child_id FROM workflow_edges e LEFT JOIN jobs p ON p.job_id = e.parent_id AND p.status = 'COMPLETED'
  GROUP BY e.child_id HAVING count(DISTINCT e.parent_id) = count(DISTINCT p.job_id))""", "jobs", "workflow_edges"))
def d3(spark, d):
    return _release(spark, d)[1].select("job_id", "status", "queued_at")


@register("d3_satisfaction", with_views("""
SELECT DISTINCT e.parent_id, e.child_id FROM workflow_edges e JOIN jobs p ON p.job_id = e.parent_id WHERE p.status = 'COMPLETED'""",
    "jobs", "workflow_edges"))
def d3s(spark, d):
    return _release(spark, d)[0]


_REACH = """WITH RECURSIVE reach(a, b) AS (SELECT parent_id, child_id FROM cyclic_edges
  UNION SELECT r.a, e.child_id FROM reach r JOIN cyclic_edges e ON e.parent_id = r.b),
cyc AS (SELECT DISTINCT a AS v FROM reach WHERE a = b),
down AS (SELECT v FROM cyc UNION SELECT r.b FROM reach r JOIN cyc c ON r.a = c.v),
up AS (SELECT v FROM cyc UNION SELECT r.a FROM reach r JOIN cyc c ON r.b = c.v)"""


@register("d4_cycles", with_views(_REACH + """
SELECT v AS node_id, 'cycle_or_downstream' AS kind FROM down
UNION ALL SELECT v, 'cycle_or_between' FROM (SELECT v FROM down INTERSECT SELECT v FROM up) x""", "cyclic_edges"))
def d4(spark, d):
    down, between = D.cycles(Ops(spark, d).cyclic_edges)
    return down.unionByName(between)


@register("d5_ancestors", with_views("""
WITH RECURSIVE anc(node_id, ancestor_id, depth) AS (SELECT child_id, parent_id, 1 FROM workflow_edges
  UNION SELECT a.node_id, e.parent_id, a.depth + 1 FROM anc a JOIN workflow_edges e ON e.child_id = a.ancestor_id)
SELECT node_id, ancestor_id, CAST(min(depth) AS BIGINT) AS depth FROM anc GROUP BY ALL""", "workflow_edges"))
def d5(spark, d):
    return D.ancestors(Ops(spark, d).workflow_edges)


@register("d1_workflow_edges", with_views(f"""
SELECT {derived_id_sql("'wfjob'", "g", "pos - 1")} AS parent_id, {derived_id_sql("'wfjob'", "g", "pos")} AS child_id
FROM (SELECT o_orderkey // 10 AS g, row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) - 1 AS pos
      FROM orders) x WHERE pos >= 1 AND g % 7 <> 0""", "queues"))
def d1e(spark, d):
    o = Ops(spark, d)
    return D.create_workflows(_wf_requests(spark, d), o.queues, o.projects, JOBS_NOW)[1]
