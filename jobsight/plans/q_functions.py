"""Registered queries for the scalar functions (G1–G16) over the job tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as G
from ..operators.joins import with_context
from ..sources.fixtures import Ops, with_views
from .registry import register

_CTX = """(SELECT j.*, q.shard_count, p.project_id, p.org_id FROM jobs j JOIN queues q ON q.queue_id = j.queue_id
   JOIN projects p ON p.project_id = q.project_id)"""


@register("g1_retry_delay", with_views("""
SELECT job_id, retry_strategy, a AS attempt, CAST(floor(greatest(least(CASE WHEN retry_strategy = 'fixed' THEN 5.0
    WHEN retry_strategy = 'linear' THEN 5.0 * greatest(a, 1) ELSE 5.0 * pow(2, least(greatest(a, 1) - 1, 62)) END, 3600.0), 0.0))
  AS BIGINT) AS delay_secs
FROM (SELECT job_id, retry_strategy, job_id % 70 AS a FROM jobs) x""", "jobs"))
def g1(spark, d):
    j = Ops(spark, d).jobs.select("job_id", "retry_strategy", (F.col("job_id") % 70).alias("attempt"))
    return j.withColumn("delay_secs", G.retry_delay_secs("retry_strategy", 5, 3600, "attempt"))


@register("g2_next_retry_at", with_views("""
SELECT job_id, created_at + to_seconds(CAST(floor(greatest(least(CASE WHEN retry_strategy = 'fixed' THEN 5.0
    WHEN retry_strategy = 'linear' THEN 5.0 * greatest(attempt, 1) ELSE 5.0 * pow(2, least(greatest(attempt, 1) - 1, 62)) END,
    3600.0), 0.0)) AS BIGINT)) AS next_retry_at FROM jobs""", "jobs"))
def g2(spark, d):
    j = Ops(spark, d).jobs
    delay = G.retry_delay_secs("retry_strategy", "base_delay_secs", "max_delay_secs", "attempt")
    return j.select("job_id", G.plus_secs("created_at", delay).alias("next_retry_at"))


@register("g3_priority_tier", with_views("""
SELECT job_id, priority, CASE WHEN priority >= 10 THEN 'high' WHEN priority > 0 THEN 'standard' ELSE 'low' END AS tier
FROM jobs""", "jobs"))
def g3(spark, d):
    return Ops(spark, d).jobs.select("job_id", "priority", G.priority_tier("priority").alias("tier"))


@register("g4_subjects", with_views(f"""
SELECT job_id, subject, 'JOBS_' || replace(split_part(subject, '.', 2) || '_' || split_part(subject, '.', 4) || '_'
    || split_part(subject, '.', 6), '-', '_') AS stream,
  replace('JOBS_' || CAST(org_id AS VARCHAR) || '_' || CAST(project_id AS VARCHAR) || '_' || CAST(queue_id AS VARCHAR), '-', '_') AS stream_name,
  'org.' || CAST(org_id AS VARCHAR) || '.proj.' || CAST(project_id AS VARCHAR) || '.queue.' || CAST(queue_id AS VARCHAR) AS prefix
FROM (SELECT *, 'org.' || CAST(org_id AS VARCHAR) || '.proj.' || CAST(project_id AS VARCHAR) || '.queue.' || CAST(queue_id AS VARCHAR)
    || CASE WHEN shard_count > 1 THEN '.shard.' || CAST(shard_id AS VARCHAR) ELSE '' END || '.'
    || CASE WHEN priority >= 10 THEN 'high' WHEN priority > 0 THEN 'standard' ELSE 'low' END AS subject FROM {_CTX} c) x""",
    "jobs", "queues", "projects"))
def g4(spark, d):
    o = Ops(spark, d)
    j = with_context(o.jobs, o.queues.select("queue_id", "project_id", "shard_count"), o.projects)
    j = j.join(o.queues.select("queue_id", "shard_count"), "queue_id")
    subj = G.subject("org_id", "project_id", "queue_id", "shard_count", "shard_id", "priority")
    return j.select("job_id", subj.alias("subject"), G.stream_for_subject(subj).alias("stream"),
                    G.stream_name("org_id", "project_id", "queue_id").alias("stream_name"),
                    G.subject_prefix("org_id", "project_id", "queue_id").alias("prefix"))


@register("g6_stream_for_subject", """
SELECT s AS subject, CASE WHEN s = 'org.*.proj.*.queue.*.>' THEN 'JOBS_WILDCARD'
  WHEN len(string_split(s, '.')) >= 6 AND split_part(s, '.', 1) = 'org' AND split_part(s, '.', 3) = 'proj'
       AND split_part(s, '.', 5) = 'queue'
  THEN replace('JOBS_' || split_part(s, '.', 2) || '_' || split_part(s, '.', 4) || '_' || split_part(s, '.', 6), '-', '_')
  ELSE 'JOBS_' || replace(replace(s, '.', '_'), '-', '_') END AS stream
FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'org.*.proj.*.queue.*.>'
                  WHEN o_orderkey % 4 = 1 THEN 'org.' || o_custkey || '.proj.x-' || o_orderkey || '.queue.q-1.high'
                  WHEN o_orderkey % 4 = 2 THEN 'jobs.' || o_orderpriority
                  ELSE 'org.' || o_custkey || '.proj.' || o_orderkey END AS s FROM orders) x""")
def g6(spark, d):
    from ..sources.fixtures import read
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    s = (F.when(k % 4 == 0, F.lit("org.*.proj.*.queue.*.>"))
          .when(k % 4 == 1, F.concat(F.lit("org."), F.col("o_custkey").cast("string"), F.lit(".proj.x-"),
                                     k.cast("string"), F.lit(".queue.q-1.high")))
          .when(k % 4 == 2, F.concat(F.lit("jobs."), F.col("o_orderpriority")))
          .otherwise(F.concat(F.lit("org."), F.col("o_custkey").cast("string"), F.lit(".proj."), k.cast("string"))))
    return o.select(s.alias("subject")).select("subject", G.stream_for_subject("subject").alias("stream"))


@register("g8_shard_for_key", with_views("""
SELECT job_id, routing_key, shard_count, CAST(list_reduce(list_transform(range(octet_length(encode(routing_key))),
    lambda i: ('0x' || substr(hex(encode(routing_key)), 2 * i + 1, 2))::UHUGEINT),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT,
    14695981039346656037::UHUGEINT) % CAST(greatest(shard_count, 1) AS UHUGEINT) AS BIGINT) AS shard
FROM (SELECT j.job_id, coalesce(j.idempotency_key, 'job-' || CAST(j.job_id AS VARCHAR) || '-ü') AS routing_key, q.shard_count
  FROM jobs j JOIN queues q ON q.queue_id = j.queue_id) x""", "jobs", "queues"))
def g8(spark, d):
    o = Ops(spark, d)
    j = o.jobs.join(o.queues.select("queue_id", "shard_count"), "queue_id")
    key = F.coalesce(F.col("idempotency_key"), F.concat(F.lit("job-"), F.col("job_id").cast("string"), F.lit("-ü")))
    return j.select("job_id", key.alias("routing_key"), "shard_count",
                    G.shard_for_key(key, F.col("shard_count")).alias("shard"))


@register("g10_normalize_status", with_views("""
SELECT job_id, raw, CASE WHEN u = 'RETRYWAIT' THEN 'RETRY_WAIT' WHEN u = 'UNKNOWN' THEN 'UNKNOWN_EXTERNAL_RESULT'
  WHEN u IN ('SCHEDULED', 'QUEUED', 'CLAIMED', 'RUNNING', 'RETRY_WAIT', 'COMPLETED', 'FAILED', 'CANCELLED', 'WAITING',
             'UNKNOWN_EXTERNAL_RESULT') THEN u END AS status
FROM (SELECT job_id, raw, upper(replace(raw, '-', '_')) AS u FROM (SELECT job_id,
  CASE WHEN job_id % 7 = 0 THEN 'retrywait' WHEN job_id % 11 = 0 THEN 'Unknown' WHEN job_id % 13 = 0 THEN 'bogus'
       ELSE lower(replace(status, '_', '-')) END AS raw FROM jobs) a) b""", "jobs"))
def g10(spark, d):
    j = Ops(spark, d).jobs
    k = F.col("job_id")
    raw = (F.when(k % 7 == 0, "retrywait").when(k % 11 == 0, "Unknown").when(k % 13 == 0, "bogus")
            .otherwise(F.lower(F.replace(F.col("status"), F.lit("_"), F.lit("-")))))
    return j.select("job_id", raw.alias("raw")).select("job_id", "raw", G.normalize_status("raw").alias("status"))


@register("g11_normalize_request", with_views("""
SELECT job_id, CASE WHEN s IN ('fixed', 'linear') THEN s ELSE 'exponential' END AS strategy,
  CASE WHEN coalesce(kind_in, type_in, 'immediate') IN ('delayed', 'scheduled', 'recurring', 'batch')
       THEN coalesce(kind_in, type_in, 'immediate') ELSE 'immediate' END AS kind,
  coalesce(header_key, idempotency_key) AS key, coalesce(item_priority, req_priority, 5) AS priority
FROM (SELECT job_id, idempotency_key, CASE WHEN job_id % 5 = 0 THEN NULL WHEN job_id % 5 = 1 THEN 'weird' ELSE retry_strategy END AS s,
  CASE WHEN job_id % 3 = 0 THEN kind END AS kind_in, CASE WHEN job_id % 4 = 0 THEN 'delayed' WHEN job_id % 4 = 1 THEN 'odd' END AS type_in,
  CASE WHEN job_id % 6 = 0 THEN 'h-' || CAST(job_id AS VARCHAR) END AS header_key,
  CASE WHEN job_id % 2 = 0 THEN priority END AS item_priority, CASE WHEN job_id % 3 = 0 THEN CAST(1 AS BIGINT) END AS req_priority
  FROM jobs) x""", "jobs"))
def g11(spark, d):
    j = Ops(spark, d).jobs
    k = F.col("job_id")
    x = j.select("job_id", "idempotency_key",
                 F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "weird").otherwise(F.col("retry_strategy")).alias("s"),
                 F.when(k % 3 == 0, F.col("kind")).alias("kind_in"),
                 F.when(k % 4 == 0, "delayed").when(k % 4 == 1, "odd").alias("type_in"),
                 F.when(k % 6 == 0, F.concat(F.lit("h-"), k.cast("string"))).alias("header_key"),
                 F.when(k % 2 == 0, F.col("priority")).alias("item_priority"),
                 F.when(k % 3 == 0, F.lit(1).cast("long")).alias("req_priority"))
    return x.select("job_id", G.normalize_strategy("s").alias("strategy"),
                    G.normalize_kind("kind_in", "type_in").alias("kind"),
                    G.first_present("header_key", "idempotency_key").alias("key"),
                    G.first_present("item_priority", "req_priority", F.lit(5).cast("long")).alias("priority"))


@register("g13_payload_fields", with_views("""
SELECT job_id, coalesce(json_extract_string(payload, '$.type'), 'echo') AS type,
  coalesce(TRY_CAST(json_extract_string(payload, '$.secs') AS BIGINT), 1) AS secs,
  coalesce(TRY_CAST(json_extract_string(payload, '$.force_unknown') AS BOOLEAN), false) AS force_unknown FROM jobs""", "jobs"))
def g13(spark, d):
    j = Ops(spark, d).jobs
    return j.select("job_id", G.payload_type("payload").alias("type"), G.payload_secs("payload").alias("secs"),
                    G.payload_force_unknown("payload").alias("force_unknown"))


@register("g14_result_json", with_views("""
SELECT job_id, to_json({'job_id': job_id, 'status': status, 'lease_owner': lease_owner})::VARCHAR AS result FROM jobs""", "jobs"))
def g14(spark, d):
    j = Ops(spark, d).jobs
    return j.select("job_id", G.to_json_object(job_id="job_id", status="status", lease_owner="lease_owner").alias("result"))


@register("g15_duration_ms", with_views("""
SELECT job_id, CAST(round((epoch_us(scheduled_for) - epoch_us(created_at)) / 1000.0) AS BIGINT) AS duration_ms
FROM jobs WHERE scheduled_for IS NOT NULL""", "jobs"))
def g15(spark, d):
    j = Ops(spark, d).jobs.filter(F.col("scheduled_for").isNotNull())
    return j.select("job_id", G.duration_ms("created_at", "scheduled_for").alias("duration_ms"))


@register("g16_occurrence_key", with_views("""
SELECT job_id, CAST(queue_id AS VARCHAR) || ':' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC' AS occurrence_key FROM jobs""",
    "jobs"))
def g16(spark, d):
    j = Ops(spark, d).jobs
    return j.select("job_id", G.occurrence_key("queue_id", "created_at").alias("occurrence_key"))
