"""Backlog maintenance tick (T8): reclaim → backfill → promote → requeue → fire
due cron, in the reference's order, as one composition of set operators.

``run_tick`` returns the changed/derived frames of one tick (callers merge them with
``merge.upsert``); ``tick_batch`` is the ``foreachBatch`` form that
writes one tick per micro-batch into epoch-keyed folders (idempotent retries)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cron as C
from ..operators import transitions as B
from ..operators.merge import upsert


def run_tick(ops, now, occurrences: DataFrame | None = None) -> dict[str, DataFrame]:
    """``ops`` exposes jobs, executions, capacity_tokens, outbox_events, queues,
    projects, scheduled_jobs (e.g. ``fixtures.Ops``)."""
    jobs, execs, tokens = ops.jobs, ops.executions, ops.capacity_tokens
    r_jobs, r_execs, r_tokens, r_out = B.reclaim(jobs, execs, tokens, ops.queues, ops.projects, now)
    jobs1 = upsert(jobs, r_jobs, "job_id", ["updated_at"], [c for c in r_jobs.columns if c in jobs.columns
                                                               and c != "job_id"])
    outbox1 = ops.outbox_events.select("job_id").unionByName(r_out.select("job_id"))
    b_out = B.backfill_outbox(jobs1, outbox1, ops.queues, ops.projects, now)
    p_jobs, p_out = B.promote(jobs1, ops.queues, ops.projects, now)
    q_jobs, q_out = B.requeue(jobs1, ops.queues, ops.projects, now)
    spark = jobs.sparkSession
    occ = occurrences if occurrences is not None else spark.createDataFrame(
        [], "schedule_id long, fire_time timestamp_ntz")
    c_jobs, c_out, c_occ, c_sched = C.fire(ops.scheduled_jobs, occ, ops.queues, ops.projects, now)
    return {
        "reclaimed": r_jobs, "abandoned_executions": r_execs, "freed_tokens": r_tokens,
        "promoted": p_jobs, "requeued": q_jobs, "cron_jobs": c_jobs, "occurrences": c_occ,
        "schedules": c_sched,
        "outbox": (r_out.withColumn("source", F.lit("reclaim"))
                   .unionByName(b_out.withColumn("source", F.lit("backfill")))
                   .unionByName(p_out.withColumn("source", F.lit("promote")))
                   .unionByName(q_out.withColumn("source", F.lit("requeue")))
                   .unionByName(c_out.withColumn("source", F.lit("cron")))),
    }


def tick_batch(ops_for_batch, out_dir: str):
    """foreachBatch callback: one tick per micro-batch, ``now`` = the batch's
    latest event time; each output overwrites its epoch folder."""
    def handle(batch: DataFrame, epoch: int) -> None:
        row = batch.agg(F.max("event_ts").alias("now")).first()
        if row is None or row["now"] is None:
            return
        res = run_tick(ops_for_batch(batch), str(row["now"]))
        for name in res:
            res[name].write.mode("overwrite").parquet(f"{out_dir}/{name}/epoch={epoch}")
    return handle
