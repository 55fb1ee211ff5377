"""Batch twins of the liveness (T3) and lease (T6) monitors: the same rules over a whole
history. Workers and jobs are cut by day, so one of them may own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import day, lag_in_groups, running_sum_in_groups
from ..session import secs, ts


def liveness_edges(hb: DataFrame, now, online_secs: int = 15, stale_secs: int = 60,
                   key: str = "worker_id", ts_col: str = "heartbeat_at", id_col: str = "heartbeat_id") -> DataFrame:
    """Status edges implied by heartbeat gaps: ONLINE→STALE at hb+online and
    STALE→OFFLINE at hb+stale when no heartbeat came in time (``now`` closes the
    last gap), and back to ONLINE at the next heartbeat."""
    x = lag_in_groups(hb.select(key, ts_col, id_col), [key], [ts_col, id_col], [ts_col], [day(ts_col)])
    gaps = x.select(key, F.col(f"prev_{ts_col}").alias("__from"), F.col(ts_col).alias("__to"), F.lit(False).alias("__open")) \
        .filter(F.col("__from").isNotNull())
    last = hb.groupBy(key).agg(F.max(ts_col).alias("__from")) \
        .select(key, "__from", ts(now).alias("__to"), F.lit(True).alias("__open"))
    g = gaps.unionByName(last)
    t, stale, off = F.col("__to"), F.col("__from") + secs(online_secs), F.col("__from") + secs(stale_secs)

    def edge(rows, at, a, b):
        return rows.select(key, at.alias("edge_at"), a.alias("from_status"), F.lit(b).alias("to_status"))

    back = g.filter(~F.col("__open") & (t > stale))
    return edge(g.filter(t > stale), stale, F.lit("ONLINE"), "STALE") \
        .unionByName(edge(g.filter(t > off), off, F.lit("STALE"), "OFFLINE")) \
        .unionByName(edge(back, t, F.when(t > off, "OFFLINE").otherwise("STALE"), "ONLINE"))


def lease_expiries(events: DataFrame, now, lease_secs: int = 30, grace_secs: int = 10,
                   ts_col: str = "event_ts") -> DataFrame:
    """Leases that lapsed: the holder's last valid claim or renewal, when neither a
    completion nor a new claim came before its expiry + grace (``now`` for the last one).

    Claims and completions cut a job's events into episodes. A renewal counts if the
    claiming worker sends it before the lease, as renewed so far, is past expiry + grace:
    from the first longer pause on the job has been reclaimed."""
    hold = secs(lease_secs + grace_secs)
    e = events.select("job_id", "worker_id", "event_id", "kind", F.col(ts_col).alias("__t"))
    cut = e.withColumn("__c", F.col("kind").isin("claim", "complete").cast("long"))
    e = running_sum_in_groups(cut, ["job_id"], ["__t", "event_id"], "__c", "__ep", [day("__t")]).drop("__c")
    starts = e.filter(F.col("kind") != "renew").select("job_id", "__ep", F.col("kind").alias("__kind"),
                                                       F.col("worker_id").alias("__holder"), F.col("__t").alias("__start"))
    ends = starts.select("job_id", (F.col("__ep") - 1).alias("__ep"), F.col("__start").alias("__end"))
    held = e.join(starts.filter(F.col("__kind") == "claim").select("job_id", "__ep", "__holder"), ["job_id", "__ep"]) \
        .filter((F.col("kind") == "claim") | (F.col("worker_id") == F.col("__holder")))
    held = lag_in_groups(held, ["job_id", "__ep"], ["__t", "event_id"], ["__t"], [day("__t")])
    late = F.col("prev___t").isNotNull() & (F.col("__t") > F.col("prev___t") + hold)
    broken = held.groupBy("job_id", "__ep").agg(F.min(F.when(late, F.struct("__t", "event_id"))).alias("__b"))
    valid = held.join(broken, ["job_id", "__ep"]).filter(
        F.col("__b").isNull() | (F.struct("__t", "event_id") < F.col("__b")))
    last = valid.groupBy("job_id", "__ep").agg(F.max(F.struct("__t", "event_id", "worker_id")).alias("__l"))
    out = last.join(ends, ["job_id", "__ep"], "left")
    t = F.col("__l.__t")
    return out.filter(F.coalesce(F.col("__end"), ts(now)) > t + hold).select(
        "job_id", F.col("__l.worker_id").alias("worker_id"), F.col("__l.event_id").alias("event_id"),
        (t + secs(lease_secs)).alias("expired_at"))
