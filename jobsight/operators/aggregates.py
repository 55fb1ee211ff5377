"""Aggregations (A1–A13). Every one aggregates with a map-side partial step, so a
hot queue or tenant costs one partial row per task, not one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import with_context

STAT_STATUSES = [("queued", "QUEUED"), ("running", "RUNNING"), ("retry_wait", "RETRY_WAIT"),
                 ("completed", "COMPLETED"), ("failed", "FAILED"), ("scheduled", "SCHEDULED"),
                 ("claimed", "CLAIMED")]


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _status_counts(status: Column | None = None) -> list[Column]:
    status = F.col("status") if status is None else status
    return [_count_if(status == s).alias(n) for n, s in STAT_STATUSES]


# A1 ---------------------------------------------------------------------------
def queue_stats(queues: DataFrame, jobs: DataFrame, dlq: DataFrame) -> DataFrame:
    """Seven status counts and the DLQ count for every queue, zero-filled."""
    js = jobs.groupBy("queue_id").agg(*_status_counts())
    ds = dlq.groupBy("queue_id").agg(F.count(F.lit(1)).alias("dlq"))
    names = [n for n, _ in STAT_STATUSES] + ["dlq"]
    out = queues.select("queue_id").join(js, "queue_id", "left").join(ds, "queue_id", "left")
    return out.select("queue_id", *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in names])


def tenant_queue_stats(queues: DataFrame, projects: DataFrame, jobs: DataFrame,
                       dlq: DataFrame) -> DataFrame:
    """A1 with the tenant context (org_id, project_id) of each queue."""
    js = jobs.groupBy("queue_id").agg(*_status_counts())
    ds = dlq.groupBy("queue_id").agg(F.count(F.lit(1)).alias("dlq"))
    names = [n for n, _ in STAT_STATUSES] + ["dlq"]
    out = queues.select("queue_id", "project_id").join(projects.select("project_id", "org_id"), "project_id") \
        .join(js, "queue_id", "left").join(ds, "queue_id", "left")
    return out.select("queue_id", *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in names],
                      "project_id", "org_id")


# A2 ---------------------------------------------------------------------------
def batch_queue_stats(jobs: DataFrame, dlq: DataFrame, ids: DataFrame,
                      dlq_zero: bool = False) -> DataFrame:
    """Stats for a queue set (``ids`` has queue_id); only queues that have jobs.
    ``dlq_zero`` reproduces the reference's constant 0."""
    want = ids.select("queue_id").distinct()
    js = jobs.join(want, "queue_id", "left_semi").groupBy("queue_id").agg(*_status_counts())
    if dlq_zero:
        return js.withColumn("dlq", F.lit(0).cast("long"))
    ds = dlq.join(want, "queue_id", "left_semi").groupBy("queue_id").agg(F.count(F.lit(1)).alias("dlq"))
    return js.join(ds, "queue_id", "left").withColumn("dlq", F.coalesce("dlq", F.lit(0).cast("long")))


# A3 ---------------------------------------------------------------------------
def _per_queue(rows: DataFrame, *keys: str) -> DataFrame:
    """Row counts by queue (and ``keys``), before any join: a few rows a queue."""
    return rows.groupBy("queue_id", *keys).agg(F.count(F.lit(1)).alias("n"))


def project_snapshot(jobs: DataFrame, dlq: DataFrame, queues: DataFrame,
                     projects: DataFrame) -> DataFrame:
    """Long form (project_id, status, n) of job counts, plus ('DLQ', n)."""
    counts = _per_queue(jobs, "status").unionByName(_per_queue(dlq).withColumn("status", F.lit("DLQ")))
    return with_context(counts, queues, projects).groupBy("project_id", "status").agg(F.sum("n").alias("n"))


def snapshot_json(long_counts: DataFrame, key: str = "project_id") -> DataFrame:
    """One JSON object per key, entries sorted by status: {"COMPLETED": 3, ...}."""
    return (long_counts.groupBy(key)
            .agg(F.to_json(F.map_from_entries(F.sort_array(
                F.collect_list(F.struct(F.col("status"), F.col("n")))))).alias("snapshot")))


# A4 ---------------------------------------------------------------------------
METRIC_COUNTS = [("queued", "QUEUED"), ("running", "RUNNING"), ("completed", "COMPLETED"),
                 ("failed", "FAILED"), ("retry_wait", "RETRY_WAIT")]


def user_metrics(jobs: DataFrame, dlq: DataFrame, queues: DataFrame, projects: DataFrame,
                 memberships: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user: total visible jobs (DLQ excluded) and the counts by status plus dlq.

    Rows are counted by queue and status before any join, then by org; the membership
    fan-out touches one row per org."""
    counts = _per_queue(jobs, "status").unionByName(_per_queue(dlq).withColumn("status", F.lit(None).cast("string")))
    j = with_context(counts, queues, projects)
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    per_org = j.groupBy("org_id").agg(of(F.col("status").isNotNull()).alias("total_jobs"),
                                      *[of(F.col("status") == s).alias(n) for n, s in METRIC_COUNTS],
                                      of(F.col("status").isNull()).alias("dlq"))
    m = memberships.select("org_id", "user_id")
    if users is not None:
        m = m.join(users.select("user_id").distinct(), "user_id", "left_semi")
    x = m.join(per_org, "org_id", "left")
    cols = ["total_jobs"] + [n for n, _ in METRIC_COUNTS] + ["dlq"]
    return x.groupBy("user_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in cols])


# A5 ---------------------------------------------------------------------------
def count_pages(filtered: DataFrame, page_size: int) -> DataFrame:
    """Total and number of pages (integer ceiling) of an already filtered frame."""
    size = max(1, min(100, int(page_size)))
    return filtered.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(size).cast("long").alias("page_size"),
        F.expr(f"(total + {size - 1}) div {size}").alias("pages"))


def count_by(filtered: DataFrame, key: str, page_size: int) -> DataFrame:
    size = max(1, min(100, int(page_size)))
    return filtered.groupBy(key).agg(F.count(F.lit(1)).alias("total")).select(
        key, "total", F.expr(f"(total + {size - 1}) div {size}").alias("pages"))


# A6 ---------------------------------------------------------------------------
def can_access_all(requests: DataFrame, queues: DataFrame, projects: DataFrame,
                   memberships: DataFrame) -> DataFrame:
    """requests: (request_id, user_id, queue_id). Per request: distinct visible
    queue ids == distinct requested ids. Empty request sets are not rows."""
    req = requests.select("request_id", "user_id", "queue_id").distinct()
    ctx = with_context(req, queues, projects)
    vis = ctx.join(memberships.select("org_id", "user_id"), ["org_id", "user_id"], "left_semi")
    want = req.groupBy("request_id", "user_id").agg(F.count(F.lit(1)).alias("requested"))
    got = vis.groupBy("request_id").agg(F.count(F.lit(1)).alias("visible"))
    out = want.join(got, "request_id", "left").withColumn("visible", F.coalesce("visible", F.lit(0).cast("long")))
    return out.withColumn("all_visible", F.col("visible") == F.col("requested"))


# A7 ---------------------------------------------------------------------------
def batch_progress(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Order-free batch status: done & failed=0 COMPLETED; done & completed=0
    FAILED; done & mixed (or failures while in progress) PARTIALLY_COMPLETED;
    any progress RUNNING; else QUEUED."""
    g = (jobs.filter(F.col("batch_id").isNotNull()).groupBy("batch_id")
             .agg(_count_if(F.col("status") == "COMPLETED").alias("completed_jobs"),
                  _count_if(F.col("status") == "FAILED").alias("failed_jobs")))
    x = batches.join(g, "batch_id", "left")
    c = F.coalesce("completed_jobs", F.lit(0).cast("long"))
    f = F.coalesce("failed_jobs", F.lit(0).cast("long"))
    t = F.col("total_jobs")
    done = (c + f) >= t
    status = (F.when(done & (f == 0), "COMPLETED")
               .when(done & (c == 0), "FAILED")
               .when(done | (f > 0), "PARTIALLY_COMPLETED")
               .when(c > 0, "RUNNING")
               .otherwise("QUEUED"))
    return x.select("batch_id", "total_jobs", c.alias("completed_jobs"), f.alias("failed_jobs"),
                    status.alias("status"))


# A8 / A9 ----------------------------------------------------------------------
def capacity_usage(queues: DataFrame, jobs: DataFrame) -> DataFrame:
    run = (jobs.filter(F.col("status").isin("CLAIMED", "RUNNING")).groupBy("queue_id")
               .agg(F.count(F.lit(1)).alias("running")))
    x = queues.select("queue_id", "max_concurrency").join(run, "queue_id", "left")
    r = F.coalesce("running", F.lit(0).cast("long"))
    mx = F.col("max_concurrency")
    pct = F.least(F.lit(100).cast("long"),
                  F.round(r.cast("double") / F.greatest(mx, F.lit(1)).cast("double") * 100).cast("long"))
    return x.select("queue_id", "max_concurrency", r.alias("running"),
                    F.greatest(mx - r, F.lit(0).cast("long")).alias("free_slots"), pct.alias("pct_used"))


def running_per_worker(jobs: DataFrame) -> DataFrame:
    return (jobs.filter((F.col("status") == "RUNNING") & F.col("lease_owner").isNotNull())
                .groupBy(F.col("lease_owner").alias("worker_id")).agg(F.count(F.lit(1)).alias("running_jobs")))


# A10 / A11 --------------------------------------------------------------------
TREND_POINTS = {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def trend(df: DataFrame, metric: str, by: list[str], approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """avg, min, med, max, p90, p95, p99 of ``metric`` per group.

    Exact (linear interpolation between ranks) whatever the size: values are counted per
    (group, value), the counts run up in value order, cut into ranges of the value's
    logarithm, and the ranks asked for are picked by one more aggregation. No buffer holds a
    group's values. ``approx=True`` takes the mergeable quantile sketch instead."""
    from .windows import running_sum_in_groups
    keys = [F.col(c) for c in by] or [F.lit(0).alias("__all")]
    base = df.select(*keys, F.col(metric).cast("double").alias("__m"))
    by_ = by or ["__all"]
    basics = [F.count("__m").alias("n"), F.round(F.avg("__m"), 2).alias("avg"), F.round(F.min("__m"), 2).alias("min"),
              F.round(F.max("__m"), 2).alias("max")]
    if approx:
        out = base.groupBy(*by_).agg(*basics, *[F.round(F.percentile_approx("__m", p, accuracy).cast("double"), 2).alias(n)
                                                for n, p in TREND_POINTS.items()])
    else:
        counts = base.filter(F.col("__m").isNotNull()).groupBy(*by_, "__m").agg(F.count(F.lit(1)).alias("__c"))
        scale = F.signum("__m") * F.floor(F.log2(F.abs("__m") + 1) * 8)
        upto = running_sum_in_groups(counts, by_, ["__m"], "__c", "__upto", [scale])
        total = base.groupBy(*by_).agg(*basics)
        t = total.select(*[F.col(c).alias(f"__t_{c}") for c in by_], F.col("n").alias("__n"))
        same = None
        for c in by_:
            e = F.col(c).eqNullSafe(F.col(f"__t_{c}"))
            same = e if same is None else same & e
        x = upto.join(t, same)

        def at(p: float, up: bool) -> Column:
            place = F.lit(p) * (F.col("__n") - 1)
            rank = F.ceil(place) if up else F.floor(place)
            return F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("__m")))

        picks = x.groupBy(*by_).agg(F.max("__n").alias("__n"), *[at(p, u).alias(f"__{n}_{int(u)}")
                                                                 for n, p in TREND_POINTS.items() for u in (False, True)])
        part = lambda p: F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1))
        picks = picks.select(*[F.col(c).alias(f"__p_{c}") for c in by_], *[
            F.round(F.col(f"__{n}_0") + part(p) * (F.col(f"__{n}_1") - F.col(f"__{n}_0")), 2).alias(n)
            for n, p in TREND_POINTS.items()])
        same = None
        for c in by_:
            e = F.col(c).eqNullSafe(F.col(f"__p_{c}"))
            same = e if same is None else same & e
        out = total.join(picks, same, "left")
    return out.select(*by, "n", "avg", "min", "med", "max", "p90", "p95", "p99")


def slo(df: DataFrame, metric: str, ok: str, by: list[str], rate_min: float = 0.99,
        p95_max: float = 100.0, p99_max: float = 200.0) -> DataFrame:
    t = trend(df.withColumn("__all", F.lit(0)), metric, by or ["__all"])
    r = df.withColumn("__all", F.lit(0)).groupBy(*(by or ["__all"])).agg(
        F.round(F.avg(F.col(ok).cast("double")), 4).alias("success_rate"))
    x = t.join(r, by or ["__all"])
    return x.select(*by, "n", "success_rate", "p95", "p99",
                    (F.col("success_rate") > rate_min).alias("rate_ok"),
                    (F.col("p95") < p95_max).alias("p95_ok"),
                    (F.col("p99") < p99_max).alias("p99_ok"))


# A12 / A13 --------------------------------------------------------------------
def attempt_summary(execs: DataFrame) -> DataFrame:
    return execs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        *[_count_if(F.col("status") == s).alias(s.lower()) for s in
          ("STARTED", "COMPLETED", "FAILED", "ABANDONED")],
        F.max_by("status", F.struct("started_at", "attempt", "execution_id")).alias("last_status"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_duration_ms"))


def dlq_rollup(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("queue_id", "error_kind", "reason").agg(
        F.count(F.lit(1)).alias("entries"),
        _count_if(F.col("replayed_to_job_id").isNotNull()).alias("replayed"),
        F.round(F.avg(F.col("replayed_to_job_id").isNotNull().cast("double")), 4).alias("replayed_share"))
