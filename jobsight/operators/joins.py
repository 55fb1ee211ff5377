"""Equi-join operators (J1–J13). All set-based over every tenant at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_LEASE_SECS
from ..session import secs, ts


# J1 ---------------------------------------------------------------------------
def with_context(df: DataFrame, queues: DataFrame, projects: DataFrame,
                 queue_col: str = "queue_id") -> DataFrame:
    """Add project_id and org_id from the queue. Rows whose queue or project is
    missing are dropped (inner joins, as the reference's context lookup fails).

    projects is tenant-sized and small; the planner broadcasts it from its size
    estimate. queues can be large and joins by hash on queue_id."""
    q = queues.select(F.col("queue_id").alias("__q"), F.col("project_id").alias("__p"))
    p = projects.select(F.col("project_id").alias("__p"), F.col("org_id").alias("__o"))
    qp = q.join(p, "__p")
    out = df.join(qp, df[queue_col] == qp["__q"])
    return (out.withColumn("project_id", F.col("__p")).withColumn("org_id", F.col("__o"))
               .drop("__q", "__p", "__o"))


# J2 ---------------------------------------------------------------------------
FAN_PARTS = 64      # parts the rows of an org are dealt into before the membership fan-out
MEMBER_PARTS = 8    # parts the members of an org are dealt into while they are put into tiles
FAN_TASKS = 128     # tasks of the fan-out, at least
FAN_TILE = 512      # rows, or members, that are held together


def _tiles(df: DataFrame, parts: int, tasks: int, name: str) -> DataFrame:
    """``org_id, __part, name``: the rows of each org, dealt into parts, in arrays of at most
    ``FAN_TILE`` structs of the other columns. The place in the order of all columns (context
    first, so equal values stay together) makes the tile: repeated rows fill further ones, and
    a task that runs again cuts the same tiles."""
    rest = [c for c in df.columns if c != "org_id"]
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")) \
        .repartition(tasks, "org_id", "__part")
    place = F.row_number().over(Window.partitionBy("org_id", "__part").orderBy(*reversed(rest)))
    first = dealt.withColumn("__at", place).withColumn("__at", F.col("__at") - (F.col("__at") - 1) % FAN_TILE)
    tiles = first.groupBy("org_id", "__part", "__at")
    return tiles.agg(F.sort_array(F.collect_list(F.struct(*reversed(rest)))).alias(name)).drop("__at")


def _fan_out(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Each row with every member of its org. Orgs are few and the result is far larger than
    what goes in, so neither the join key nor the input's size tells how to cut the work: the
    rows of an org are dealt into parts, each meets a copy of the org's members, and the parts
    go to a fixed number of tasks that is not coalesced. Tiles of members meet tiles of rows
    and are opened last. As the same tile of rows comes again for member after member, the
    result, which is nearly all that is written, compresses well whatever the size of an org."""
    spark = rows.sparkSession
    tasks = max(FAN_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions") or 200))
    own, of = ([c for c in df.columns if c != "org_id"] for df in (rows, members))
    copies = _tiles(members, MEMBER_PARTS, tasks, "__members") \
        .withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(FAN_PARTS - 1)))) \
        .repartition(tasks, "org_id", "__part")
    both = copies.join(_tiles(rows, FAN_PARTS, tasks, "__rows").hint("shuffle_hash"), ["org_id", "__part"])
    return both.select("org_id", "__rows", F.inline("__members")) \
        .select("org_id", *of, F.inline("__rows")).select("org_id", *own, *of)


def visible_to(df: DataFrame, queues: DataFrame, projects: DataFrame,
               memberships: DataFrame, users: DataFrame | None = None,
               queue_col: str = "queue_id") -> DataFrame:
    """Rows visible to each user through an org membership: (user_id, row...).

    Memberships are unique on (org_id, user_id), so a row appears once per user.
    ``users`` restricts the output to a set of users (semi join)."""
    ctx = with_context(df, queues, projects, queue_col)
    m = memberships.select("org_id", "user_id")
    if users is not None:
        m = m.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return _fan_out(ctx, m)


def visible_counts(df: DataFrame, queues: DataFrame, projects: DataFrame,
                   memberships: DataFrame) -> DataFrame:
    """(user_id, queue_id, entries): rows visible to each user, counted by queue before
    the membership fan-out."""
    per_queue = df.groupBy("queue_id").agg(F.count(F.lit(1)).alias("entries"))
    return visible_to(per_queue, queues, projects, memberships).select("user_id", "queue_id", "entries")


def orgs_visible_to(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    return organizations.join(memberships.select("org_id", "user_id", "role"), "org_id")


# J3 / J4 ----------------------------------------------------------------------
def has_access(pairs: DataFrame, memberships: DataFrame, on: str = "org_id") -> DataFrame:
    """(user_id, <on>) request pairs with a boolean ``allowed``."""
    m = memberships.select("user_id", on).distinct().withColumn("__hit", F.lit(True))
    return (pairs.join(m, ["user_id", on], "left")
                 .withColumn("allowed", F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit"))


ADMIN_ROLES = ("owner", "admin")
WRITER_ROLES = ("owner", "admin", "member")


def role_allows(pairs: DataFrame, memberships: DataFrame, roles=ADMIN_ROLES,
                on: str = "org_id") -> DataFrame:
    """Role gate with reason ``ok`` / ``insufficient`` / ``not_in_org``."""
    m = memberships.select("user_id", on, F.col("role").alias("__role"))
    out = pairs.join(m, ["user_id", on], "left")
    return (out.withColumn("reason", F.when(F.col("__role").isNull(), "not_in_org")
                                       .when(F.col("__role").isin(*roles), "ok")
                                       .otherwise("insufficient"))
               .withColumn("allowed", F.col("reason") == "ok").drop("__role"))


# J5 ---------------------------------------------------------------------------
def missing(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` with no counterpart in ``other`` (NOT EXISTS). Null keys
    never match, so they are kept, as NOT EXISTS does."""
    return df.join(other.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_anti")


# J6 ---------------------------------------------------------------------------
def worker_view(workers: DataFrame, jobs: DataFrame, now, online_secs: int = 15,
                stale_secs: int = 60) -> DataFrame:
    """Each worker with status and its RUNNING job count (pre-aggregated, then
    one left join instead of a correlated subquery)."""
    from ..functions.columns import worker_status
    running = (jobs.filter(F.col("status") == "RUNNING").filter(F.col("lease_owner").isNotNull())
                   .groupBy(F.col("lease_owner").alias("worker_id"))
                   .agg(F.count(F.lit(1)).alias("running_jobs")))
    return (workers.join(running, "worker_id", "left")
                   .withColumn("running_jobs", F.coalesce("running_jobs", F.lit(0).cast("long")))
                   .withColumn("status", worker_status("last_heartbeat_at", now, online_secs, stale_secs)))


# J7 ---------------------------------------------------------------------------
def capacity_slots(queues: DataFrame, size_col: str = "max_concurrency") -> DataFrame:
    """(queue_id, slot_index) for slot_index in 0..max_concurrency-1."""
    n = F.col(size_col).cast("long")
    return queues.select("queue_id", F.explode(
        F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
         .otherwise(F.array().cast("array<bigint>"))).alias("slot_index"))


# J8 ---------------------------------------------------------------------------
def apply_renewals(jobs: DataFrame, tokens: DataFrame, renewals: DataFrame, now,
                   lease_secs: int = DEFAULT_LEASE_SECS):
    """Renewals (job_id, worker_id, epoch) extend a RUNNING lease held by the same
    worker at the same epoch whose capacity token is held by the same job+worker.
    Returns (jobs, tokens, accepted) with lease_expires_at / lease_until moved."""
    until = ts(now) + secs(lease_secs)
    held = tokens.filter(F.col("job_id").isNotNull()).select("job_id", F.col("worker_id").alias("__tw"))
    r = renewals.select("job_id", F.col("worker_id").alias("__rw"), F.col("epoch").alias("__re")).distinct()
    j = jobs.filter(F.col("status") == "RUNNING").select("job_id", "lease_owner", "lease_epoch")
    ok = (j.join(r, (j.job_id == r.job_id) & (j.lease_owner == r.__rw) & (j.lease_epoch == r.__re))
           .select(j.job_id, r.__rw.alias("worker_id"), r.__re.alias("epoch")))
    ok = ok.join(held, (ok.job_id == held.job_id) & (ok.worker_id == held.__tw), "left_semi")
    flag = ok.select("job_id").distinct().withColumn("__renew", F.lit(True))
    new_jobs = (jobs.join(flag, "job_id", "left")
                    .withColumn("lease_expires_at", F.when(F.col("__renew"), until)
                                .otherwise(F.col("lease_expires_at")))
                    .drop("__renew"))
    tokens_out = tokens
    if "lease_until" in tokens.columns:
        tokens_out = (tokens.join(flag, "job_id", "left")
                      .withColumn("lease_until", F.when(F.col("__renew"), until).otherwise(F.col("lease_until")))
                      .drop("__renew"))
    return new_jobs, tokens_out, ok


# J9 ---------------------------------------------------------------------------
def fence(reports: DataFrame, jobs: DataFrame, require_running: bool = True) -> DataFrame:
    """Classify worker reports (job_id, worker_id, epoch) against the job table:
    ``unknown_job`` / ``wrong_owner`` / ``stale_epoch`` / ``not_running`` / ``accepted``."""
    j = jobs.select("job_id", F.col("lease_owner").alias("__owner"),
                    F.col("lease_epoch").alias("__epoch"), F.col("status").alias("__status"),
                    F.lit(True).alias("__exists"))
    out = reports.join(j, "job_id", "left")
    # SQL equality: a NULL owner or epoch never matches (a job without a lease
    # accepts no report)
    same_owner = F.coalesce(F.col("worker_id") == F.col("__owner"), F.lit(False))
    same_epoch = F.coalesce(F.col("epoch") == F.col("__epoch"), F.lit(False))
    verdict = (F.when(F.col("__exists").isNull(), "unknown_job")
                .when(~same_owner, "wrong_owner")
                .when(~same_epoch, "stale_epoch"))
    if require_running:
        verdict = verdict.when(F.col("__status") != "RUNNING", "not_running")
    verdict = verdict.otherwise("accepted")
    return out.withColumn("verdict", verdict).drop("__owner", "__epoch", "__status", "__exists")


# J10 --------------------------------------------------------------------------
def abandon(execs: DataFrame, job_ids: DataFrame, now) -> DataFrame:
    """Close STARTED executions of the given jobs as ABANDONED (finished_at = now)."""
    flag = job_ids.select("job_id").distinct().withColumn("__hit", F.lit(True))
    out = execs.join(flag, "job_id", "left")
    hit = F.col("__hit") & (F.col("status") == "STARTED")
    fin = F.col("finished_at") if "finished_at" in execs.columns else F.lit(None).cast("timestamp_ntz")
    out = out.withColumn("finished_at", F.when(hit, ts(now)).otherwise(fin))
    return out.withColumn("status", F.when(hit, "ABANDONED").otherwise(F.col("status"))).drop("__hit")


# J11 / J13 --------------------------------------------------------------------
def dlq_with_summary(dlq: DataFrame, summaries: DataFrame, how: str = "left") -> DataFrame:
    return dlq.join(summaries, "dlq_id", how)


def replay_lineage(dlq: DataFrame, jobs: DataFrame) -> DataFrame:
    j = jobs.select(F.col("job_id").alias("replayed_to_job_id"),
                    F.col("status").alias("replay_status"), F.col("attempt").alias("replay_attempt"))
    return dlq.join(j, "replayed_to_job_id", "left")


# J12 --------------------------------------------------------------------------
def workflow_view(jobs: DataFrame, edges: DataFrame, workflow_col: str = "workflow_id") -> DataFrame:
    """Edges touching each workflow's jobs (parent OR child), each edge once per
    workflow. Two equi-joins unioned and de-duplicated instead of an OR join
    (which would plan as a nested loop)."""
    wj = jobs.filter(F.col(workflow_col).isNotNull()).select(F.col("job_id").alias("__j"), workflow_col)
    by_parent = edges.join(wj, edges.parent_id == wj.__j).select(workflow_col, "parent_id", "child_id")
    by_child = edges.join(wj, edges.child_id == wj.__j).select(workflow_col, "parent_id", "child_id")
    return by_parent.unionByName(by_child).dropDuplicates([workflow_col, "parent_id", "child_id"])
