"""Filters, projections and rule checks (S3, F1–F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (BACKFILL_AGE_SECS, DLQ_REASONS, JOB_KINDS, JOB_STATUSES, MEMBER_ROLES,
                      RECLAIM_GRACE_SECS, RETRY_STRATEGIES)
from ..session import secs, ts


# S3 ---------------------------------------------------------------------------
def decode_messages(msgs: DataFrame, header_col: str = "header_job_id", body_col: str = "body",
                    body_path: str = "$.job_id", key_type: str = "long"):
    """Job id from the header, else from the JSON body; rows with neither (or an
    unparsable id) are returned as ``rejected`` with a reason instead of dropped."""
    hdr = F.col(header_col).try_cast(key_type)
    body_raw = F.get_json_object(F.col(body_col), body_path)
    body = body_raw.try_cast(key_type)
    body_ok = F.col(body_col).isNotNull() & F.get_json_object(F.col(body_col), "$").isNotNull()
    jid = F.coalesce(hdr, body)
    x = msgs.withColumn("job_id", jid).withColumn(
        "reject_reason",
        F.when(jid.isNotNull(), F.lit(None).cast("string"))
         .when(hdr.isNull() & ~F.coalesce(body_ok, F.lit(False)), "bad_payload")
         .otherwise("no_job_id"))
    good = x.filter(F.col("job_id").isNotNull()).drop("reject_reason")
    rejected = x.filter(F.col("job_id").isNull()).drop("job_id")
    return good, rejected


# F1 ---------------------------------------------------------------------------
def by_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Set form of a key lookup: rows of ``df`` whose key is in ``keys``."""
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*cols), cols, "left_semi")


# F2 ---------------------------------------------------------------------------
def filter_jobs(jobs: DataFrame, queue_id=None, status=None, priority_min=None,
                lease_owner=None, batch_id=None) -> DataFrame:
    """Optional predicates: a None argument adds nothing, so each present one is a
    plain comparison that reaches the parquet scan."""
    out = jobs
    for col, val, op in (("queue_id", queue_id, "eq"), ("status", status, "eq"),
                         ("priority", priority_min, "ge"), ("lease_owner", lease_owner, "eq"),
                         ("batch_id", batch_id, "eq")):
        if val is None:
            continue
        out = out.filter(F.col(col) >= F.lit(val)) if op == "ge" else out.filter(F.col(col) == F.lit(val))
    return out


# F3 ---------------------------------------------------------------------------
def parse_id_list(requests: DataFrame, csv_col: str = "ids", key_type: str = "long",
                  max_ids: int = 100):
    """Comma-separated id lists → (accepted id rows, rejected requests).

    Unparsable ids are dropped; a request with more than ``max_ids`` valid ids is
    rejected whole; a request with none yields no rows."""
    parsed = F.filter(F.transform(F.split(F.col(csv_col), ","), lambda s: s.try_cast(key_type)),
                      lambda x: x.isNotNull())
    x = requests.withColumn("__ids", parsed)
    too_many = F.size("__ids") > max_ids
    rejected = x.filter(too_many).withColumn("n_ids", F.size("__ids").cast("long")).drop("__ids", csv_col)
    ok = (x.filter(~too_many).select(*[c for c in requests.columns if c != csv_col],
                                     F.explode("__ids").alias("id")))
    return ok, rejected


def in_id_list(df: DataFrame, col: str, csv: str, key_type: str = "long", max_ids: int = 100) -> DataFrame:
    ids = [s for s in csv.split(",")]
    vals = []
    for s in ids:
        try:
            vals.append(int(s) if key_type == "long" else s)
        except ValueError:
            continue
    if len(vals) > max_ids:
        raise ValueError(f"at most {max_ids} ids are allowed")
    return df.filter(F.col(col).isin(vals)) if vals else df.limit(0)


# F4 ---------------------------------------------------------------------------
def non_archived(projects: DataFrame) -> DataFrame:
    return projects.filter(~F.col("is_archived"))


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.filter(F.col(flag))


def unpaused(queues: DataFrame) -> DataFrame:
    return queues.filter(~F.col("is_paused"))


# F5 ---------------------------------------------------------------------------
def due_condition(rule: str, now, grace_secs: int = RECLAIM_GRACE_SECS,
                  age_secs: int = BACKFILL_AGE_SECS) -> Column:
    n = ts(now)
    if rule == "scheduled":
        return ((F.col("status") == "SCHEDULED") & F.col("scheduled_for").isNotNull()
                & (F.col("scheduled_for") <= n))
    if rule == "retry":
        return ((F.col("status") == "RETRY_WAIT") & F.col("next_retry_at").isNotNull()
                & (F.col("next_retry_at") <= n))
    if rule == "stale_lease":
        return (F.col("status").isin("RUNNING", "CLAIMED") & F.col("lease_expires_at").isNotNull()
                & (F.col("lease_expires_at") < n - secs(grace_secs)))
    if rule == "cron":
        return F.col("is_active") & F.col("next_fire_at").isNotNull() & (F.col("next_fire_at") <= n)
    if rule == "queued_aged":
        return (F.col("status") == "QUEUED") & (F.col("queued_at") < n - secs(age_secs))
    raise ValueError(f"unknown due rule {rule}")


def due(df: DataFrame, rule: str, now, **kw) -> DataFrame:
    return df.filter(due_condition(rule, now, **kw))


# F6 ---------------------------------------------------------------------------
def search_jobs(jobs: DataFrame, text: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", F.col("job_id").cast("string"), F.col("idempotency_key")))
    return jobs.filter(F.contains(hay, F.lower(F.lit(text))))


# F7 ---------------------------------------------------------------------------
def _len_between(c: str, lo: int, hi: int) -> Column:
    n = F.char_length(F.col(c))
    return (n >= lo) & (n <= hi)


def _between(c: str, lo, hi) -> Column:
    return (F.col(c) >= lo) & (F.col(c) <= hi)


def _domain(c: str, values) -> Column:
    return F.col(c).isin(*values)


def rules(table: str) -> dict[str, Column]:
    """rule name → predicate that must hold; NULL columns pass (CHECK semantics)."""
    return _rules()[table]


def _rules() -> dict[str, dict[str, Column]]:
  return {
    "queues": {
        "max_concurrency_1_1000": _between("max_concurrency", 1, 1000),
        "default_priority_0_100": _between("default_priority", 0, 100),
        "ack_wait_positive": F.col("ack_wait_secs") > 0,
        "max_receives_positive": F.col("max_receives") > 0,
        "rate_limit_positive": F.col("rate_limit") > 0,
        "rate_window_positive": F.col("rate_window_secs") > 0,
        "shard_count_1_128": _between("shard_count", 1, 128),
        "name_length_1_100": _len_between("name", 1, 100),
    },
    "jobs": {
        "priority_0_100": _between("priority", 0, 100),
        "max_attempts_1_100": _between("max_attempts", 1, 100),
        "base_delay_nonnegative": F.col("base_delay_secs") >= 0,
        "base_delay_le_max": F.col("base_delay_secs") <= F.col("max_delay_secs"),
        "shard_id_nonnegative": F.col("shard_id") >= 0,
        "status_domain": _domain("status", JOB_STATUSES),
        "kind_domain": _domain("kind", JOB_KINDS),
        "strategy_domain": _domain("retry_strategy", RETRY_STRATEGIES),
    },
    "scheduled_jobs": {
        "cron_or_run_once": F.col("cron_expr").isNotNull() | F.col("run_once_at").isNotNull(),
        "priority_0_100": _between("priority", 0, 100),
    },
    "workflow_edges": {"no_self_edge": F.col("parent_id") != F.col("child_id")},
    "capacity_tokens": {"slot_index_nonnegative": F.col("slot_index") >= 0},
    "dead_letter_entries": {"reason_domain": _domain("reason", DLQ_REASONS)},
    "org_memberships": {"role_domain": _domain("role", MEMBER_ROLES)},
    "users": {"email_length_3_255": _len_between("email", 3, 255)},
    "organizations": {"name_length_1_100": _len_between("name", 1, 100)},
    "projects": {
        "name_length_1_100": _len_between("name", 1, 100),
        "slug_length_2_50": _len_between("slug", 2, 50),
    },
    "retry_policies": {
        "max_attempts_1_100": _between("max_attempts", 1, 100),
        "base_delay_nonnegative": F.col("base_delay_secs") >= 0,
        "base_delay_le_max": F.col("base_delay_secs") <= F.col("max_delay_secs"),
        "strategy_domain": _domain("strategy", RETRY_STRATEGIES),
    },
  }


def violations(df: DataFrame, rules: dict[str, Column], id_cols) -> DataFrame:
    """One pass: (id..., rule) for every rule a row breaks (NULL passes, as CHECK)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    broken = F.filter(F.array(*[F.when(F.coalesce(~cond, F.lit(False)), F.lit(name))
                                for name, cond in rules.items()]), lambda x: x.isNotNull())
    return df.select(*ids, F.explode(broken).alias("rule"))


def unique_violations(df: DataFrame, keys, id_col: str, rule: str) -> DataFrame:
    """Rows that share a UNIQUE key with another row (NULL keys never collide)."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    nn = df
    for k in ks:
        nn = nn.filter(F.col(k).isNotNull())
    dup = nn.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).drop("__n")
    return nn.join(dup, ks, "left_semi").select(id_col, F.lit(rule).alias("rule"))


# F8 ---------------------------------------------------------------------------
def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Children whose non-null foreign key has no parent row."""
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")
