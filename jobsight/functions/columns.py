"""Scalar Column → Column functions. All built-in expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import JOB_KINDS, JOB_STATUSES, WORKER_ONLINE_SECS, WORKER_STALE_SECS
from ..session import secs, ts


def _v(x) -> Column:
    """Column from a name or a Column; python numbers become literals."""
    if isinstance(x, Column):
        return x
    if isinstance(x, (int, float, bool)) or x is None:
        return F.lit(x)
    return F.col(x)


# G1 ---------------------------------------------------------------------------
def retry_delay_secs(strategy, base, max_delay, attempt) -> Column:
    """fixed = b, linear = b·n, exponential = b·2^(n-1), n = max(attempt, 1);
    clamped to [0, max]. Computed in double with a capped exponent, so it never
    overflows; exact while max < 2^53."""
    st, b, mx, a = _v(strategy), _v(base).cast("double"), _v(max_delay).cast("double"), _v(attempt)
    n = F.greatest(a.cast("long"), F.lit(1).cast("long"))
    raw = (F.when(st == "fixed", b)
            .when(st == "linear", b * n.cast("double"))
            .otherwise(b * F.pow(F.lit(2.0), F.least(n - 1, F.lit(62)).cast("double"))))
    return F.floor(F.greatest(F.least(raw, mx), F.lit(0.0))).cast("long")


# G2 ---------------------------------------------------------------------------
def plus_secs(t, seconds) -> Column:
    """``t`` (column name or Column) plus a number of seconds: next_retry_at, lease expiry."""
    return _v(t) + secs(_v(seconds))


# G3 ---------------------------------------------------------------------------
def priority_tier(priority) -> Column:
    p = _v(priority)
    return F.when(p >= 10, "high").when(p > 0, "standard").otherwise("low")


# G4 / G5 / G6 -----------------------------------------------------------------
def subject_prefix(org, proj, queue) -> Column:
    return F.concat(F.lit("org."), _v(org).cast("string"), F.lit(".proj."), _v(proj).cast("string"),
                    F.lit(".queue."), _v(queue).cast("string"))


def subject(org, proj, queue, shard_count, shard, priority) -> Column:
    """Plain subject when the queue has at most one shard, else the shard subject."""
    pre = subject_prefix(org, proj, queue)
    tier = priority_tier(priority)
    sharded = F.coalesce(_v(shard_count), F.lit(1)) > 1
    return F.when(sharded, F.concat(pre, F.lit(".shard."), _v(shard).cast("string"), F.lit("."), tier)) \
        .otherwise(F.concat(pre, F.lit("."), tier))


def stream_name(org, proj, queue) -> Column:
    return F.translate(F.concat(F.lit("JOBS_"), _v(org).cast("string"), F.lit("_"), _v(proj).cast("string"),
                                F.lit("_"), _v(queue).cast("string")), "-", "_")


WILDCARD_SUBJECT = "org.*.proj.*.queue.*.>"


def stream_for_subject(subj) -> Column:
    s = _v(subj)
    parts = F.split(s, r"\.")
    p = lambda i: F.get(parts, i)  # noqa: E731  (null when out of range)
    parsed = ((F.size(parts) >= 6) & (p(0) == "org") & (p(2) == "proj") & (p(4) == "queue"))
    return (F.when(s == WILDCARD_SUBJECT, F.lit("JOBS_WILDCARD"))
             .when(parsed, F.translate(F.concat_ws("_", F.lit("JOBS"), p(1), p(3), p(5)), "-", "_"))
             .otherwise(F.concat(F.lit("JOBS_"), F.translate(s, ".-", "__"))))


# G8 ---------------------------------------------------------------------------
_MASK32 = 0xFFFFFFFF


def shard_for_key(key, shard_count) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, unsigned modulo max(n, 1).

    The 64-bit state is kept as two 32-bit halves in longs (the prime is
    2^40 + 435), so no intermediate exceeds 2^42 and ANSI overflow never fires."""
    k = _v(key).cast("string")
    hx = F.hex(k.cast("binary"))
    ln = F.octet_length(k)
    pos = F.filter(F.sequence(F.lit(1), F.greatest(ln, F.lit(1))), lambda i: i <= ln)
    data = F.transform(pos, lambda i: F.conv(F.substr(hx, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    init = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc, b):
        x = acc["lo"].bitwiseXOR(b)
        hi = (acc["hi"] * 435 + F.shiftleft(x, 8) + F.shiftright(x * 435, 32)).bitwiseAND(F.lit(_MASK32))
        lo = (x * 435).bitwiseAND(F.lit(_MASK32))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    h = F.aggregate(data, init, step)
    n = F.greatest(F.coalesce(_v(shard_count).cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    return (((h["hi"] % n) * (F.lit(1 << 32).cast("long") % n) + h["lo"] % n) % n).cast("long")


# G9 ---------------------------------------------------------------------------
def worker_status(last_hb, now, online_secs: int = WORKER_ONLINE_SECS,
                  stale_secs: int = WORKER_STALE_SECS) -> Column:
    hb, n = _v(last_hb), ts(now)
    return (F.when(hb.isNull(), "OFFLINE")
             .when(hb > n - secs(online_secs), "ONLINE")
             .when(hb > n - secs(stale_secs), "STALE")
             .otherwise("OFFLINE"))


# G10 / G11 / G12 --------------------------------------------------------------
def normalize_status(s) -> Column:
    u = F.upper(F.replace(_v(s), F.lit("-"), F.lit("_")))
    return (F.when(u == "RETRYWAIT", "RETRY_WAIT")
             .when(u == "UNKNOWN", "UNKNOWN_EXTERNAL_RESULT")
             .when(u.isin(*JOB_STATUSES), u))


def normalize_strategy(s) -> Column:
    v = _v(s)
    return F.when(v.isin("fixed", "linear"), v).otherwise("exponential")


def normalize_kind(kind, job_type=None) -> Column:
    v = F.coalesce(_v(kind), _v(job_type) if job_type is not None else F.lit(None), F.lit("immediate"))
    return F.when(v.isin(*[k for k in JOB_KINDS if k != "immediate"]), v).otherwise("immediate")


def first_present(*cols) -> Column:
    """Default precedence: the first non-null of the arguments (header > body, item > request > queue)."""
    return F.coalesce(*[_v(c) for c in cols])


# G13 / G14 --------------------------------------------------------------------
def payload_type(payload) -> Column:
    return F.coalesce(F.get_json_object(_v(payload), "$.type"), F.lit("echo"))


def payload_secs(payload) -> Column:
    raw = F.get_json_object(_v(payload), "$.secs")
    return F.coalesce(F.when(raw.rlike(r"^[0-9]+$"), raw.cast("long")), F.lit(1).cast("long"))


def payload_force_unknown(payload) -> Column:
    raw = F.get_json_object(_v(payload), "$.force_unknown")
    return F.coalesce(F.when(raw.isin("true", "false"), raw == "true"), F.lit(False))


def to_json_object(**fields) -> Column:
    """JSON object text; null fields are written as null (not dropped)."""
    return F.to_json(F.struct(*[_v(v).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


# G15 / G16 / G19 --------------------------------------------------------------
def epoch_micros(t) -> Column:
    c = _v(t)
    return F.unix_micros(c.cast("timestamp"))


def duration_ms(start, end) -> Column:
    return F.round((epoch_micros(end) - epoch_micros(start)) / F.lit(1000.0)).cast("long")


def occurrence_key(schedule_id, fire_time) -> Column:
    return F.concat(_v(schedule_id).cast("string"), F.lit(":"),
                    F.date_format(_v(fire_time), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


# fixed value: the operator-facing failure prompt and its defaults
FAILURE_PROMPT = ("Summarize this failed background job for an operator. Do not invent facts. "
                  "Return JSON only with summary, root_cause, remediation. "
                  "Error kind: %s. Final error: %s. Attempts: %s.")
FAILURE_PROMPT_DEFAULTS = ("unknown", "no error message recorded")


def failure_prompt(error_kind, final_error, attempt) -> Column:
    return F.format_string(FAILURE_PROMPT, F.coalesce(_v(error_kind), F.lit(FAILURE_PROMPT_DEFAULTS[0])),
                           F.coalesce(_v(final_error), F.lit(FAILURE_PROMPT_DEFAULTS[1])),
                           _v(attempt).cast("string"))


# Derived keys -------------------------------------------------------------------
def derived_id(*parts) -> Column:
    """Deterministic 60-bit id from the parts: the first 15 hex digits of
    sha256(concat_ws(':', parts)). Replaces random UUIDs so reruns (and task
    retries) produce the same keys."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)
    return F.conv(F.substr(h, F.lit(1), F.lit(15)), 16, 10).cast("long")


def derived_id_sql(*parts: str) -> str:
    """DuckDB text of ``derived_id`` for the oracle (parts are SQL expressions)."""
    inner = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(sha256({inner}), 1, 15)) AS BIGINT)"
