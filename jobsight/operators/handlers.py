"""Outcome rules per payload type (X1): what a job's handler reports, as columns.

Each type has a rule, a struct column (outcome, result, error_message, error_kind) over
the job's payload and attempt; a type without one is a permanent ``no_handler`` failure.
The result feeds the completion (B7) and failure (B8) transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import payload_force_unknown, payload_secs, payload_type

# ---- fixed values: outcome texts of the built-in rules --------------------------
ALWAYS_FAIL_MESSAGE = "intentional test failure"
ALWAYS_FAIL_KIND = "test_failure"
UNKNOWN_MESSAGE = "payment request sent but response timeout - unknown if succeeded"
UNKNOWN_KIND = "external_timeout"
NO_HANDLER_MESSAGE = "no handler registered for job type '%s'"
NO_HANDLER_KIND = "no_handler"
# -------------------------------------------------------------------------------


def outcome(kind: str, result: Column | None = None, message: str | Column | None = None,
            error: str | None = None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(F.lit(kind).alias("outcome"), text(result).alias("result"),
                    text(message).alias("error_message"), text(error).alias("error_kind"))


def default_rules() -> dict[str, Column]:
    """By payload type; JSON keys in sorted order."""
    paid = outcome("ok", F.to_json(F.struct(F.col("job_id").alias("idempotency"), F.lit("confirmed").alias("payment"))))
    return {
        "echo": outcome("ok", F.to_json(F.struct("attempt", F.lit(True).alias("echoed")))),
        "sleep": outcome("ok", F.to_json(F.struct(payload_secs("payload").alias("slept_secs")))),
        "always_fail": outcome("retry", None, ALWAYS_FAIL_MESSAGE, ALWAYS_FAIL_KIND),
        "external_payment": F.when(payload_force_unknown("payload") | (F.col("attempt") == 1),
                                   outcome("unknown", None, UNKNOWN_MESSAGE, UNKNOWN_KIND)).otherwise(paid),
    }


def apply_handlers(jobs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(job_id, type, outcome, result, error_message, error_kind) per job."""
    x = jobs.withColumn("type", payload_type("payload"))
    rule = F.when(F.lit(False), outcome("ok"))
    for name, value in (default_rules() if rules is None else rules).items():
        rule = rule.when(F.col("type") == name, value)
    rule = rule.otherwise(outcome("permanent", None, F.format_string(NO_HANDLER_MESSAGE, "type"), NO_HANDLER_KIND))
    return x.select("job_id", "type", rule.alias("__o")).select("job_id", "type", "__o.*")


def reports_from_results(results: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split results into completion and failure reports for B7/B8."""
    j = jobs.select("job_id", F.col("lease_owner").alias("worker_id"), F.col("lease_epoch").alias("epoch"))
    r = results.join(j, "job_id")
    done = r.filter(F.col("outcome") == "ok").select("job_id", "worker_id", "epoch", "result")
    failed = r.filter(F.col("outcome") != "ok").select("job_id", "worker_id", "epoch", "outcome",
                                                       "error_message", "error_kind")
    return done, failed
