"""Stream sources, sinks and a bounded runner.

``stream_table`` reads one supplied table as a file stream; ``run_to_table``
drives a streaming query with ``trigger(availableNow=True)`` into a parquet
folder under the shared checkpoint directory (never the driver) and returns a
batch DataFrame over it. The sinks are written per micro-batch with
``foreachBatch`` so output modes that parquet does not support (update,
complete) still land idempotently: every batch write is keyed by epoch id."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..session import checkpoint_dir


# S2 ---------------------------------------------------------------------------
def stream_table(spark: SparkSession, d: str, name: str, max_files: int | None = None) -> DataFrame:
    """A supplied table as a streaming source with its declared (batch) schema."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(d)


def arrivals_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                    max_files: int | None = None) -> DataFrame:
    """Job-message source over a folder of files (parquet or json)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format(fmt).load(path)


def event_time(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables store TIMESTAMP_NTZ (UTC wall clock)."""
    return df.withColumn(out or col, F.col(col).cast("timestamp"))


def _out_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run ``stream`` to the end of its available input; return its result.

    Each micro-batch overwrites its own ``__epoch=<id>`` folder, so a retried
    batch replaces its earlier attempt (exactly-once output). append: all
    epochs; complete: the last epoch; update: the latest row per ``keys``."""
    spark = stream.sparkSession
    out = _out_dir(spark, name)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/__epoch=-1")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if mode == "complete":
        last = res.agg(F.max("__epoch").alias("__last"))
        return res.join(last, res["__epoch"] == last["__last"], "left_semi").drop("__epoch")
    if mode == "update" and keys:
        cols = [c for c in res.columns if c not in keys and c != "__epoch"]
        g = res.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("__epoch")).alias("__r"))
        return g.select(*keys, *[F.col("__r")[c].alias(c) for c in cols])
    return res.drop("__epoch")


# S4 ---------------------------------------------------------------------------
PUBLISH_DAY = "publish_day"


def _days_near(batch: DataFrame, ts_col: str, horizon_days: int):
    """The days on which a copy of one of the batch's rows can stand; a null time has the
    null day. At most one value per calendar day comes to the driver, whatever the batch's size."""
    days = {r[0] for r in batch.select(F.to_date(ts_col)).distinct().toLocalIterator()}
    near = sorted({d + dt.timedelta(k) for d in days if d is not None for k in range(-horizon_days, horizon_days + 1)})
    return near, None in days


def publish_once(batch: DataFrame, target: str, key: str = "msg_id", ts_col: str = "ts",
                 horizon_days: int = 1) -> None:
    """At-least-once delivery made idempotent: rows whose key already stands in the target
    folder within ``horizon_days`` of their day, or earlier in the batch, are not appended.

    The target is partitioned by the day of ``ts_col``, and only the days that the batch's
    rows can meet are read, so the work follows the batch and not the target's age. Of
    several copies in a batch the earliest is kept (null times first). A null key equals no
    other: such rows are appended each."""
    spark = batch.sparkSession
    near, has_null = _days_near(batch, ts_col, horizon_days)
    if not near and not has_null:
        return
    cols = batch.columns
    keyed = batch.filter(F.col(key).isNotNull())
    rest = [c for c in cols if c not in (key, ts_col)]
    first = keyed.groupBy(key).agg(F.min(F.struct(ts_col, *rest)).alias("__first")) \
        .select(*[F.col(key) if c == key else F.col("__first")[c].alias(c) for c in cols])
    fresh = first.join(published(spark, target, batch, near, has_null).select(key), key, "left_anti") \
        .select(*cols).unionByName(batch.filter(F.col(key).isNull()))
    # whole days in few files, a day with many rows in several
    fresh.withColumn(PUBLISH_DAY, F.to_date(ts_col)).hint("rebalance", PUBLISH_DAY) \
        .write.mode("append").partitionBy(PUBLISH_DAY).parquet(target)


def published(spark: SparkSession, target: str, like: DataFrame, days=None, null_day: bool = False) -> DataFrame:
    """The rows of the target, of the given days only if any are named; empty before the first batch."""
    like.limit(0).withColumn(PUBLISH_DAY, F.lit(None).cast("date")).write.mode("append").partitionBy(PUBLISH_DAY).parquet(target)
    rows = spark.read.schema(StructType([*like.schema.fields, StructField(PUBLISH_DAY, DateType())])).parquet(target)
    if days is None:
        return rows.drop(PUBLISH_DAY)
    wanted = F.col(PUBLISH_DAY).isin(days) if days else F.lit(False)
    return rows.filter(wanted | F.col(PUBLISH_DAY).isNull() if null_day else wanted).drop(PUBLISH_DAY)


def publish_stream(stream: DataFrame, target: str, key: str = "msg_id", checkpoint: str | None = None,
                   ts_col: str = "ts", horizon_days: int = 1):
    return (stream.writeStream.foreachBatch(lambda b, _e: publish_once(b, target, key, ts_col, horizon_days))
            .option("checkpointLocation", checkpoint or target + "-checkpoint").trigger(availableNow=True).start())


# S5 ---------------------------------------------------------------------------
def append_events(df: DataFrame, path: str, ts_col: str, checkpoint: str | None = None):
    """Append event rows partitioned by day (batch or stream)."""
    x = df.withColumn("event_date", F.to_date(F.col(ts_col)))
    if df.isStreaming:
        return (x.writeStream.format("parquet").partitionBy("event_date").option("path", path)
                 .option("checkpointLocation", checkpoint or path + "-checkpoint")
                 .trigger(availableNow=True).start())
    x.write.mode("append").partitionBy("event_date").parquet(path)
    return None
