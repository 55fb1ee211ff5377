"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# One Arrow batch to a Python worker stays this small however long single texts are.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and by bytes, so a run of very long texts cannot
    fill a worker (a single text always forms at least one batch)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_names(docs: DataFrame, used: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(docs)``, a step that returns the columns it gets, with all columns but those it
    uses under numbered names meanwhile: no name in ``docs`` can clash with its helpers."""
    names = [c if c in used else f"c{i}" for i, c in enumerate(docs.columns)]
    return step(docs.toDF(*names)).toDF(*docs.columns)


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/rewritten-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions") or 200)


def positions(df: DataFrame, order: list[Column], name: str = "_at") -> DataFrame:
    """``df`` with the 0-based place of every row in ``order`` over the whole table, and the
    number ``_part`` of its range. One range-partitioned sort and one line per partition: no
    group and no range of equal keys is held by a task, as long as ``order`` tells rows
    apart. The sorted rows are checkpointed, so that places do not change when tasks run again."""
    x = cut(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part, inside = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    lines = x.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = x.withColumn("_part", part).join(F.broadcast(lines), "_part")    # a line per partition
    return joined.withColumn(name, F.col("_before") + inside).drop("_before")


def unit_hash(*cols: str | Column) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def smallest_hashes(df: DataFrame, col: str, k: int) -> DataFrame:
    """At most ``k`` distinct values of ``col``, those of smallest hash. Only the values
    below a bound that about ``4 k`` of them pass are sorted, however many partitions there
    are and however often a value comes."""
    n = df.agg(F.approx_count_distinct(col)).first()[0]
    few = df.where(F.col(col).isNotNull()).where(unit_hash(col) < min(1.0, 4.0 * k / max(1, n)))
    return few.select(col).distinct().orderBy(unit_hash(col), col).limit(k)


def few_rows(picked: DataFrame, group: list[str], k: int) -> DataFrame:
    """At most ``k`` different rows of each group of ``picked(doc_id, text, *group)``: one
    text of every doc_id first, then its further texts. A doc_id with a great many rows is
    thinned by text hash before anything is sorted."""
    key = [*group, "doc_id", "_th"]
    rows = picked.withColumn("_th", F.xxhash64("text"))
    keys = cut(rows.select(*key))
    sizes = keys.groupBy(*key[:-1]).agg(F.approx_count_distinct("_th").alias("_n"))
    thin = keys.join(F.broadcast(sizes), key[:-1]).where(unit_hash("_th") < 4.0 * k / F.col("_n")).select(*key).distinct()
    first = thin.withColumn("_k", F.row_number().over(Window.partitionBy(*key[:-1]).orderBy("_th")))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    kept = first.where(F.col("_k") <= k) \
        .withColumn("_rn", F.row_number().over(own.orderBy("_k", unit_hash("doc_id"), "doc_id", "_th"))) \
        .where(F.col("_rn") <= k).select(*key)
    return rows.join(F.broadcast(kept), key, "left_semi").dropDuplicates(key).drop("_th")


def utf8(c: str | Column) -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)
