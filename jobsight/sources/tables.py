"""Typed scan of stored job-ops tables (S1).

Tables live as parquet folders ``<dir>/<table>/``; each is read with its
declared schema (no inference), so Catalyst prunes columns and pushes filters
into the scan. ``save_ops`` writes derived views in the same layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import SCHEMAS


class StoredOps:
    """Lazy typed access: ``StoredOps(spark, dir).jobs``."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.dir = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}")


def load_ops(spark: SparkSession, d: str) -> StoredOps:
    return StoredOps(spark, d)


def save_ops(ops, d: str, names=None, mode: str = "overwrite") -> None:
    """Write views (with the declared column set and order) as parquet folders."""
    for name in names or SCHEMAS:
        df = getattr(ops, name)
        cols = [f.name for f in SCHEMAS[name].fields if f.name in df.columns]
        df.select(*cols).write.mode(mode).parquet(f"{d}/{name}")
