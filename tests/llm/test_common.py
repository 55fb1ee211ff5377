"""Shared helpers of the corpus operators."""

from pyspark.sql import functions as F

from jobsight.llm.common import smallest_hashes, unit_hash


def test_smallest_hashes_are_found_among_repeated_values(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 300).alias("v"))
    want = [r.v for r in df.where("v is not null").distinct().orderBy(unit_hash("v"), "v").limit(40).collect()]
    assert len(want) == 40 and sorted(r.v for r in smallest_hashes(df, "v", 40).collect()) == sorted(want)
    assert len(smallest_hashes(df, "v", 1000).collect()) == 300
    assert smallest_hashes(df.limit(0), "v", 5).collect() == []
