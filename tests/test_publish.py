"""Idempotent publish into a target partitioned by day."""

import datetime as dt
import os
import tempfile

from jobsight.streaming.runner import publish_once, publish_stream, published

SCHEMA = "msg_id long, body string, ts timestamp_ntz"


def _at(day, hour=12, minute=0):
    return dt.datetime(2024, 5, day, hour, minute)


def _target():
    return tempfile.mkdtemp(prefix="jobsight-publish-") + "/out"


def _rows(spark, target, like):
    return sorted(((r.msg_id or -1, r.body, str(r.ts)) for r in published(spark, target, like).collect()))


def test_copies_are_appended_once(spark):
    t = _target()
    one = spark.createDataFrame([(1, "a", _at(1)), (1, "a", _at(1, 12, 1)), (2, "b", _at(1, 23, 59)), (None, "x", _at(1)),
                                 (None, "x", _at(1)), (3, None, None)], SCHEMA)
    publish_once(one, t)
    first = _rows(spark, t, one)
    assert first == sorted([(1, "a", "2024-05-01 12:00:00"), (2, "b", "2024-05-01 23:59:00"), (-1, "x", "2024-05-01 12:00:00"),
                            (-1, "x", "2024-05-01 12:00:00"), (3, None, "None")])
    # again, one of them past midnight, with a new row
    two = spark.createDataFrame([(1, "a", _at(1)), (2, "b", _at(2, 0, 1)), (3, None, None), (4, "d", _at(2))], SCHEMA)
    publish_once(two, t)
    assert _rows(spark, t, one) == sorted([*first, (4, "d", "2024-05-02 12:00:00")])
    publish_once(two.limit(0), t)
    assert len(_rows(spark, t, one)) == 6


def test_only_days_near_the_batch_are_read(spark):
    """A day far from the batch holds a file that cannot be read: nothing notices."""
    t = _target()
    publish_once(spark.createDataFrame([(i, "a", _at(i)) for i in (1, 10, 11, 12, 20)], SCHEMA), t)
    for day in (1, 20):
        with open(f"{t}/publish_day=2024-05-{day:02d}/broken.parquet", "wb") as f:
            f.write(b"no parquet file at all")
    more = spark.createDataFrame([(10, "again", _at(11)), (30, "new", _at(11))], SCHEMA)
    publish_once(more, t)
    near = [dt.date(2024, 5, d) for d in (10, 11, 12)]
    got = published(spark, t, more, near)
    assert sorted((r.msg_id, r.body) for r in got.collect()) == [(10, "a"), (11, "a"), (12, "a"), (30, "new")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [publish_day" in plan


def test_stream_of_files(spark):
    src, t = tempfile.mkdtemp(prefix="jobsight-publish-src-"), _target()
    df = spark.createDataFrame([(i % 40, "m", _at(1 + i % 3)) for i in range(120)], SCHEMA)
    df.repartition(5).write.mode("append").parquet(src)
    for _ in range(2):      # the second run, with its own checkpoint, delivers all again
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
        publish_stream(stream, t, checkpoint=tempfile.mkdtemp(prefix="jobsight-publish-ck-"), horizon_days=3).awaitTermination()
    assert sorted(r.msg_id for r in published(spark, t, df).collect()) == list(range(40))
    assert len([d for d in os.listdir(t) if d.startswith("publish_day=")]) <= 4
