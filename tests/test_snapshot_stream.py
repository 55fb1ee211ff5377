"""The live snapshot is right after every trigger, not only at the end."""

import datetime as dt
import random

from pyspark.sql import functions as F

from jobsight.streaming import operators as T


def test_counts_after_every_trigger(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), rng.choice(["QUEUED", "RUNNING", "FAILED"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(500)))
            for i in range(120)]
    schema = "event_id long, job_id long, status string, event_ts timestamp_ntz"
    src = str(tmp_path / "in")
    for k in range(4):                                       # one file a trigger, events out of order
        spark.createDataFrame(rows[30 * k:30 * k + 30], schema).coalesce(1).write.mode("append").parquet(src)
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = T.snapshot_stream(stream).writeStream.outputMode("complete") \
        .foreachBatch(lambda b, _: seen.append({r.status: r.n for r in b.collect()})) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4

    def want(part):
        last = {}
        for i, job, status, t in sorted(part, key=lambda r: (r[3], r[0])):
            last[job] = status
        return {s: sum(v == s for v in last.values()) for s in set(last.values())}

    files = sorted(p for p in (tmp_path / "in").glob("*.parquet"))
    files.sort(key=lambda p: p.stat().st_mtime_ns)
    arrived = []
    for n, f in enumerate(files):
        arrived += [tuple(r) for r in spark.read.parquet(str(f)).select("event_id", "job_id", "status", "event_ts").collect()]
        assert seen[n] == want(arrived)
    assert spark.read.parquet(src).select(F.count("*")).first()[0] == 120
