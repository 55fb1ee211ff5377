"""Streams with many keys, hot queues and large fan-outs: results as row by row, few calls, spread work."""

import datetime as dt
import random

import numpy as np
import pandas as pd

from jobsight.operators import joins as J
from jobsight.streaming import operators as T

BASE = dt.datetime(2024, 1, 1)


class State:
    """A group's state between calls."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_latest_status_answers_a_bucket_in_one_call():
    rng, state, last, counts = random.Random(2), State(), {}, {}
    for _ in range(5):
        rows = [(rng.randrange(40), rng.randrange(30), rng.randrange(10**6), rng.choice(["A", "B", None]), rng.choice(["1", None])) for _ in range(60)]
        df = pd.DataFrame(rows, columns=["job", "t", "eid", "status", "scope"], dtype=object).astype({"job": "int64", "t": "int64", "eid": "int64"})
        out = list(T._latest_status((3,), iter([df[:25], df[25:25], df[25:]]), state))
        assert len(out) <= 1                                         # not one frame per job
        for r in out[0].itertuples() if out else ():
            counts[r.job_id, r.scope, r.status] = counts.get((r.job_id, r.scope, r.status), 0) + r.delta
        for job, t, eid, status, scope in sorted(rows, key=lambda r: r[:3]):
            if job not in last or (t, eid) > last[job][:2]:
                last[job] = (t, eid, status, scope)
        assert {k for k, n in counts.items() if n} == {(j, v[3], v[2]) for j, v in last.items()}
        assert set(counts.values()) <= {0, 1}


def test_dag_answers_a_bucket_in_one_call():
    rng, state, got, seen = random.Random(3), State(), {}, {}
    need = {c: rng.randrange(1, 5) for c in range(30)}
    for _ in range(6):
        rows = [(c, rng.randrange(6), need[c]) for c in rng.choices(range(30), k=40)]
        df = pd.DataFrame(rows, columns=["child_id", "parent_id", "needed"])
        want = {}
        for c, p, _ in rows:
            if c not in got:
                seen.setdefault(c, set()).add(p)
        want = {c: len(seen[c]) for c, _, _ in rows if c not in got and len(seen[c]) >= need[c]}
        out = list(T._dag_state((0,), iter([df[:10], df[10:]]), state))
        assert len(out) <= 1
        now = {r.child_id: r.parents for f in out for r in f.itertuples()}
        assert now == want
        got |= now
    assert got and not set(state.value[0]) & set(state.value[2])


def test_admission_holds_two_numbers_a_row_and_answers_in_chunks():
    rng, state, acc, frames = random.Random(4), State(), [], []
    for k in range(4):                                               # later micro-batches bring some earlier times
        t = np.array([rng.randrange(900 * k, 900 * k + 1_000) for _ in range(15_000)], np.int64)
        df = pd.DataFrame({"__id": rng.sample(range(10**6), len(t)), "queue_id": "q", "__t": t})
        out = list(T._admit_state(3, 20)(("q",), iter([df[:9_000], df[9_000:]]), state))
        assert len(out) == 2 and max(map(len, out)) <= T._OUT_ROWS
        want = []
        for i, v in sorted(zip(df["__id"], df["__t"]), key=lambda r: (r[1], r[0])):
            acc = [a for a in acc if a >= v - 20]
            want.append((i, len(acc) < 3))
            if want[-1][1]:
                acc.append(v)
        frames = pd.concat(out)
        assert list(zip(frames["id"], frames["accepted"])) == want


def test_admission_stream_without_time_or_id(spark, tmp_path):
    rows = [(1, "a", BASE), (None, "a", BASE + dt.timedelta(seconds=1)), (3, None, BASE), (4, "a", None), (5, "a", BASE + dt.timedelta(hours=2))]
    schema = "arrival_id long, queue_id string, event_ts timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    from jobsight.streaming.runner import run_to_table
    out = run_to_table(T.admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1, 3600), "odd")
    assert {(r.arrival_id, r.queue_id, r.accepted) for r in out.collect()} == {
        (1, "a", True), (None, "a", False), (3, None, True), (4, "a", False), (5, "a", True)}


def test_fan_out_is_spread(spark):
    """A few rows and members per org meet in many tasks, each pair once; copies stay copies."""
    queues = spark.createDataFrame([(q, q % 4) for q in range(60)], "queue_id long, project_id long")
    projects = spark.createDataFrame([(p, p % 2) for p in range(4)], "project_id long, org_id long")
    members = spark.createDataFrame([(u % 2, u) for u in range(50)], "org_id long, user_id long")
    rows = spark.createDataFrame([(i, i % 60) for i in range(300)] + [(0, 0), (1, None), (2, 99)], "job_id long, queue_id long")
    out = J.visible_to(rows, queues, projects, members)
    got = [(r.user_id, r.job_id) for r in out.select("user_id", "job_id").collect()]
    want = [(u, i) for i, q in [(i, i % 60) for i in range(300)] + [(0, 0)] for u in range(50) if u % 2 == q % 4 % 2]
    assert sorted(got) == sorted(want)
    assert sum(n > 0 for n in out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 20
