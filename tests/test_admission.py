"""Exact admission over pieces: equal to the sequential rule whatever the guesses are."""

import datetime as dt
import random
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsight.operators import admission as A

SCHEMA = "arrival_id long, queue_id string, event_ts timestamp_ntz"
BASE = dt.datetime(2024, 1, 1)


def model(rows, limit, window):
    """Arrival by arrival: {arrival_id: accepted} for rows (id, queue, seconds)."""
    last, out = {}, {}
    for i, q, s in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        kept = last.setdefault(q, deque())
        while kept and kept[0] < s - window:
            kept.popleft()
        out[i] = len(kept) < limit
        if out[i]:
            kept.append(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, q, BASE + dt.timedelta(seconds=s)) for i, q, s in rows], SCHEMA)


def runs(monkeypatch):
    """Counts the passes over arrivals."""
    seen, real = [], A._run
    monkeypatch.setattr(A, "_run", lambda *a: seen.append(1) or real(*a))
    return seen


def test_queue_without_gap_spreads_over_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "hot", t) for i, t in enumerate(sorted(rng.choices(range(40_000), k=30_000)))]
    seen = runs(monkeypatch)
    out = A.admit(frame(spark, rows), 3, 10, piece_micros=1).collect()
    assert {r.arrival_id: r.accepted for r in out} == model(rows, 3, 10)
    assert len(seen) <= 6                       # 125 pieces, but few rounds
    assert {r.queue_id for r in out} == {"hot"} and len(out) == len(rows)


def test_runs_that_never_agree(spark, monkeypatch):
    """Arrivals every 3 s, one per 10 s: which of them is accepted depends on the very first,
    so each round puts one more piece right."""
    rows = [(i, "q", 3 * i) for i in range(600)] + [(10_000 + i, "r", 3 * i + 1) for i in range(300)] + [(20_000, "r", 0)]
    monkeypatch.setattr(A, "TAIL_WINDOWS", 1)
    out = A.admit(frame(spark, rows), 1, 10, piece_micros=1)
    assert {r.arrival_id: r.accepted for r in out.collect()} == model(rows, 1, 10)


def test_edges(spark):
    rows = [(1, None, 0), (2, None, 1), (3, "", 1), (4, "a", 5), (4, "a", 5), (5, "a", 5), (6, "a", -70_000), (7, "a", 15)]
    df = frame(spark, rows).unionByName(spark.createDataFrame([(9, "a", None)], SCHEMA))
    got = sorted((r.arrival_id, r.queue_id, r.accepted) for r in A.admit(df, 1, 10).collect() if r.queue_id is not None)
    assert got == [(3, "", True), (4, "a", False), (4, "a", True), (5, "a", False), (6, "a", True), (7, "a", False), (9, "a", False)]
    assert [r.accepted for r in A.admit(df.where("queue_id IS NULL"), 1, 10).orderBy("arrival_id").collect()] == [True, False]
    assert A.admit(df.limit(0), 1, 10).collect() == []
    assert all(r.accepted for r in A.admit(df.where("event_ts IS NOT NULL"), None, 10).collect())
    assert not any(r.accepted for r in A.admit(df, 0, 10).collect())


def test_limits_by_queue(spark):
    rng = random.Random(5)
    rows = [(i, f"q{i % 4}", rng.randrange(5_000)) for i in range(4_000)]
    qs = spark.createDataFrame([("q0", 1, 7), ("q1", 40, 100), ("q2", 5, 1), ("q9", 1, 1)],
                               "queue_id string, rate_limit long, rate_window_secs long")
    got = {r.arrival_id: r.accepted for r in A.admit(frame(spark, rows), queues=qs, piece_micros=1).collect()}
    want = {}
    for q, lim, w in (("q0", 1, 7), ("q1", 40, 100), ("q2", 5, 1), ("q3", 10**9, 1)):
        want |= model([r for r in rows if r[1] == q], lim, w)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(0, 5), st.integers(0, 20), st.integers(0, 60))
def test_accept_in_parts(times, limit, window, split):
    t = np.array(sorted(times), dtype=np.int64)
    want = model([(i, "q", int(v)) for i, v in enumerate(t)], limit, window)
    a, kept = A.accept(t[:split], t[:0], limit, window)
    b, _ = A.accept(t[split:], kept, limit, window)
    assert np.concatenate([a, b]).tolist() == [want[i] for i in range(len(t))]


@pytest.mark.parametrize("batch", [1, 7])
def test_pieces_over_arrow_batches(spark, batch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(900)) for i in range(700)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.arrival_id: r.accepted for r in A.admit(frame(spark, rows), 2, 9, piece_micros=1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == model(rows, 2, 9)


def test_queue_of_few_rows_is_one_piece(spark, monkeypatch):
    """Dense arrivals whose runs do not agree, over a hundred long windows: no round at all;
    with few rows a piece as many pieces as that takes, and the same decisions."""
    rng = random.Random(6)
    rows = [(i, q, rng.randrange(400 * 3600)) for i, q in enumerate(["a", "b"] * 3_000)]
    seen = runs(monkeypatch)
    got = {r.arrival_id: r.accepted for r in A.admit(frame(spark, rows), 3, 3600).collect()}
    assert got == model(rows, 3, 3600) and len(seen) == 3
    got = {r.arrival_id: r.accepted for r in A.admit(frame(spark, rows), 3, 3600, piece_rows=700).collect()}
    assert got == model(rows, 3, 3600)


def test_pieces_of_single_cells_that_never_agree(spark, monkeypatch):
    """As above, with a piece for each cell, so that the rounds run."""
    rows = [(i, "q", 3 * i) for i in range(400)] + [(10_000 + i, "r", 3 * i + 1) for i in range(200)] + [(20_000, "r", 0)]
    monkeypatch.setattr(A, "TAIL_WINDOWS", 1)
    seen = runs(monkeypatch)
    got = A.admit(frame(spark, rows), 1, 10, piece_micros=1, piece_rows=1).collect()
    assert {r.arrival_id: r.accepted for r in got} == model(rows, 1, 10) and len(seen) > 3
