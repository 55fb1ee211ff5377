"""Structured Streaming operators (T1–T7).

Stateful steps use ``applyInPandasWithState`` keyed by job or queue, so
state is partitioned across executors and checkpointed with the query; each
key's state is small (a status, a few timestamps). Where millions of keys have little to do
each (T2, T7), they are dealt into ``BUCKETS`` groups by hash: a call answers a whole
bucket, and the bucket's state is one array per field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import DECLARED_TRANSITIONS
from ..operators.admission import accept
from ..operators.windows import INITIAL_STATUSES


def _whole(pdfs: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame | None:
    """All rows of a group in this micro-batch, sorted: they come in Arrow chunks of any
    order. Rows behind the watermark do not come at all."""
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts).sort_values(list(order)) if parts else None


BUCKETS = 4096
_LEAST = -(1 << 63)


def _bucket(key: str) -> Column:
    """A key's bucket; null keys have one of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).alias("__bucket")


# T1 ---------------------------------------------------------------------------
def dedup_messages(stream: DataFrame, ts_col: str = "ts", key: str = "msg_id",
                   window: str = "2 minutes") -> DataFrame:
    """Broker-style dedup: a message id seen again within the window is dropped."""
    return (stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
                  .withWatermark(ts_col, window).dropDuplicatesWithinWatermark([key]))


# T2 ---------------------------------------------------------------------------
_STATUS_STATE = "job array<long>, t array<long>, eid array<long>, status array<string>, scope array<string>"


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["job", "t", "eid"], kind="stable").drop_duplicates("job", keep="last")


def _latest_status(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    """Only a job's latest row of the micro-batch can matter: one change at most. Of a
    bucket's rows the latest of each job are kept while its chunks come in."""
    names = ["job", "t", "eid", "status", "scope"]
    new = None
    for p in pdfs:
        if len(p):
            new = _newest(p[names] if new is None else pd.concat([new, p[names]]))
    if new is None:
        return
    job, t, eid = (new[c].to_numpy(np.int64) for c in names[:3])
    told = new[["status", "scope"]].to_numpy(object)                 # null is None in both
    held = state.get if state.exists else ([], [], [], [], [])
    was_job, was_t, was_eid = (np.array(v, np.int64) for v in held[:3])
    was = np.empty((len(was_job), 2), object)
    was[:, 0], was[:, 1] = held[3], held[4]
    at = np.searchsorted(was_job, job)
    known = np.zeros(len(job), bool)
    known[at < len(was_job)] = was_job[at[at < len(was_job)]] == job[at < len(was_job)]
    later = ~known
    k = at[known]
    later[known] = (t[known] > was_t[k]) | ((t[known] == was_t[k]) & (eid[known] > was_eid[k]))
    moved, fresh = later & known, ~known
    k = at[moved]
    other = (told[moved] != was[k]).any(axis=1)
    gone, gone_job = was[k][other], job[moved][other]
    was_t[k], was_eid[k], was[k] = t[moved], eid[moved], told[moved]
    come = fresh.copy()
    come[np.flatnonzero(moved)[other]] = True
    all_job = np.concatenate([was_job, job[fresh]])
    order = np.argsort(all_job, kind="stable")
    all_told = np.concatenate([was, told[fresh]])[order]
    state.update((all_job[order].tolist(), np.concatenate([was_t, t[fresh]])[order].tolist(),
                  np.concatenate([was_eid, eid[fresh]])[order].tolist(), all_told[:, 0].tolist(), all_told[:, 1].tolist()))
    if come.any():
        rows = np.concatenate([told[come], gone])
        yield pd.DataFrame({"bucket": key[0], "job_id": np.concatenate([job[come], gone_job]), "scope": rows[:, 1], "status": rows[:, 0],
                            "delta": np.repeat(np.array([1, -1], np.int64), [int(come.sum()), len(gone)])})


def status_deltas(events: DataFrame, ts_col: str = "event_ts", scope: str | None = None) -> DataFrame:
    """Per job, ±1 deltas whenever its latest status (by time, id; null is before any other)
    changes; an optional ``scope`` column (e.g. project_id) travels with the deltas."""
    sc = F.col(scope).cast("long") if scope else F.lit(None).cast("long")
    least = F.lit(_LEAST)
    x = events.select(_bucket("job_id"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job"), F.coalesce(
        F.unix_micros(F.col(ts_col).cast("timestamp")), least).alias("t"), F.coalesce(F.col("event_id").cast("long"), least).alias("eid"),
        "status", sc.cast("string").alias("scope"))                  # a null makes a pandas column of longs one of floats
    out = x.groupBy("__bucket").applyInPandasWithState(
        _latest_status, "bucket int, job_id long, scope string, status string, delta long", _STATUS_STATE, "append",
        GroupStateTimeout.NoTimeout)
    return out.select(F.when(F.col("bucket") >= 0, F.col("job_id")).alias("job_id"), F.col("scope").cast("long").alias("scope"),
                      "status", "delta")


def snapshot_stream(events: DataFrame, scope: str | None = None) -> DataFrame:
    """Live counts of jobs by latest status (per ``scope`` when given): one query of two
    chained stateful steps, the latest status of each job and the sum of the ±1 changes.
    To be written in complete or update mode; counts that fell to 0 are left out."""
    keys = (["scope"] if scope else []) + ["status"]
    out = status_deltas(events, scope=scope).groupBy(*keys).agg(F.sum("delta").cast("long").alias("n")).filter(F.col("n") != 0)
    return out.withColumnRenamed("scope", scope) if scope else out


# T3 ---------------------------------------------------------------------------
def liveness_sessions(hb: DataFrame, gap: str = "1 hour", ts_col: str = "heartbeat_at",
                      key: str = "worker_id", watermark: str | None = None) -> DataFrame:
    """Heartbeat sessions per worker: a gap of ``gap`` or more starts a new one.
    With ``watermark`` the query runs in append mode and state for closed
    sessions is dropped (unbounded streams); without it, complete mode."""
    x = hb.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if watermark:
        x = x.withWatermark(ts_col, watermark)
    s = x.groupBy(key, F.session_window(ts_col, gap).alias("s")).agg(F.count(F.lit(1)).alias("beats"))
    return s.select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "beats")


# T4 ---------------------------------------------------------------------------
_OUT_ROWS = 10_000


def _accept_late(t: np.ndarray, kept: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``accept`` where arrivals may lie before accepted ones of an earlier micro-batch: those
    are decided one by one."""
    late = int(np.searchsorted(t, kept.max(), side="left")) if len(kept) else 0
    ok, acc = np.zeros(late, bool), kept.tolist()
    for i, v in enumerate(t[:late].tolist()):
        acc = [a for a in acc if a >= v - window]
        ok[i] = len(acc) < limit
        if ok[i]:
            acc.append(v)
    rest, kept = accept(t[late:], np.sort(np.array(acc, np.int64)), limit, window)
    return np.concatenate([ok, rest]), kept


def _admit_state(limit: int, window_us: int):
    """A queue's arrivals of a micro-batch come in chunks of any order. They are held as two
    numbers each, time and id, sorted, and answered in chunks."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        kept = np.array(state.get[0] if state.exists else [], np.int64)
        parts = [(p["__t"].to_numpy(np.int64), p["__id"].to_numpy(np.int64)) for p in pdfs if len(p)]
        if not parts:
            return
        t = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[1] for p in parts])
        parts.clear()
        order = np.lexsort((ids, t))
        t, ids = t[order], ids[order]
        del order
        untimed = int(np.searchsorted(t, _LEAST, side="right"))      # not accepted, as in the batch form
        ok = np.zeros(len(t), bool)
        ok[untimed:], kept = _accept_late(t[untimed:], kept, limit, window_us)
        if untimed < len(t):
            kept = kept[kept >= t[-1] - window_us]
        state.update((kept.tolist(),))
        for at in range(0, len(t), _OUT_ROWS):
            part = slice(at, at + _OUT_ROWS)
            yield pd.DataFrame({"id": ids[part], "queue_id": key[0], "t": t[part], "accepted": ok[part]})
    return fn


def admit_stream(arrivals: DataFrame, limit: int, window_secs: int, key: str = "queue_id",
                 ts_col: str = "event_ts") -> DataFrame:
    """Exact admission with list state per queue (accepted timestamps inside the
    window, at most ``limit``). An arrival without a time is not accepted."""
    least = F.lit(_LEAST)
    x = arrivals.select(F.coalesce(F.col("arrival_id").cast("long"), least).alias("__id"), F.col(key).cast("string").alias("queue_id"),
                        F.coalesce(F.unix_micros(F.col(ts_col).cast("timestamp")), least).alias("__t"))
    out = x.groupBy("queue_id").applyInPandasWithState(
        _admit_state(limit, window_secs * 1_000_000), "id long, queue_id string, t long, accepted boolean", "acc array<long>",
        "append", GroupStateTimeout.NoTimeout)
    return out.select(F.nullif("id", least).alias("arrival_id"), "queue_id",
                      F.timestamp_micros(F.nullif("t", least)).alias("event_ts"), "accepted")


# T5 ---------------------------------------------------------------------------
LIFECYCLE_SCHEMA = "event_id long, job_id long, from_status string, status string, epoch long, verdict string"


def _lifecycle(allowed: frozenset):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        cur, ep = state.get if state.exists else (None, -1)
        pdf = _whole(pdfs, "__t", "event_id")
        if pdf is None:
            return
        out = []
        for eid, st, e in zip(pdf["event_id"], pdf["status"], pdf["epoch"]):
            e = int(e) if not pd.isna(e) else ep
            if e < ep:
                verdict = "stale_epoch"
            elif (cur is None and st in INITIAL_STATUSES) or (cur, st) in allowed:
                verdict = "accepted"
            else:
                verdict = "invalid_transition"
            out.append((int(eid), key[0], cur, st, e, verdict))
            if verdict == "accepted":
                cur, ep = st, max(ep, e)
        state.update((cur, ep))
        yield pd.DataFrame(out, columns=["event_id", "job_id", "from_status", "status", "epoch", "verdict"])
    return fn


def lifecycle_stream(events: DataFrame, transitions=DECLARED_TRANSITIONS, ts_col: str = "event_ts") -> DataFrame:
    """Apply ordered status events per job through the transition matrix; events
    of an older lease epoch are rejected as stale."""
    x = events.select("event_id", "job_id", "status", "epoch",
                      F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t"))
    return x.groupBy("job_id").applyInPandasWithState(
        _lifecycle(frozenset(transitions)), LIFECYCLE_SCHEMA, "status string, epoch long", "append",
        GroupStateTimeout.NoTimeout)


# T6 ---------------------------------------------------------------------------
RECLAIM_SCHEMA = "job_id long, worker_id long, expired_at timestamp"


def _lease_monitor(lease_us: int, grace_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        wm_us = state.getCurrentWatermarkMs() * 1000
        cur = state.get if state.exists else None
        rows = []

        def lapse(before: int) -> None:
            """Emit the open lease if its expiry + grace lies before a time."""
            nonlocal cur
            if cur is not None and cur[1] + grace_us < before:
                rows.append((key[0], cur[0], pd.Timestamp(cur[1], unit="us")))
                cur = None

        pdf = None if state.hasTimedOut else _whole(pdfs, "__t", "event_id")
        if pdf is not None:
            for kind, w, t in zip(pdf["kind"], pdf["worker_id"], pdf["__t"]):
                lapse(int(t))
                if kind == "complete":
                    cur = None
                elif kind == "claim" or (cur is not None and kind == "renew" and cur[0] == w):
                    cur = (int(w), int(t) + lease_us)
        lapse(wm_us)
        if cur is not None:
            state.update(cur)
            state.setTimeoutTimestamp((cur[1] + grace_us) // 1000 + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "worker_id", "expired_at"])
    return fn


def lease_stream(events: DataFrame, lease_secs: int = 30, grace_secs: int = 10, ts_col: str = "event_ts",
                 watermark: str = "0 seconds") -> DataFrame:
    """Open leases per job (claim opens, same-worker renew extends, complete
    closes); a lease past expiry + grace gives a reclaim row when a later event of the
    job or the watermark shows it, however the events are cut into micro-batches."""
    x = (events.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
               .select("job_id", "worker_id", "event_id", "kind", "__ts", F.unix_micros("__ts").alias("__t")))
    return x.groupBy("job_id").applyInPandasWithState(
        _lease_monitor(lease_secs * 1_000_000, grace_secs * 1_000_000), RECLAIM_SCHEMA,
        "worker long, until long", "append", GroupStateTimeout.EventTimeTimeout)


# T7 ---------------------------------------------------------------------------
def _dag_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    """A bucket of children: the satisfied edges of those that wait, and those released (a
    released child keeps a marker, not its parents)."""
    child, parent, done = (np.array(v, np.int64) for v in (state.get if state.exists else ([], [], [])))
    seen = pd.DataFrame({"child_id": child, "parent_id": parent})
    need = pd.Series(dtype=np.int64)
    for p in pdfs:
        p = p[~p["child_id"].isin(done)]
        seen = pd.concat([seen, p[["child_id", "parent_id"]]]).drop_duplicates()
        own = p.drop_duplicates("child_id").set_index("child_id")["needed"]
        need = pd.concat([need, own[~own.index.isin(need.index)]])
    have = seen.groupby("child_id").size().reindex(need.index, fill_value=0)
    ready = have[have >= need]
    waits = seen[~seen["child_id"].isin(ready.index)].sort_values(["child_id", "parent_id"])
    done = np.sort(np.concatenate([done, ready.index.to_numpy(np.int64)]))
    state.update((waits["child_id"].tolist(), waits["parent_id"].tolist(), done.tolist()))
    if len(ready):
        yield pd.DataFrame({"child_id": ready.index.to_numpy(np.int64), "parents": ready.to_numpy(np.int64)})


def dag_stream(completions: DataFrame, edges: DataFrame) -> DataFrame:
    """Completed job ids in, each child out once when all its parents completed.
    The edge table is static: in-degrees are pre-aggregated and joined on child."""
    indeg = edges.groupBy("child_id").agg(F.countDistinct("parent_id").alias("needed"))
    sat = (completions.select(F.col("job_id").alias("parent_id"))
                      .join(edges.select("parent_id", "child_id"), "parent_id")
                      .join(indeg, "child_id"))
    return sat.select(_bucket("child_id"), "child_id", "parent_id", "needed").groupBy("__bucket").applyInPandasWithState(
        _dag_state, "child_id long, parents long", "child array<long>, parent array<long>, done array<long>", "append",
        GroupStateTimeout.NoTimeout)


# T3 (edges) -------------------------------------------------------------------
EDGE_SCHEMA = "worker_id long, edge_at timestamp, from_status string, to_status string"


def _liveness_state(online_us: int, stale_us: int):
    def due_edges(w, last, status, wm_us):
        """Edges after ``last`` whose time the watermark has passed; new status."""
        rows = []
        if status == "ONLINE" and last + online_us < wm_us:
            rows.append((w, last + online_us, "ONLINE", "STALE"))
            status = "STALE"
        if status == "STALE" and last + stale_us < wm_us:
            rows.append((w, last + stale_us, "STALE", "OFFLINE"))
            status = "OFFLINE"
        return rows, status

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        w = key[0]
        wm_us = state.getCurrentWatermarkMs() * 1000
        last, status = state.get if state.exists else (None, None)
        rows = []
        pdf = None if state.hasTimedOut else _whole(pdfs, "__t")
        if pdf is not None:
            for t in pdf["__t"].astype("int64").tolist():
                if last is not None and t > last:
                    if t > last + online_us and status == "ONLINE":
                        rows.append((w, last + online_us, "ONLINE", "STALE"))
                    if t > last + stale_us and status in ("ONLINE", "STALE"):
                        rows.append((w, last + stale_us, "STALE", "OFFLINE"))
                    if t > last + online_us:
                        rows.append((w, t, "OFFLINE" if t > last + stale_us else "STALE", "ONLINE"))
                if last is None or t > last:
                    last, status = t, "ONLINE"
        more, status = due_edges(w, last, status, wm_us)
        rows += more
        state.update((last, status))     # OFFLINE stays: the next heartbeat's edge starts from it
        if status != "OFFLINE":
            state.setTimeoutTimestamp((last + (online_us if status == "ONLINE" else stale_us)) // 1000 + 1)
        if rows:
            yield _edges_frame(rows)
    return fn


def _edges_frame(rows):
    df = pd.DataFrame(rows, columns=["worker_id", "edge_at", "from_status", "to_status"])
    df["edge_at"] = pd.to_datetime(df["edge_at"], unit="us")
    return df


def liveness_stream(hb: DataFrame, online_secs: int = 15, stale_secs: int = 60, ts_col: str = "heartbeat_at",
                    watermark: str = "0 seconds") -> DataFrame:
    """ONLINE→STALE→OFFLINE→ONLINE edges per worker from heartbeats: gaps inside
    the data give edges directly; after the last heartbeat, event-time timeouts
    (fired when the watermark passes) emit the STALE and OFFLINE edges."""
    x = (hb.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
           .select("worker_id", "__ts", F.unix_micros("__ts").alias("__t")))
    return x.groupBy("worker_id").applyInPandasWithState(
        _liveness_state(online_secs * 1_000_000, stale_secs * 1_000_000), EDGE_SCHEMA,
        "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)
