"""Exact rate-limit admission (T4, batch form), in parallel within a queue.

Only *accepted* arrivals count against a queue's trailing window, so each decision
depends on earlier ones. A queue is cut into pieces of many windows and, where it has as
many, of at least ``PIECE_ROWS`` arrivals, so most queues are one piece; what
a piece needs of its past is the list of accepted times in the window before it. That
list is guessed first: the last windows of each piece are run from an empty list, and
two runs of the rule usually agree after a few windows. All pieces are then run from
their guesses at once. A piece whose guess differs from what its predecessor really
ended with is run again, in rounds, until none differs: by induction along the queue the
result is that of the sequential rule. In each round the first wrong piece of every
queue comes right, so the rounds end; arrivals whose runs never agree cost as many
rounds as the queue has pieces, one for each ``PIECE_ROWS`` arrivals.

A piece is streamed in time order by one task with O(limit) memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros
from ..session import cut_lineage

PIECE_WINDOWS = 32                  # windows in a piece, at least
PIECE_MICROS = 6 * 3_600_000_000    # and at least this long, so slow queues have few pieces
PIECE_ROWS = 1 << 20                # arrivals of a piece, if the queue has as many
TAIL_WINDOWS = 8                    # windows run for a guess

_RUN = pa.schema([("__k", pa.string()), ("__piece", pa.int64()), ("__id", pa.int64()), ("__t", pa.int64()),
                  ("accepted", pa.bool_()), ("__first", pa.int64()), ("__w", pa.int64()), ("__used", pa.list_(pa.int64())),
                  ("__out", pa.list_(pa.int64()))])
_RUN_SQL = ("__k string, __piece long, __id long, __t long, accepted boolean, __first long, __w long, "
            "__used array<long>, __out array<long>")


def accept(t: np.ndarray, kept: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks the accepted of the rising times ``t`` after the last accepted ``kept`` (at
    most ``limit``); also the new ``kept``. Up to ``limit`` arrivals are accepted in one step,
    and a run of rejected ones is skipped by binary search."""
    ok, pos = np.zeros(len(t), bool), 0
    if limit <= 0:
        return ok, kept
    while pos < len(t):
        if len(kept) < limit:
            run = min(limit - len(kept), len(t) - pos)
        else:
            block = t[pos:pos + limit]
            late = block <= kept[:len(block)] + window
            run = int(late.argmax()) if late.any() else len(block)
            if run == 0:
                pos = max(pos, int(np.searchsorted(t, kept[0] + window, side="right")))
                continue
        ok[pos:pos + run] = True
        kept = np.concatenate([kept, t[pos:pos + run]])[-limit:]
        pos += run
    return ok, kept


class _Piece:
    """One piece in a streaming pass: its list, the list it began with, its first time."""

    def __init__(self, key, piece, limit, window, end, start):
        self.key, self.piece, self.limit, self.window, self.end = key, piece, limit, window, end
        self.kept = np.array(start or [], dtype=np.int64)
        self.first = self.used = None

    def run(self, t: np.ndarray) -> np.ndarray:
        if self.limit is None:
            self.first, self.used = t[0] if self.first is None else self.first, self.kept[:0]
            return np.ones(len(t), bool)
        if self.first is None:
            self.first = int(t[0])
            self.kept = self.used = self.kept[self.kept >= self.first - self.window]
        ok, self.kept = accept(t, self.kept, self.limit, self.window)
        return ok

    def line(self) -> list:
        left = self.kept[:0] if self.limit is None else self.kept[self.kept >= self.end - self.window]
        return [self.key, self.piece, None, None, None, int(self.first), self.window, self.used.tolist(), left.tolist()]


def _pass(flags: bool):
    """Over rows sorted by (queue, piece, header first, time, id): one line per piece, and
    with ``flags`` each arrival's decision."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            keys, pieces = c["__k"], c["__piece"].to_numpy()
            heads, t = c["__head"].to_numpy(zero_copy_only=False), c["__t"].to_numpy(zero_copy_only=False)
            names = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(names) != 0) | (np.diff(pieces) != 0)) + 1
            ok, lines = np.zeros(len(pieces), bool), []
            for a, z in zip(np.r_[0, new], np.r_[new, len(pieces)]):
                key, piece = keys[a].as_py(), int(pieces[a])
                if cur is None or (cur.key, cur.piece) != (key, piece):
                    if cur is not None and cur.first is not None:
                        lines.append(cur.line())
                    cur = _Piece(key, piece, c["__lim"][a].as_py(), c["__w"][a].as_py(), c["__end"][a].as_py(), c["__state"][a].as_py())
                a += int(heads[a:z].sum())          # the header, if any, comes first
                if a < z:
                    if cur.first is None:           # limits are those of the arrivals
                        cur.limit, cur.window, cur.end = (c[n][int(a)].as_py() for n in ("__lim", "__w", "__end"))
                    ok[a:z] = cur.run(t[a:z])
            if flags:
                own = pa.array(~heads)
                n = int((~heads).sum())
                none = [pa.nulls(n, f.type) for f in list(_RUN)[5:]]
                yield pa.RecordBatch.from_arrays([keys.filter(own).cast(pa.string()), c["__piece"].filter(own), c["__id"].filter(own),
                                                  c["__t"].filter(own), pa.array(ok[~heads]), *none], schema=_RUN)
            if lines:
                yield _lines(lines)
        if cur is not None and cur.first is not None:
            yield _lines([cur.line()])
    return run


def _lines(lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*lines), _RUN)], schema=_RUN)


_ROW = ["__k", "__piece", "__head", "__t", "__id", "__lim", "__w", "__end", "__state"]


def _run(rows: DataFrame, states: DataFrame | None, flags: bool, partitions: int | None) -> DataFrame:
    """One pass over ``rows``; ``states(__k, __piece, __state)`` go in front of their pieces."""
    x = rows.withColumns({"__head": F.lit(False), "__state": F.lit(None).cast("array<long>")}).select(*_ROW)
    if states is not None:
        zero = F.lit(0).cast("long")
        x = x.unionByName(states.select("__k", "__piece", F.lit(True).alias("__head"), zero.alias("__t"), zero.alias("__id"),
                                        *[zero.alias(n) for n in ("__lim", "__w", "__end")], "__state").select(*_ROW))
    parts = [partitions] if partitions else []
    # dealt by a column of its own: were it by the joins' keys, the planner would leave out
    # the exchange over the union and later change the joins below it
    x = x.withColumn("__deal", F.xxhash64("__k", "__piece")).repartition(*parts, "__deal").drop("__deal").sortWithinPartitions("__k", "__piece", F.col("__head").desc(), "__t", "__id")
    return x.mapInArrow(_pass(flags), _RUN_SQL)


def _wrong(lines: DataFrame) -> DataFrame:
    """Pieces that did not begin with what their predecessor ended with, and that list. A
    piece is longer than a window, so only the piece just before can matter."""
    past = lines.select("__k", (F.col("__piece") + 1).alias("__piece"), F.col("__out").alias("__past"))
    x = lines.join(past, ["__k", "__piece"], "left")
    due = F.filter(F.coalesce("__past", F.array().cast("array<long>")), lambda a: a >= F.col("__first") - F.col("__w"))
    return x.withColumn("__state", due).where(F.col("__state") != F.col("__used")).select("__k", "__piece", "__state")


def _named(key: str) -> Column:
    """A queue's name for joins: null is the empty text, any other has a mark in front."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("__k")


def _joined(cells: DataFrame, rows: int) -> DataFrame:
    """Queues' cells ``(__k, __cell, __n, __last)`` with their piece: consecutive cells with
    ``rows`` arrivals together. Pieces are numbered without gaps; ``__end`` is the end of the
    last cell, ``__more`` tells whether a piece follows."""
    before = Window.partitionBy("__k").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    x = cells.withColumn("__at", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / rows))
    x = x.withColumn("__piece", F.dense_rank().over(Window.partitionBy("__k").orderBy("__at")).cast("long"))
    x = x.withColumn("__end", F.max("__last").over(Window.partitionBy("__k", "__piece")))
    return x.withColumn("__more", F.col("__piece") < F.max("__piece").over(Window.partitionBy("__k"))) \
        .select("__k", "__cell", "__piece", "__end", "__more")


def admit(arrivals: DataFrame, limit=None, window_secs=None, queues: DataFrame | None = None,
          key: str = "queue_id", ts_col: str = "event_ts", id_col: str = "arrival_id",
          partitions: int | None = None, piece_micros: int = PIECE_MICROS, piece_rows: int | None = None) -> DataFrame:
    """Accept/reject every arrival: accepted iff accepted arrivals of its queue in
    [ts - window, ts] plus itself stay within the limit. A NULL limit accepts all, one of 0
    or less none. Arrivals of a queue (null is one) are taken in order of time, then id; a
    queue absent from ``queues`` has no limit, an arrival without a time is not accepted."""
    t = epoch_micros(ts_col)
    a = arrivals.select(F.col(id_col).cast("long").alias("__id"), _named(key), t.alias("__t"))
    if queues is not None:
        q = queues.select(_named(key), F.col("rate_limit").cast("long").alias("__lim"),
                          (F.col("rate_window_secs") * 1_000_000).cast("long").alias("__w"))
        a = a.join(q, "__k", "left")
    else:
        a = a.withColumn("__lim", F.lit(limit).cast("long")).withColumn(
            "__w", F.lit(int(window_secs) * 1_000_000).cast("long"))
    a = a.withColumn("__w", F.coalesce("__w", F.lit(0).cast("long")))
    length: Column = F.greatest(F.col("__w") * PIECE_WINDOWS, F.lit(piece_micros))
    every = cut_lineage(a.withColumns({"__cell": F.floor(F.col("__t") / length), "__len": length}))
    # without a limit arrivals do not depend on each other: their cells stay apart
    rows = piece_rows or PIECE_ROWS
    n = F.count(F.lit(1))
    cells = every.where("__t IS NOT NULL").groupBy("__k", "__cell").agg(
        F.when(F.max("__lim").isNull(), F.greatest(n, F.lit(rows))).otherwise(n).alias("__n"),
        F.max((F.col("__cell") + 1) * F.col("__len")).alias("__last"))
    pieces = _joined(cells, rows)
    a = cut_lineage(every.where("__t IS NOT NULL").join(pieces, ["__k", "__cell"])
                    .select("__id", "__k", "__t", "__lim", "__w", "__piece", "__end", "__more"))

    tail = a.where(F.col("__more") & (F.col("__t") >= F.col("__end") - F.col("__w") * TAIL_WINDOWS))
    guess = _run(tail, None, False, partitions).select("__k", (F.col("__piece") + 1).alias("__piece"), F.col("__out").alias("__state"))
    done = cut_lineage(_run(a, guess.where(F.size("__state") > 0), True, partitions))
    lines = done.where("__id IS NULL").select("__k", "__piece", "__first", "__w", "__used", "__out")
    rows = done.where("__id IS NOT NULL").select("__k", "__piece", "__id", "__t", "accepted")
    again = todo = cut_lineage(_wrong(lines))
    while not todo.isEmpty():
        part = a.join(todo.select("__k", "__piece"), ["__k", "__piece"], "left_semi")
        new = _run(part, todo, False, partitions).select("__k", "__piece", *[F.col(c).alias(f"{c}_") for c in ("__used", "__out")])
        lines = cut_lineage(lines.join(new, ["__k", "__piece"], "left").select(
            "__k", "__piece", "__first", "__w", *[F.coalesce(f"{c}_", c).alias(c) for c in ("__used", "__out")]))
        todo = cut_lineage(_wrong(lines))
        again = cut_lineage(again.select("__k", "__piece").unionByName(todo.select("__k", "__piece")).distinct())
    again = again.select("__k", "__piece")
    part = a.join(again, ["__k", "__piece"], "left_semi")
    states = lines.join(again, ["__k", "__piece"], "left_semi").select("__k", "__piece", F.col("__used").alias("__state"))
    fixed = _run(part, states, True, partitions).where("__id IS NOT NULL").select(*rows.columns)
    untimed = every.where("__t IS NULL").withColumns({"__piece": F.lit(None).cast("long"), "accepted": F.lit(False)}).select(*rows.columns)
    out = rows.join(again, ["__k", "__piece"], "left_anti").unionByName(fixed).unionByName(untimed)
    return out.select(F.col("__id").alias("arrival_id"), F.expr("nullif(substring(__k, 2), __k)").alias("queue_id"),
                      F.timestamp_micros("__t").cast("timestamp_ntz").alias("event_ts"), "accepted")
