"""Workflow DAG operators (D1–D5).

Iterative operators (D4, D5) loop on the driver over distributed joins; each
round only reads a count. Lineage is cut with a reliable checkpoint into the
shared ``spark.checkpoint.dir`` in each round, so lost executors recompute
from the last checkpoint, not from the start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as G
from ..session import cut_lineage, ts
from .merge import insert_ignore
from .transitions import outbox_for

WHOLE = 1 << 18                     # edges of a component that one task may solve


class RoundLimitExceeded(RuntimeError):
    """Raised instead of returning a partial result."""


# D1 ---------------------------------------------------------------------------
def create_workflows(requests: DataFrame, queues: DataFrame, projects: DataFrame, now,
                     id_col: str = "workflow_request_id"):
    """Requests (id, [project_id], [queue_id], jobs: array<struct(payload,
    priority, [queue_id])>, edges: array<struct(parent, child)> of 0-based
    indexes). A job's queue is its own or the request's; its priority its own or
    the queue default. A request is rejected whole when an index is out of
    range, an edge is a self-loop, a queue is missing, or (with project_id) a
    queue belongs to another project. Children start WAITING, roots QUEUED with
    an outbox row; 3 attempts, kind immediate. Returns (jobs, edges, outbox, rejects)."""
    n_jobs = F.size("jobs")
    bad_edge = F.exists("edges", lambda e: (e["parent"] < 0) | (e["child"] < 0) | (e["parent"] >= n_jobs)
                        | (e["child"] >= n_jobs) | (e["parent"] == e["child"]))
    flagged = requests.withColumn("__bad", F.coalesce(bad_edge, F.lit(False)) | (n_jobs < 1))
    edge_rejects = flagged.filter("__bad").select(id_col, F.lit("invalid_edges").alias("reason"))
    good = flagged.filter(~F.col("__bad"))
    wid = G.derived_id(F.lit("workflow"), F.col(id_col))
    fields = set(requests.schema["jobs"].dataType.elementType.fieldNames())
    req_q = F.col("queue_id") if "queue_id" in requests.columns else F.lit(None).cast("long")
    req_p = F.col("project_id") if "project_id" in requests.columns else F.lit(None).cast("long")
    jobs = good.select(id_col, req_q.alias("__rq"), req_p.alias("__rp"), wid.alias("workflow_id"),
                       F.posexplode("jobs").alias("idx", "j"))
    item_q = F.col("j.queue_id").cast("long") if "queue_id" in fields else F.lit(None).cast("long")
    jobs = jobs.withColumn("queue_id", F.coalesce(item_q, F.col("__rq"))) \
               .withColumn("job_id", G.derived_id(F.lit("wfjob"), F.col(id_col), F.col("idx")))
    q = queues.select("queue_id", F.col("project_id").alias("__qp"), F.col("default_priority").alias("__dp"))
    jobs = jobs.join(q, "queue_id", "left")
    problem = (F.when(F.col("__qp").isNull(), "queue_not_found")
                .when(F.col("__rp").isNotNull() & (F.col("__qp") != F.col("__rp")), "queue_not_in_project"))
    job_rejects = (jobs.withColumn("__why", problem).filter(F.col("__why").isNotNull())
                       .groupBy(id_col).agg(F.min("__why").alias("reason")))
    jobs = jobs.join(job_rejects.select(id_col), id_col, "left_anti")
    edges = good.join(job_rejects.select(id_col), id_col, "left_anti") \
        .select(id_col, F.explode("edges").alias("e")).select(
            id_col, F.col("e.parent").cast("long").alias("p"), F.col("e.child").cast("long").alias("c")).distinct()
    ids = jobs.select(id_col, "idx", "job_id")
    id_edges = (edges.join(ids.withColumnRenamed("idx", "p").withColumnRenamed("job_id", "parent_id"), [id_col, "p"])
                     .join(ids.withColumnRenamed("idx", "c").withColumnRenamed("job_id", "child_id"), [id_col, "c"])
                     .select("parent_id", "child_id"))
    children = id_edges.select(F.col("child_id").alias("job_id")).distinct().withColumn("__child", F.lit(True))
    n = ts(now)
    item_prio = F.col("j.priority").cast("long") if "priority" in fields else F.lit(None).cast("long")
    out = (jobs.join(children, "job_id", "left")
               .select("job_id", "queue_id", "workflow_id", F.col(id_col),
                       F.col("idx").cast("long").alias("position"),
                       F.when(F.col("__child"), "WAITING").otherwise("QUEUED").alias("status"),
                       (F.col("j.payload") if "payload" in fields else F.lit(None).cast("string")).alias("payload"),
                       F.coalesce(item_prio, F.col("__dp").cast("long")).alias("priority"),
                       F.lit("immediate").alias("kind"), F.lit(3).cast("long").alias("max_attempts"),
                       F.lit(0).cast("long").alias("shard_id"), n.alias("created_at"),
                       F.when(~F.coalesce(F.col("__child"), F.lit(False)), n).alias("queued_at")))
    outbox = outbox_for(out.filter(F.col("status") == "QUEUED"), queues, projects, now, "workflow")
    return out, id_edges, outbox, edge_rejects.unionByName(job_rejects)


# D2 ---------------------------------------------------------------------------
def ready_children(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """WAITING jobs all of whose parents are COMPLETED (a parent missing from
    ``jobs`` counts as not completed)."""
    done = jobs.filter(F.col("status") == "COMPLETED").select(F.col("job_id").alias("parent_id"),
                                                              F.lit(True).alias("__done"))
    per_child = (edges.join(done, "parent_id", "left").groupBy("child_id")
                      .agg(F.bool_and(F.coalesce(F.col("__done"), F.lit(False))).alias("__all")))
    ready = per_child.filter("__all").select(F.col("child_id").alias("job_id"))
    return jobs.filter(F.col("status") == "WAITING").join(ready, "job_id", "left_semi")


# D3 ---------------------------------------------------------------------------
def release(jobs: DataFrame, edges: DataFrame, satisfaction: DataFrame, queues: DataFrame,
            projects: DataFrame, now):
    """Completed parents satisfy their out-edges (insert-ignore); WAITING children
    whose distinct satisfied parents equal their in-edges become QUEUED with an
    outbox row. Returns (satisfaction, released jobs, outbox)."""
    done = jobs.filter(F.col("status") == "COMPLETED").select(F.col("job_id").alias("parent_id"))
    new_sat = edges.join(done, "parent_id", "left_semi").select("parent_id", "child_id")
    sat, _ = insert_ignore(satisfaction.select("parent_id", "child_id"), new_sat, ["parent_id", "child_id"])
    need = edges.groupBy("child_id").agg(F.countDistinct("parent_id").alias("__need"))
    have = (sat.join(edges.select("parent_id", "child_id").distinct(), ["parent_id", "child_id"], "left_semi")
               .groupBy("child_id").agg(F.countDistinct("parent_id").alias("__have")))
    ready = need.join(have, "child_id").filter(F.col("__need") == F.col("__have")).select(
        F.col("child_id").alias("job_id"))
    n = ts(now)
    released = (jobs.filter(F.col("status") == "WAITING").join(ready, "job_id", "left_semi")
                    .withColumns({"status": F.lit("QUEUED"), "queued_at": n, "updated_at": n}))
    return sat, released, outbox_for(released, queues, projects, now, "release")


# D4 ---------------------------------------------------------------------------
def _ends_of_chains(pointers: DataFrame) -> DataFrame:
    """``node, root``: where the pointers ``(node, to)`` (one per node) lead in the end. Each
    step jumps four times as far, so steps grow with the logarithm of the longest chain.
    Nodes whose pointers run into a ring have no row: once a step ends no further chain,
    only those are left."""
    domain = pointers.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    cur = cut_lineage(pointers.join(domain, "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")))
    left = None
    while True:
        n = cur.filter("open").count()
        if n == left or n == 0:
            return cur.filter("NOT open").select("node", F.col("to").alias("root"))
        left = n
        nxt = cur
        for _ in range(2):
            onward = nxt.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("open").alias("__open"))
            moved = nxt.filter("open").join(onward, "to").select("node", F.col("__to").alias("to"), F.col("__open").alias("open"))
            nxt = nxt.filter("NOT open").unionByName(moved)
        cur = cut_lineage(nxt)


def _behind_cycles(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    """Nodes on or behind (along src -> dst) a cycle: what is left when nodes without an
    incoming edge are taken away until there are none.

    A node with a single incoming edge shares the fate of the edge's source. Each round
    takes the open ends away, follows such edges to where they begin, however long the
    chain, and lets that node take over the edges of the whole chain (as two ways that
    meet again then come from one node, they fold up as well). So rounds follow the depth
    of what is left after folding, not the length of paths."""
    e = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    count, folded = e.count(), []
    for _ in range(max_rounds):
        kept = cut_lineage(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi"))
        n = kept.count()
        if n == count:
            break
        single = kept.groupBy("d").agg(F.count(F.lit(1)).alias("__n"), F.min("s").alias("to")) \
            .filter((F.col("__n") == 1) & (F.col("to") != F.col("d"))).select(F.col("d").alias("node"), "to")
        roots = cut_lineage(_ends_of_chains(single))
        folded.append(roots)
        rest = kept.join(roots.select(F.col("node").alias("d")), "d", "left_anti")
        moved = rest.join(roots.withColumnRenamed("node", "s"), "s", "left")
        e = cut_lineage(moved.select(F.coalesce("root", "s").alias("s"), "d").distinct())
        count = e.count()
    else:
        raise RoundLimitExceeded(f"cycle search did not end in {max_rounds} rounds")
    found = e.select(F.col("d").alias("node")).distinct()
    for roots in reversed(folded):
        more = roots.join(found.withColumnRenamed("node", "root"), "root", "left_semi").select("node")
        found = cut_lineage(found.unionByName(more))
    return found


def _components(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``node, root`` for the nodes that are not their connected component's root. Each round
    points every node at its smallest neighbour if that is smaller, follows the pointers to
    their ends and draws the edges together there: at least half of the nodes that still have
    edges vanish in a round."""
    def undirected(e, a, b):
        return cut_lineage(e.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())

    e, labels = undirected(edges, F.col("parent_id"), F.col("child_id")), None
    for _ in range(max_rounds):
        if e.isEmpty():
            return edges.select(F.col("parent_id").alias("node"), F.col("parent_id").alias("root")).limit(0) if labels is None else labels
        both = e.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("to")))
        low = both.groupBy("node").agg(F.min("to").alias("to")).where("to < node")
        new = _ends_of_chains(low)
        if labels is None:
            labels = new
        else:
            onward = new.select(F.col("node").alias("root"), F.col("root").alias("__new"))
            labels = cut_lineage(labels.join(onward, "root", "left").select("node", F.coalesce("__new", "root").alias("root"))
                                 .unionByName(new))
        for end in ("u", "v"):
            e = e.join(new.select(F.col("node").alias(end), F.col("root").alias(f"__{end}")), end, "left")
        e = undirected(e, F.coalesce("__u", "u"), F.coalesce("__v", "v"))
    raise RoundLimitExceeded(f"component search did not end in {max_rounds} rounds")


def _left_over(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Marks those of the nodes 0..n-1 that are left when nodes without an incoming edge are
    taken away, with their edges, until there are none."""
    order = np.argsort(src, kind="stable")
    out, begin = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    open_in = np.bincount(dst, minlength=n)
    ends = np.flatnonzero(open_in == 0)
    while len(ends):
        count = begin[ends + 1] - begin[ends]
        first = np.repeat(begin[ends] - (np.cumsum(count) - count), count)
        met, times = np.unique(out[first + np.arange(count.sum())], return_counts=True)
        open_in[met] -= times
        ends = met[open_in[met] == 0]
    return open_in > 0


def _solve(parent: np.ndarray, child: np.ndarray) -> pa.RecordBatch:
    ids, at = np.unique(np.concatenate([parent, child]), return_inverse=True)
    s, d = at[:len(parent)], at[len(parent):]
    down = _left_over(s, d, len(ids))
    inner = down[s]
    both = _left_over(d[inner], s[inner], len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[down]), pa.array(both[down])], names=["node_id", "between"])


def _solve_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components (rows sorted by root) are solved together, some ``WHOLE`` edges at a time."""
    held, rows = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        rows += b.num_rows
        if rows >= WHOLE:
            root, parent, child = (np.concatenate(c) for c in zip(*held))
            n = int(np.searchsorted(root, root[-1]))         # the last one may go on
            if n:
                yield _solve(parent[:n], child[:n])
            held, rows = [[root[n:], parent[n:], child[n:]]], len(root) - n
    if rows:
        yield _solve(*(np.concatenate(c) for c in list(zip(*held))[1:]))


def cycles(edges: DataFrame, max_rounds: int = 10_000, whole: int = WHOLE):
    """Two node sets: on or downstream of a cycle, and on a cycle or on a path between
    cycles (of those, the ones that also lead to a cycle). An edge from a node to itself is
    a cycle; nodes without an id and their edges are ignored.

    Connected components of up to ``whole`` edges are solved whole, many in a task; larger
    ones in distributed rounds (``_behind_cycles``)."""
    e = cut_lineage(edges.select(F.col("parent_id").cast("long"), F.col("child_id").cast("long")).dropna().distinct())
    roots = _components(e, max_rounds).withColumnRenamed("node", "parent_id")
    tagged = cut_lineage(e.join(roots, "parent_id", "left").select(F.coalesce("root", "parent_id").alias("root"), "parent_id", "child_id"))
    large = cut_lineage(tagged.groupBy("root").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > whole).select("root"))
    small = tagged.join(large, "root", "left_anti").select("root", "parent_id", "child_id")
    found = cut_lineage(small.repartition("root").sortWithinPartitions("root").mapInArrow(_solve_components, "node_id long, between boolean"))
    if not large.isEmpty():
        rest = cut_lineage(tagged.join(large, "root", "left_semi").select("parent_id", "child_id"))
        fwd = _behind_cycles(rest, "parent_id", "child_id", max_rounds)
        inner = rest.join(fwd.withColumnRenamed("node", "parent_id"), "parent_id", "left_semi")
        both = _behind_cycles(inner, "child_id", "parent_id", max_rounds).withColumn("between", F.lit(True))
        found = found.unionByName(fwd.join(both, "node", "left").select(
            F.col("node").alias("node_id"), F.coalesce("between", F.lit(False)).alias("between")))
    downstream = found.select("node_id", F.lit("cycle_or_downstream").alias("kind"))
    between = found.where("between").select("node_id", F.lit("cycle_or_between").alias("kind"))
    return downstream, between


# D5 ---------------------------------------------------------------------------
def ancestors(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node_id, ancestor_id, depth) with the shortest depth, to any depth.

    Rounds double the depth: with all pairs up to depth k known, a pair of depth k + d
    (d up to k) is a pair of depth exactly k joined with one of depth d, so only those at
    the rim are extended. A round pairs nothing up twice and the closure ends when no pair
    has depth k; ``max_rounds`` (depth 2 ** max_rounds) raises instead of returning a
    partial closure."""
    e = edges.select("parent_id", "child_id").distinct()
    known = e.select(F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id"),
                     F.lit(1).cast("long").alias("depth")).persist(StorageLevel.MEMORY_AND_DISK)
    k = 1
    for _ in range(max_rounds):
        rim = known.filter(F.col("depth") == k).select("node_id", F.col("ancestor_id").alias("mid"))
        if rim.isEmpty():
            return known
        onward = known.select(F.col("node_id").alias("mid"), "ancestor_id", "depth")
        step = rim.join(onward, "mid").groupBy("node_id", "ancestor_id").agg((F.min("depth") + k).alias("depth"))
        new = step.join(known.select("node_id", "ancestor_id"), ["node_id", "ancestor_id"], "left_anti")
        bigger = cut_lineage(known.unionByName(new))
        known.unpersist()
        known, k = bigger, 2 * k
    raise RoundLimitExceeded(f"ancestor closure did not end in {max_rounds} rounds")
