"""Conversation prefix trie from padded turn-id matrices.

Conversations are sequences of turns. All sequences are dealt to shards by range, so every
node of the trie is one run of rows, in one shard or in neighbouring ones. In a shard the
turns get dense ids in order, the sequences form a padded matrix (0: no turn), and numpy
``lexsort`` puts it in order. Columns that differ from the row before, OR-accumulated along
the row, mark where nodes start at each depth, and ``reduceat`` over these starts aggregates
every depth. All figures of a node are sums or minima over its rows: the bytes of a subtree
are those of its members less one time each node's own, taken at the row that starts it.

Only nodes that reach over the border of a shard are partial; they are combined by key.
How many turns a border's two rows share is one number per shard.

A conversation longer than ``BLOCK`` turns goes on in further rows (conversation, block),
sorted under the identity of what lies before; what a later block adds to the nodes of an
earlier one is carried as sums per row. So the matrix stays ``BLOCK`` wide however long a
conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, partitions, positions

BLOCK = 16               # turns in a row of the matrix
SHARD_ROWS = 100_000     # rows of a shard: 26 MB of turn keys
BUCKET = 4_096           # blocks of one conversation that one window holds
_PREFIX = [f"p{i}" for i in range(4)]
_SORT = ["block", *_PREFIX, "body", "goes_on", "conv_id"]
_CREDITS = ["later_bytes", "later_starts", "later_leaves", "later_children"]


# turns and their places ---------------------------------------------------------------
def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, n, key, bytes``: place of each turn in its conversation from 0,
    turns in it, 128-bit digest of (role, text), UTF-8 bytes of the text.

    Turns are ordered by number, null first; equal numbers by role, then digest. Null role
    or text counts as empty. Rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes")).where(F.col("conv_id").isNotNull())
    placed = positions(cut(rows), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("bytes")])
    sizes = placed.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    return cut(placed.join(sizes, "conv_id").select(
        "conv_id", (F.col("_at") - F.col("_first")).alias("place"), "n", "key", "bytes"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begins with the first h turns of conversation c - c % family and
    goes on with its own turns after its first h; h = crc32(decimal c) % ``most``. A missing
    family head gives no turns. Returns ``(conv_id, place, key, bytes)`` and all
    ``(conv_id, n)``, turnless ones with n = 0. The remainder of a negative c is SQL's."""
    c = F.col("conv_id")
    convs = turns.where("place = 0").select(
        "conv_id", "n", (c - c % family).alias("head"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    heads = convs.where("conv_id = head").select("head", F.col("n").alias("head_n"))
    plan = cut(convs.join(heads, "head", "left").withColumn("given", F.least("h", F.coalesce("head_n", F.lit(0).cast("long"))))
               .select("conv_id", "n", "head", "h", "given"))
    taken = turns.where((F.col("place") < most) & (c % family == 0)).select(c.alias("head"), "place", "key", "bytes")
    begin = plan.join(taken, "head").where("place < given").select("conv_id", "place", "key", "bytes")
    own = turns.join(plan.select("conv_id", "h", "given"), "conv_id").where("place >= h") \
        .select("conv_id", (F.col("given") + F.col("place") - F.col("h")).alias("place"), "key", "bytes")
    sizes = plan.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n"))
    return begin.unionByName(own), sizes


# rows of the matrix ---------------------------------------------------------------------
def _running(rows: DataFrame, sums: dict[str, Column], back: bool = False) -> DataFrame:
    """Sums over the blocks before (``back``: after) each row's own in its conversation.
    A long conversation is cut into buckets of blocks; windows run inside them and over one
    line per bucket."""
    x = rows.withColumn("_b", F.floor(F.col("block") / BUCKET))
    lines = x.groupBy("conv_id", "_b").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    turn = (lambda c: F.col(c).desc()) if back else F.col
    over = Window.partitionBy("conv_id").orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("conv_id", "_b", *[F.coalesce(F.sum(f"_s{i}").over(over), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    inside = Window.partitionBy("conv_id", "_b").orderBy(turn("block")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_i{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(sums.values())})
    x = x.join(lines, ["conv_id", "_b"])
    return x.withColumns({n: (F.col(f"_i{i}") + F.col(f"_s{i}")).cast("long") for i, n in enumerate(sums)}) \
        .drop("_b", *[f"_{k}{i}" for k in "is" for i in range(len(sums))])


def _digest_piece(i: int) -> Column:
    digest = F.md5(F.concat(F.col("body"), F.encode(F.col("block").cast("string"), "utf-8")))
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def matrix_rows(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per conversation and block of turns: ``block``, identity ``p0..p3`` of the turns
    before (sums of 32-bit digest pieces per block), ``body`` (keys, 16 bytes each),
    ``lens``, ``goes_on`` (a later block follows). A turnless conversation is an empty row."""
    item = F.struct("place", "key", "bytes")
    g = turns.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("conv_id", "block") \
        .agg(F.sort_array(F.collect_list(item)).alias("t"))                      # BLOCK items at most
    g = g.join(sizes, "conv_id").select(
        "conv_id", "block", F.unhex(F.array_join(F.col("t.key"), "")).alias("body"), F.col("t.bytes").alias("lens"),
        (F.col("n") > (F.col("block") + 1) * BLOCK).alias("goes_on"), (F.col("n") > BLOCK).alias("_long"))
    g = cut(g)
    zero = F.lit(0).cast("long")
    long_ = _running(g.where("_long"), {p: _digest_piece(i) for i, p in enumerate(_PREFIX)})
    short = g.where(~F.col("_long")).withColumns({p: zero for p in _PREFIX})
    empty = sizes.where("n = 0").select(
        "conv_id", zero.alias("block"), F.lit(b"").alias("body"), F.array().cast("array<bigint>").alias("lens"),
        F.lit(False).alias("goes_on"), F.lit(False).alias("_long"), *[zero.alias(p) for p in _PREFIX])
    return cut(short.unionByName(long_).unionByName(empty).drop("_long"))


# shards ---------------------------------------------------------------------------------
def shards(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` dealt by range, with shard number ``_shard``, and for each shard how many
    turns its first row shares with the row before and its last with the row after (-1:
    nothing before them is shared): two numbers per shard."""
    n = max(partitions(rows.sparkSession), -(-rows.count() // shard_rows))
    x = cut(rows.repartitionByRange(n, *_SORT).withColumn("_shard", F.spark_partition_id()))
    end = F.struct(*_SORT)
    ends = x.groupBy("_shard").agg(F.min(end).alias("lo"), F.max(end).alias("hi"))
    w = Window.orderBy("_shard")                                                 # one line per shard
    ends = ends.select("_shard", F.lag("hi").over(w).alias("before"), "lo")
    pairs = ends.select(
        "_shard", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "lo") for c in ("block", *_PREFIX, "body")])
    same = None
    for c in ("block", *_PREFIX):
        eq = F.col(f"before_{c}") == F.col(f"lo_{c}")
        same = eq if same is None else same & eq
    equal = [F.when(F.substring("before_body", 16 * j + 1, 16) == F.substring("lo_body", 16 * j + 1, 16), j + 1).otherwise(0)
             for j in range(BLOCK)]
    # the shared length is the first j at which the keys differ or one row ends
    differs = [F.when((equal[j] == 0) | (F.octet_length("before_body") <= 16 * j) | (F.octet_length("lo_body") <= 16 * j), j)
               for j in range(BLOCK)]
    shared = F.when(same, F.coalesce(*differs, F.lit(BLOCK))).otherwise(-1)
    left = dict(sorted((r["_shard"], r["l"]) for r in pairs.select("_shard", shared.cast("long").alias("l")).collect()))
    right = dict(zip(left, [*list(left.values())[1:], -1]))
    return x, {s: (left[s], right[s]) for s in left}


class Shard:
    """The rows of one shard in order, their padded turn-id matrix, and the marks on it."""

    def __init__(self, table: pa.Table, shared: tuple[int, int]):
        def longs(name):
            return table[name].to_numpy().astype(np.int64)

        conv, block = longs("conv_id"), longs("block")
        before = np.stack([longs(p) for p in _PREFIX], axis=1)
        goes_on = table["goes_on"].to_numpy().astype(bool)
        bodies = table["body"].to_pylist()
        k = np.array([len(b) // 16 for b in bodies], dtype=np.int64)
        m, width = len(conv), int(k.max(initial=0))
        present = np.arange(width) < k[:, None]
        keys = np.frombuffer(b"".join(bodies), ">u8").reshape(-1, 2)
        by_key = np.lexsort((keys[:, 1], keys[:, 0]))
        fresh = np.r_[True, (keys[by_key][1:] != keys[by_key][:-1]).any(axis=1)][:len(keys)]
        dense = np.empty(len(keys), np.int32)
        dense[by_key] = np.cumsum(fresh)                       # ids from 1 in key order
        ids = np.zeros((m, width), np.int32)
        ids[present] = dense
        lens = np.zeros((m, width), np.int64)
        lens[present] = table["lens"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((conv, goes_on, *ids.T[::-1], *before.T[::-1], block))
        self.conv, self.block, self.before, self.goes_on, self.k = (
            v[order] for v in (conv, block, before, goes_on, k))
        self.ids, self.lens = ids[order], lens[order]
        self.bodies = [bodies[i] for i in order]
        self.later = {c: longs(c)[order] for c in _CREDITS if c in table.column_names}
        self.m, self.width, (self.left, self.right) = m, width, shared
        # starts[i, d]: row i differs from the row before within its first d turns
        change = np.ones((m, width + 1), bool)
        change[1:, 0] = (self.block[1:] != self.block[:-1]) | (self.before[1:] != self.before[:-1]).any(axis=1)
        change[1:, 1:] = self.ids[1:] != self.ids[:-1]
        self.starts = np.logical_or.accumulate(change, axis=1)  # of runs in this shard
        self.true = self.starts.copy()                          # of nodes
        self.true[0] = np.arange(width + 1) > self.left
        # a row ends a leaf if it ends here and the next row leaves its node
        rows = np.arange(m)
        leaves_node = np.empty(m, bool)
        leaves_node[:-1] = self.starts[rows[1:], self.k[:-1]]
        leaves_node[-1:] = self.right < self.k[-1:]
        self.leaf = ~self.goes_on & leaves_node

    def fresh_bytes(self) -> np.ndarray:
        """Bytes of the turns whose node starts at the row."""
        return (self.lens * self.true[:, 1:]).sum(axis=1)


def _tables(batches: Iterator[pa.RecordBatch], shared: dict) -> Iterator[Shard]:
    """The shard of a task (a task holds one)."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        yield Shard(t, shared[t["_shard"][0].as_py()])


_MARKS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("b", pa.int64()), ("s", pa.int64()),
                    ("l", pa.int64()), ("c", pa.int64())])


def credits(rows: DataFrame, shard_rows: int) -> DataFrame:
    """What later blocks add to a conversation's row: bytes, bytes of nodes started there,
    leaves, and whether the next block starts a child of the last node of the row."""
    x, shared = shards(rows.where("block > 0"), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _tables(batches, shared):
            yield batch(_MARKS, [s.conv, s.block, s.lens.sum(axis=1), s.fresh_bytes(), s.leaf.astype(np.int64),
                                 s.true[:, 1].astype(np.int64)])

    marks = cut(x.mapInArrow(run, "conv_id long, block long, b long, s long, l long, c long"))
    own = marks.unionByName(marks.where("block = 1").select(
        "conv_id", (F.col("block") - 1).alias("block"), *[F.lit(0).cast("long").alias(c) for c in "bslc"]))
    summed = _running(own, {n: F.col(c) for n, c in zip(_CREDITS, "bsl")}, back=True)
    child = marks.select("conv_id", (F.col("block") - 1).alias("block"), F.col("c").alias("later_children"))
    return summed.select("conv_id", "block", *_CREDITS[:3]).join(child, ["conv_id", "block"], "left")


_NODES = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), ("partial", pa.bool_()), ("conv_id", pa.int64()),
                    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("first_end", pa.int64()),
                    ("ends_sha256", pa.string())])
_NODES_SQL = ("key binary, parent_key binary, partial boolean, conv_id long, depth long, parent_conv_id long, n_convs long, "
              "n_children long, n_leaves long, saved_tokens long, ends string, first_end long, ends_sha256 string")


def _key(shard: Shard, row: int, depth: int) -> bytes:
    """Key of the node of the first ``depth`` turns of a row. The node of a full row is
    named by what the next block carries, so blocks agree on it."""
    block, before, body = int(shard.block[row]), [int(v) for v in shard.before[row]], shard.bodies[row][:16 * depth]
    if depth == BLOCK:
        piece = hashlib.md5(body + str(block).encode()).hexdigest()
        before, block, body = [v + int(piece[8 * i:8 * i + 8], 16) for i, v in enumerate(before)], block + 1, b""
    return hashlib.md5(f"{block}:{before}:".encode() + body).digest()


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard_nodes(s: Shard) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard, depth by depth. Those that reach over its border are partial and
    carry their key; a node whose parent is partial or lies in an earlier block carries
    the parent's key instead of its figures."""
    own = np.where(s.true[:, 1:], 0, s.lens)
    tail = np.concatenate([np.cumsum(own[:, ::-1], axis=1)[:, ::-1], np.zeros((s.m, 1), np.int64)], axis=1)
    later = s.later["later_bytes"] - s.later["later_starts"]
    leaves = s.leaf + s.later["later_leaves"]
    parent_starts = parent_min = parent_partial = None
    for d in range(s.width + 1):
        at = np.flatnonzero(s.starts[:, d])
        size = np.diff(np.r_[at, s.m])
        low = np.minimum.reduceat(s.conv, at)
        partial = np.zeros(len(at), bool)
        partial[0] |= d <= s.left
        partial[-1] |= d <= s.right
        # bytes from depth d on (the root's own text is empty), each node's less one time
        saved = np.add.reduceat(tail[:, max(d - 1, 0)] + later, at)
        nodes_leaves = np.add.reduceat(leaves, at)
        children = np.add.reduceat(s.later["later_children"], at) if d == BLOCK else \
            np.add.reduceat((s.true[:, d + 1] & (s.k > d)).astype(np.int64), at) if d < s.width else np.zeros(len(at), np.int64)
        ends_here = (s.k == d) & ~s.goes_on
        n_ends = np.add.reduceat(ends_here.astype(np.int64), at)
        goes_on = np.add.reduceat(s.goes_on.astype(np.int64), at) > 0
        is_node = (s.k[at] >= d) if d else (s.block[at] == 0)
        up = np.searchsorted(parent_starts, at, side="right") - 1 if d else None
        far = ((d == 1) & (s.block[at] > 0)) | (parent_partial[up] if d else False)
        parent_keys: dict[int, bytes] = {}
        out = []
        for j in np.flatnonzero(is_node).tolist():
            row = int(at[j])
            named = bool(partial[j]) or (d == BLOCK and bool(goes_on[j]))
            key = _key(s, row, d) if named else None
            parent_key = parent = None
            if d:
                p = int(up[j])
                if far[j]:
                    parent_key = parent_keys.get(p) or parent_keys.setdefault(p, _key(s, row, d - 1))
                else:
                    parent = int(parent_min[p])
            ended = _joined(s.conv[row:row + n_ends[j]])
            digest = None if partial[j] else hashlib.sha256(ended.encode()).hexdigest()
            chunk = ended if partial[j] and n_ends[j] else None
            out.append((key, parent_key, bool(partial[j]), int(low[j]), int(s.block[row]) * BLOCK + d, parent, int(size[j]),
                        int(children[j]), int(nodes_leaves[j]), int(saved[j]), chunk,
                        int(s.conv[row]) if chunk is not None else None, digest))
        for a in range(0, len(out), 1000):
            yield batch(_NODES, list(zip(*out[a:a + 1000])))
        parent_starts, parent_min, parent_partial = at, low, partial


_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its chunks in order; only the hash's state is held."""
    key, state = None, None
    for b in batches:
        done = []
        for k, text in zip(b.column(0).to_pylist(), b.column(2)):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
        if done:
            yield batch(_ENDS, list(zip(*done)))
    if state is not None:
        yield batch(_ENDS, [[key], [state.hexdigest()]])


def trie(turns: DataFrame, sizes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over ``turns(conv_id, place, key, bytes)`` and all conversations
    ``sizes(conv_id, n)``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. Equal sequences share their nodes; a trie of turnless
    conversations is the root alone, without conversations there is no node."""
    rows = matrix_rows(turns, sizes)
    later = credits(rows, shard_rows)
    rows = rows.join(later, ["conv_id", "block"], "left").fillna(0, subset=_CREDITS)
    x, shared = shards(cut(rows), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _tables(batches, shared):
            yield from _shard_nodes(s)

    found = cut(x.mapInArrow(run, _NODES_SQL))
    empty = hashlib.sha256().hexdigest()
    chunks = found.where("ends IS NOT NULL").select("key", "first_end", "ends") \
        .repartition("key").sortWithinPartitions("key", "first_end")
    ends = chunks.mapInArrow(_stream_ends, "key binary, ends_sha256 string")
    joint = found.where("partial").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]) \
        .join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    nodes = cut(found.where(~F.col("partial")).select(*joint.columns).unionByName(joint))
    names = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    linked = nodes.where("parent_key IS NOT NULL").join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent"))
    return nodes.where("parent_key IS NULL").select(*columns).unionByName(linked.select(*columns))


def op13(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations (see ``turns_of``, ``rebuilt``, ``trie``).
    Other columns are ignored; repeated rows are turns like any other."""
    return trie(*rebuilt(turns_of(conversations.select("conv_id", "turn", "role", "text"))))
