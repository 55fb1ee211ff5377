"""Transcript parsing by a hidden Markov model and canonical turn rendering.

Every line of a transcript gives one symbol: the speaker marker at its start (``User:``,
``### Assistant``, ``<|im_start|>system``, ...), where it stands (first line of the
transcript, first line of a row, later line), its length and whether it asks. The states
are (role, first line of a turn) and (role, later line). Start, transition and emission
counts come from all rows with a known role; Viterbi recovers the roles, turns are rendered.

A conversation may be of any length: it is cut into blocks of ``BLOCK`` rows, by their place
in the conversation. A block becomes a max-plus matrix (best log-probability from each state before it to each
state at its end); matrices are joined ``FAN`` at a time, level by level, until one group a
conversation is left; the best path through the groups fixes the states at their borders,
level by level down again, and each block is decoded between its border states. The parts
of a turn that goes on over borders are put together before it is rendered. No task
holds more than one block, ``FAN`` matrices of a conversation, or one turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..operators.windows import id_range, lag_in_groups, running_sum_in_groups
from .common import cut, partitions, positions

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)          # role * 2 + (0: first line of a turn, 1: later line)
BLOCK = 64
FAN = 256
# Words that name a speaker at the start of a line. Fixed values, chosen here.
MARKERS = {
    "system": "system instruction instructions context",
    "user": "user human customer client question prompt q me you",
    "assistant": "assistant ai bot gpt model answer agent response support a",
}
_NAMED = "|".join(f"(?P<{r}>{'|'.join(w.split())})" for r, w in MARKERS.items())
_MARK = re.compile(rf"\s*(?:#{{1,4}}\s*(?:{_NAMED})\b\s*:?|".replace("(?P<", "(?P<h_")
                   + rf"(?:<\|(?:im_start\|>)?|\[|\*\*)?(?:{_NAMED})(?:\|>|\]|\*\*)?\s*[:>]".replace("(?P<", "(?P<c_")
                   + rf"|<\|im_start\|>\s*(?:{_NAMED})\b|<\|(?:{_NAMED.replace('(?P<', '(?P<p_')})\|>)\s*", re.I)
SYMBOLS = 4 * 3 * 4 * 2
_PRIOR_MARK = 20.0               # pseudo-counts: a marker speaks for its role


def marker(line: str) -> tuple[int, int]:
    """Marker class (0: none, else 1 + role) and the length of the marker."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    name = next(k for k, v in m.groupdict().items() if v is not None).split("_")[-1]
    return 1 + ROLES.index(name), m.end()


def symbol(line: str, place: int) -> int:
    """``place``: 0 first line of the transcript, 1 first line of a row, 2 later line."""
    n = len(line)
    size = 0 if n < 40 else 1 if n < 160 else 2 if n < 400 else 3
    return ((marker(line)[0] * 3 + place) * 4 + size) * 2 + line.rstrip().endswith("?")


def _lines(rows, block: int) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    """(row, line number, line) of a block's rows ``(turn, role, text)`` and their symbols;
    block 0 begins the transcript."""
    out, syms = [], []
    for k, (_, _, text) in enumerate(rows):
        for j, line in enumerate((text or "").split("\n")):
            out.append((k, j, line))
            syms.append(symbol(line, 2 if j else 1 if k or block else 0))
    return out, np.array(syms)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of equal first ``keys`` columns; holds one group at a time."""
    rows = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in batches if b.num_rows)
    key, held = None, []
    for r in rows:
        if held and r[:keys] != key:
            yield key, held
            held = []
        key = r[:keys]
        held.append(r[keys:])
    if held:
        yield key, held


def _blocked(turns: DataFrame) -> DataFrame:
    """``conv_id, block, turn, role, text``: ``BLOCK`` rows a block by their place in the
    conversation; rows in order of turn (null first), ties by text and role. Places come from
    one sort of all rows, so rows of one turn number, or of none, spread like any others."""
    x = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower(F.col("role").cast("string")).alias("role"),
                     F.col("text").cast("string").alias("text"))
    x = positions(x, [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "text", "role")])
    lines = x.groupBy("_part", "conv_id").agg(F.min("_at").alias("_f"))
    first = lines.groupBy(F.col("conv_id").alias("_g")).agg(F.min("_f").alias("_first"))
    lines = lines.join(first, F.col("conv_id").eqNullSafe(F.col("_g"))).select(F.col("_part").alias("_p"), F.col("conv_id").alias("_c"), "_first")
    x = x.join(lines, (F.col("_part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")))
    return x.select("conv_id", F.floor((F.col("_at") - F.col("_first")) / BLOCK).alias("block"), "turn", "role", "text")


def _dealt(rows: DataFrame, *also: str) -> DataFrame:
    """Blocks dealt to tasks, their rows in order."""
    n = partitions(rows.sparkSession)
    return rows.select("conv_id", "block", *also, "turn", "role", "text").repartition(n, F.xxhash64("conv_id", "block")) \
        .sortWithinPartitions("conv_id", "block", "turn", "text", "role")


def fit(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log start, transition and emission tables from all rows whose role is known, over
    block borders too. Without any such row the pseudo-counts speak."""
    conv_type = to_arrow_type(turns.schema["conv_id"].dataType)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.float64()), ("conv_id", conv_type), ("block", pa.int64()),
                        ("enters", pa.int32()), ("leaves", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        ends: list[dict] = []
        for (conv, block), rows in _groups(batches, 2):
            lines, syms = _lines(rows, block)
            before, first = None, None
            for i, ((k, j, _), y) in enumerate(zip(lines, syms)):
                role = rows[k][1]
                s = ROLES.index(role) * 2 + (j > 0) if role in ROLES else None
                first = s if i == 0 else first
                if s is not None:
                    emit[s, y] += 1
                    if before is not None:
                        move[before, s] += 1
                    elif block == 0 and k == 0 and j == 0:
                        start[s] += 1
                before = s
            ends.append({"conv_id": conv, "block": block, "enters": first, "leaves": before})
            if len(ends) >= 2000:
                yield pa.RecordBatch.from_pylist(ends, schema=schema)
                ends = []
        flat = np.concatenate([start, move.ravel(), emit.ravel()])
        yield pa.RecordBatch.from_pylist(ends + [{"cell": i, "n": v} for i, v in enumerate(flat.tolist()) if v], schema=schema)

    kind = turns.schema["conv_id"].dataType.simpleString()
    seen = cut(_dealt(_blocked(turns)).mapInArrow(run, f"cell long, n double, conv_id {kind}, block long, enters int, leaves int"))
    ends = lag_in_groups(seen.where("cell IS NULL"), ["conv_id"], ["block"], ["leaves"], [id_range("block", 4096)])
    over = ends.where("prev_leaves IS NOT NULL AND enters IS NOT NULL") \
        .select((STATES + F.col("prev_leaves") * STATES + F.col("enters")).cast("long").alias("cell"), F.lit(1.0).alias("n"))
    rows = seen.where("cell IS NOT NULL").select("cell", "n").unionByName(over).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
    for r in rows:                       # one row a cell: a few hundred
        flat[r["cell"]] = r["n"]
    start = flat[:STATES] + np.tile([1.0, 0.01], len(ROLES))
    move = flat[STATES:STATES + STATES * STATES].reshape(STATES, STATES) + 0.1
    emit = flat[STATES + STATES * STATES:].reshape(STATES, SYMBOLS) + 0.05
    mark, place = np.arange(SYMBOLS) // 24, np.arange(SYMBOLS) // 8 % 3
    emit[1::2, place < 2] -= 0.0499      # a row's first line hardly ever goes on with a turn
    for i in range(len(ROLES)):
        emit[2 * i, mark == 1 + i] += _PRIOR_MARK
    norm = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    return {"start": norm(start), "move": norm(move), "emit": norm(emit)}


def _entry(model: dict) -> np.ndarray:
    """Scores of the first line's state by the state before it; the last row, ``STATES``,
    stands for the beginning of the conversation."""
    return np.vstack([model["move"], model["start"]])


def _path(model: dict, syms: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """Best states of a block's lines given the state before it and (-1: free) at its end."""
    e = model["emit"][:, syms]
    v = _entry(model)[enter] + e[:, 0]
    back = np.zeros((len(syms), STATES), np.int64)
    for t in range(1, len(syms)):
        w = v[:, None] + model["move"]
        back[t] = np.argmax(w, axis=0)
        v = w[back[t], np.arange(STATES)] + e[:, t]
    s = int(np.argmax(v)) if leave < 0 else leave
    out = np.empty(len(syms), np.int64)
    for t in range(len(syms) - 1, -1, -1):
        out[t] = s
        s = back[t, s]
    return out


def _matrix(model: dict, syms: np.ndarray) -> np.ndarray:
    """Max-plus product over a block: best score from the state before to the state at the end."""
    m = _entry(model) + model["emit"][:, syms[0]][None, :]
    for y in syms[1:]:
        m = (m[:, :, None] + model["move"][None]).max(axis=1) + model["emit"][:, y][None, :]
    return m


def _borders(mats: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at the ends of consecutive matrices, given those before the first and
    (-1: free) at the end of the last."""
    v = mats[0][enter]
    back = []
    for m in mats[1:]:
        w = v[:, None] + m[:STATES]
        back.append(np.argmax(w, axis=0))
        v = w.max(axis=0)
    s = int(np.argmax(v)) if leave < 0 else leave
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


_NODE = "conv_id {0}, block long, m array<double>"


def _by(df: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *([order] if order else []))


def decode(turns: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``conv_id, turn, line, role, text, rendered``: one row per recovered turn, at the row's
    turn number and line where it begins. Markers are left out of the text.

    A null text is one empty line; a null role is recovered like any other; a null turn
    counts as 0 and comes first, a null conv_id is one conversation; equal rows are parsed
    each; an empty table gives an empty result; other columns are ignored."""
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = cut(_blocked(turns))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for (conv, block), own in _groups(batches, 2):
            a = _matrix(m, _lines(own, block)[1])
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": block, "m": a.ravel().tolist()}], schema=node_schema)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, up), own in _groups(batches, 2):
            a = None
            for _, m in own:
                b = np.array(m).reshape(STATES + 1, STATES)
                a = b if a is None else (a[:, :, None] + b[None, :STATES]).max(axis=1)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": up, "m": a.ravel().tolist()}], schema=node_schema)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input conv_id, up, enter, leave, block, m; output the states around each node."""
        for (conv, _, enter, leave), own in _groups(batches, 4):
            mats = [np.array(m).reshape(STATES + 1, STATES) for _, m in own]
            s = _borders(mats, enter, leave)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": b, "enter": i, "leave": j} for (b, _), i, j
                                              in zip(own, [enter, *s[:-1]], s)], schema=state_schema)

    conv_type = to_arrow_type(turns.schema["conv_id"].dataType)
    node_schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("m", pa.list_(pa.float64()))])
    state_schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
    last = rows.agg(F.max("block")).first()[0]
    whole = not last                     # every conversation is one block: no borders to find
    states = None
    if not whole:
        levels = [cut(_dealt(rows).mapInArrow(ends, _NODE.format(kind)))]
        for _ in range(8):
            top = levels[-1]
            if top.agg(F.max("block")).first()[0] < FAN:
                break
            wide = top.select("conv_id", F.floor(F.col("block") / FAN).alias("up"), "block", "m")
            levels.append(cut(_by(wide, "conv_id", "up", order="block").mapInArrow(product, _NODE.format(kind))))
        states = levels[-1].select("conv_id", F.lit(0).cast("long").alias("up")).distinct() \
            .withColumns({"enter": F.lit(STATES), "leave": F.lit(-1)})
        for depth in range(len(levels) - 1, -1, -1):
            top = depth == len(levels) - 1
            node = levels[depth].select(F.col("conv_id").alias("c"), (F.lit(0) if top else F.floor(F.col("block") / FAN))
                                        .cast("long").alias("u"), "block", "m")
            joined = states.join(node, states["conv_id"].eqNullSafe(node["c"]) & (states["up"] == node["u"])) \
                .select("conv_id", "up", "enter", "leave", "block", "m")
            states = cut(_by(joined, "conv_id", "up", "enter", "leave", order="block")
                         .mapInArrow(down, f"conv_id {kind}, block long, enter int, leave int"))
            if depth:
                states = states.withColumnRenamed("block", "up")
        edge = states.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), "enter", "leave")
        rows = rows.join(edge, rows["conv_id"].eqNullSafe(edge["c"]) & (rows["block"] == edge["k"]))
    else:
        rows = rows.withColumns({"enter": F.lit(STATES), "leave": F.lit(-1)})
    rows = _dealt(rows, "enter", "leave")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of turns; the last part of a block and one that goes on from the block
        before stay open (with their texts as they are), all others are whole turns."""
        m = shared.value
        out: list[dict] = []
        for (conv, block, enter, leave), own in _groups(batches, 4):
            lines, syms = _lines(own, block)
            path = _path(m, syms, enter, leave)
            role, parts = ROLES[enter // 2] if enter < STATES else None, []
            for (k, j, line), s in zip(lines, path.tolist()):
                begins = s % 2 == 0 or ROLES[s // 2] != role
                role = ROLES[s // 2]
                text = line[marker(line)[1]:] if s % 2 == 0 else line
                if begins or not parts:
                    parts.append({"conv_id": conv, "block": block, "part": len(parts), "turn": own[k][0], "line": j,
                                  "begins": begins, "open": not begins, "role": role, "text": [text]})
                else:
                    parts[-1]["text"].append(text)
            parts[-1]["open"] = not whole or parts[-1]["open"]
            for p in parts:
                p["text"] = "\n".join(p["text"]) if p["open"] else "\n".join(p["text"]).strip()
            out += parts
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=part_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=part_schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(t).strip() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=b.schema.names)

    part_schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("part", pa.int64()), ("turn", pa.int64()), ("line", pa.int64()),
                             ("begins", pa.bool_()), ("open", pa.bool_()), ("role", pa.string()), ("text", pa.string())])
    parts = rows.mapInArrow(label, f"conv_id {kind}, block long, part long, turn long, line long, begins boolean, open boolean, "
                                   "role string, text string")
    columns = ["conv_id", "turn", "line", "role", "text"]
    if not whole:
        parts = cut(parts)
        number = running_sum_in_groups(parts.where("open").withColumn("_one", F.col("begins").cast("long")), ["conv_id"],
                                       ["block", "part"], "_one", "_turn", [id_range("block", 4096)])
        head = F.struct("block", "part", "turn", "line", "role")
        joined = number.groupBy("conv_id", "_turn").agg(
            F.min(head).alias("_h"), F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "text"))), lambda p: p["text"]).alias("text"))
        joined = joined.select("conv_id", F.col("_h.turn").alias("turn"), F.col("_h.line").alias("line"), F.col("_h.role").alias("role"), "text") \
            .mapInArrow(join, f"conv_id {kind}, turn long, line long, role string, text string")
        parts = parts.where("NOT open").select(*columns).unionByName(joined)
    return parts.select(*columns, F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")).alias("rendered"))


def held_out(c: str = "conv_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4(turns: DataFrame) -> DataFrame:
    """All conversations parsed by a model that learned from those not held out."""
    return decode(turns, fit(turns.where(~held_out())))
