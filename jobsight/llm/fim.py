"""Fill-in-the-middle with piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never
change: its UTF-8 text and the sentinels. Cutting splits a descriptor in two, an
arrangement is a permutation of prefix, middle and suffix with sentinel descriptors put
between, and the inverse permutation over the descriptors found in an output gives the text
back. Hashes and outputs stream the descriptors' slices; no piece is built on its own.

Cut points count tokens (``[A-Za-z]+|[^A-Za-z]``). They are found on the bytes with numpy in
steps of ``STEP`` bytes, so a very long text needs little more memory than itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SENTINELS = b"<P><S><M>"
TEXT, MARK = 0, 1
P, S, M = (MARK, 0, 3), (MARK, 3, 3), (MARK, 6, 3)      # descriptors of the sentinel buffer
# Order of prefix (0), middle (1), suffix (2) in the output, and the sentinel before each.
ARRANGEMENTS = {"psm": ((0, P), (2, S), (1, M)), "spm": ((2, S), (0, P), (1, M))}
PLAIN_FROM, SPM_BELOW = 90, 20                          # percent
STEP = 1 << 20


def token_marks(data: np.ndarray, before: int) -> np.ndarray:
    """Marks the bytes at which a token starts; ``before`` is the byte in front (0: none)."""
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A)
    previous = np.empty_like(letter)
    previous[0] = 65 <= (before & 0xDF) <= 90
    previous[1:] = letter[:-1]
    return np.where(letter, ~previous, (data & 0xC0) != 0x80)


def token_counts(data: np.ndarray) -> np.ndarray:
    """Tokens in each step of the text."""
    return np.array([int(token_marks(data[a:a + STEP], int(data[a - 1]) if a else 0).sum())
                     for a in range(0, len(data), STEP)], dtype=np.int64)


def token_start(data: np.ndarray, counts: np.ndarray, unit: int) -> int:
    """Byte at which token ``unit`` starts (the length of the text past the last one)."""
    ends = np.cumsum(counts)
    step = int(np.searchsorted(ends, unit, side="right"))
    if step == len(counts):
        return len(data)
    a = step * STEP
    marks = token_marks(data[a:a + STEP], int(data[a - 1]) if a else 0)
    return a + int(np.flatnonzero(marks)[unit - int(ends[step] - counts[step])])


def cut(pieces: list[tuple], at: int) -> list[tuple]:
    """The piece table with a border ``at`` bytes after its start."""
    out = []
    for buffer, start, length in pieces:
        if 0 <= at <= length:
            out += [(buffer, start, at), (buffer, start + at, length - at)]
            at = -1
        else:
            out.append((buffer, start, length))
            at -= length if at >= 0 else 0
    return out


def arrange(parts: list[tuple], form: str) -> list[tuple]:
    """Prefix, middle and suffix in the order of ``form``, a sentinel before each."""
    return [d for part, mark in ARRANGEMENTS[form] for d in (mark, parts[part])]


def slices(pieces: list[tuple], text: memoryview) -> Iterator[memoryview]:
    buffers = (text, memoryview(SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def streamed_hash(pieces: list[tuple], text: memoryview) -> str:
    h = hashlib.sha256()
    for s in slices(pieces, text):
        h.update(s)
    return h.hexdigest()


def found(output: bytes, form: str) -> list[tuple]:
    """Prefix, middle and suffix as descriptors over an output: the text between the
    sentinels, brought back by the inverse permutation."""
    if form not in ARRANGEMENTS:
        return [(TEXT, 0, len(output))]
    order = [part for part, _ in ARRANGEMENTS[form]]
    starts, ends, at = [], [], 0
    for _, (_, mark, length) in ARRANGEMENTS[form]:
        place = output.index(SENTINELS[mark:mark + length], at)
        ends.append(place)
        at = place + length
        starts.append(at)
    ends = [*ends[1:], len(output)]
    inverse = [order.index(part) for part in range(3)]
    return [(TEXT, starts[i], ends[i] - starts[i]) for i in inverse]


def decide(doc_id, text: bytes, n: int) -> tuple[str, int, int]:
    """Form and the two cut units of a document of ``n`` tokens, from its id alone."""
    digest = hashlib.sha256(b"1:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = h[0] % (n + 1), h[1] % (n + 1)
    marked = any(SENTINELS[s:s + n_] in text for _, s, n_ in (P, S, M))
    if not text or marked or h[2] % 100 >= PLAIN_FROM:
        return "plain", min(units), max(units)
    return "spm" if h[3] % 100 < SPM_BELOW else "psm", min(units), max(units)


def _values(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column as views of its buffer."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield data[a:b]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output_sha256, output``.

    Null text counts as empty and an empty text is plain; a null id draws like the empty
    text. Repeated rows and ids are transformed one by one and alike; very long texts are
    cut whole. Columns of ``docs`` with the names of results are replaced, all others stay;
    an empty table gives an empty result."""
    results = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, output string"
    names = [part.split()[0] for part in results.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    quoted = [F.col(f"`{c}`") for c in kept]
    # columns go in by place, so those with dots or helper names go through
    source = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)],
                         F.col(f"`{id_col}`").alias("id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    schema = docs.select(*quoted, *[F.lit(None).cast(part.split()[1]).alias(part.split()[0])
                                    for part in results.split(", ")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, view in zip(b.column(len(kept)).to_pylist(), _values(b.column(len(kept) + 1))):
                text = bytes(view)
                data = np.frombuffer(text, np.uint8)
                counts = token_counts(data)
                n = int(counts.sum())
                form, first, second = decide(doc_id, text, n)
                pieces, chars = [(TEXT, 0, len(text))], (None, None)
                if form != "plain":
                    ends = [token_start(data, counts, unit) for unit in (first, second)]
                    pieces = cut(cut(pieces, ends[1]), ends[0])
                    chars = [_code_points(data[s:s + length]) for _, s, length in pieces[:2]]
                    pieces = arrange(pieces, form)
                out.append((n, form, *chars, streamed_hash(pieces, view), b"".join(slices(pieces, view)).decode()))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             names=[*kept, *names])

    return source.mapInArrow(run, schema)


def _code_points(data: np.ndarray) -> int:
    return sum(int(((data[a:a + STEP] & 0xC0) != 0x80).sum()) for a in range(0, len(data), STEP))


def restore(rows: DataFrame) -> DataFrame:
    """``rows(output, form)`` with ``restored`` and ``restored_sha256``, read from these two
    columns alone. A null output counts as empty; a form other than psm and spm is plain; an
    output without the sentinels of its form raises."""
    kept = [c for c in rows.columns if c not in ("restored", "restored_sha256")]
    quoted = [F.col(f"`{c}`") for c in kept]
    source = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)],
                         F.col("form").alias("form"), utf8("output").alias("output"))
    schema = rows.select(*quoted, F.lit(None).cast("string").alias("restored"),
                         F.lit(None).cast("string").alias("restored_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes = [], []
            for form, view in zip(b.column(len(kept)).to_pylist(), _values(b.column(len(kept) + 1))):
                pieces = found(bytes(view), form)
                hashes.append(streamed_hash(pieces, view))
                texts.append(b"".join(slices(pieces, view)).decode())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(texts, pa.string()), pa.array(hashes, pa.string())],
                names=[*kept, "restored", "restored_sha256"])

    return source.mapInArrow(run, schema)


def op12(docs: DataFrame) -> DataFrame:
    """The digests of every document's transformation and of its way back."""
    done = restore(transform(docs.select("doc_id", "text")).drop("text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
