"""Transcript parsing: brute-force Viterbi, held-out roles, blocks, rendering, edge rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsight.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def model(small):
    return C.fit(small("conversations"))


def test_path_is_the_best_of_all(model):
    rng = np.random.default_rng(0)
    for enter, leave in ((C.STATES, -1), (2, 3), (0, -1), (C.STATES, 4)):
        syms = rng.integers(0, C.SYMBOLS, 5)
        best, score = None, -np.inf
        for p in itertools.product(range(C.STATES), repeat=5):
            if leave >= 0 and p[-1] != leave:
                continue
            s = C._entry(model)[enter][p[0]] + sum(model["move"][a, b] for a, b in zip(p, p[1:])) \
                + sum(model["emit"][a, y] for a, y in zip(p, syms))
            if s > score:
                best, score = p, s
        got = C._path(model, syms, enter, leave)
        total = C._entry(model)[enter][got[0]] + sum(model["move"][a, b] for a, b in zip(got, got[1:])) \
            + sum(model["emit"][a, y] for a, y in zip(got, syms))
        assert abs(total - score) < 1e-9
        assert abs(C._matrix(model, syms)[enter][got[-1]] - score) < 1e-9


def test_held_out_roles(spark, small):
    from jobsight.llm.queries import op4_chat
    base = {(r.conv_id, r.turn): r.role for r in small("conversations").collect()}
    held = {r.conv_id for r in small("conversations").where(C.held_out()).select("conv_id").collect()}
    out = [r for r in op4_chat(spark, "/root/testdata/sf0.001").collect() if r.line == 0]
    test = [r for r in out if r.conv_id in held]
    assert {(r.conv_id, r.turn) for r in out} == set(base)
    assert sum(base[r.conv_id, r.turn] == r.role for r in test) / len(test) > 0.9
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>\n" for r in out)


def test_markers_in_a_raw_transcript(spark, model):
    raw = "System: be nice\nUser: hello\nhow are you?\n\n### Assistant\nfine\n<|im_start|>user ok"
    rows = C.decode(spark.createDataFrame([(1, 0, None, raw)], TURNS), model).orderBy("line").collect()
    assert [(r.role, r.text) for r in rows] == [("system", "be nice"), ("user", "hello\nhow are you?"),
                                                ("assistant", "fine"), ("user", "ok")]


@pytest.mark.parametrize("block,fan", [(1, 3), (4, 3), (7, 256), (64, 256)])
def test_long_conversation_in_blocks(spark, model, monkeypatch, block, fan):
    """Whole rendered turns are the same however the rows are cut."""
    text = ["yes", "What is that?", "a b c " * 30, "line\nline two", None]
    rows = [(1, i, None, text[i % 5]) for i in range(130)] + [(2, 0, "user", "Hi"), (None, 3, None, "x")]
    rows += [(3, None if i % 2 else 5, None, f"User: part {i}\n goes on {i}") for i in range(20)]
    rows += [(4, i, None, "user: a\nb" if i == 0 else "and so on") for i in range(70)]
    df = spark.createDataFrame(rows, TURNS)
    model = dict(model, emit=model["emit"] + np.tile([-14.0, 0.0], len(C.ROLES))[:, None])   # turns go on more often
    key = lambda out: sorted(map(str, out.collect()))
    monkeypatch.setattr(C, "BLOCK", 10_000)
    whole = C.decode(df, model)
    want = key(whole)
    assert whole.where("conv_id = 4").count() < 60                 # some turns span many rows
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "FAN", fan)
    assert key(C.decode(df, model)) == want


def test_counts_over_borders(spark, monkeypatch):
    rows = [(1, i, ("user", "assistant")[i % 2], "x" if i % 3 else "x\ny") for i in range(50)] + [(2, None, "user", "q")] * 9
    df = spark.createDataFrame(rows, "conv_id short, turn long, role string, text string")
    whole = C.fit(df)
    monkeypatch.setattr(C, "BLOCK", 3)
    cut = C.fit(df)
    assert all(np.allclose(whole[k], cut[k]) for k in whole)
    assert C.decode(df, cut).schema["conv_id"].dataType.simpleString() == "smallint"


def test_edge_rows(spark, model):
    rows = [(1, None, None, None), (1, 0, "USER", "a"), (1, 0, "USER", "a"), (None, 0, "x", ""), (2, -1, "user", "z" * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"line": F.lit(1), "block": F.lit("x"), "rendered": F.lit("y")})
    out = C.decode(df, model).collect()
    assert {(r.conv_id, r.turn) for r in out} >= {(1, 0), (None, 0), (2, -1)}
    assert sum(r.conv_id == 2 for r in out) == 1 and max(len(r.text) for r in out) == 100_000
    assert C.op4(df.limit(0)).collect() == []
