"""Fill-in-the-middle against a plain version by regular expression and slicing."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsight.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (n, "plain", None, None, sha(text), sha(text)), text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (n, form, len(pre), len(mid), sha(out), sha(text)), out


def digest(r):
    return r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256


ROWS = [(0, None), (1, ""), (2, "a"), (2, "a"), (3, "x"), (None, "no id"), (4, "Some <S> inside"), (5, "ends with <"),
        (6, "héllo wörld 漢字 \U0001f600\U0001f600 é"), (7, "\n\r\t \x00"), (8, "wörd " * 300_000), (9, "z" * 1_500_000),
        (10, "<P"), (11, "é" * 700_000)] + [(i, f"text <{i}> with < and > " * (i % 5)) for i in range(12, 200)]


def test_rows_against_plain(docs_of):
    table = docs_of(ROWS)
    got = sorted(((r.doc_id, digest(r)) for r in fim.op12(table).collect()), key=str)
    assert got == sorted(((d, plain(d, t)[0]) for d, t in ROWS), key=str)
    assert {g[1][1] for g in got} == {"plain", "psm", "spm"}
    assert fim.op12(table.limit(0)).collect() == []


def test_real_outputs_and_other_columns(docs_of):
    table = docs_of(ROWS[:8]).selectExpr("*", "'mine' AS form", "'x' AS __fim", "1 AS restored")
    out = fim.transform(table)
    assert {"lang", "source", "a.b", "spans", "restored"} <= set(out.columns) and out.columns.count("form") == 1
    assert sorted(((r.doc_id, r.output) for r in out.collect()), key=str) \
        == sorted(((d, plain(d, t)[1]) for d, t in ROWS[:8]), key=str)
    back = fim.restore(out)
    assert all((r.text or "") == r.restored for r in back.collect())
    assert back.columns.count("restored") == 1


def test_other_id_types(spark):
    rows = [("a-1", "some words in a text"), (None, "other words")]
    out = fim.op12(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((digest(r) for r in out), key=str) == sorted((plain(d, t)[0] for d, t in rows), key=str)


def test_whole_table(spark, small):
    from jobsight.llm.queries import op12_fim
    got = {r.doc_id: digest(r) for r in op12_fim(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: plain(r.doc_id, r.text)[0] for r in small("documents").collect()}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSMé漢\U0001f600 \n", max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(1, 9))
def test_cuts_and_way_back(text, x, y, step):
    fim.STEP, kept = step, fim.STEP
    try:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        counts = fim.token_counts(data)
        tokens = TOKEN.findall(text)
        assert counts.sum() == len(tokens)
        a, b = sorted((min(x, len(tokens)), min(y, len(tokens))))
        at = [fim.token_start(data, counts, u) for u in (a, b)]
        assert at == [len("".join(tokens[:u]).encode()) for u in (a, b)]
        parts = fim.cut(fim.cut([(fim.TEXT, 0, len(raw))], at[1]), at[0])
        assert len(parts) == 3 and b"".join(fim.slices(parts, memoryview(raw))) == raw
        if not re.search("<[PSM]>", text):
            for form in fim.ARRANGEMENTS:
                out = b"".join(fim.slices(fim.arrange(parts, form), memoryview(raw)))
                assert b"".join(fim.slices(fim.found(out, form), memoryview(out))) == raw
    finally:
        fim.STEP = kept
