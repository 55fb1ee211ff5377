"""Mixing against targets solved by hand, words taken, and the whole mixture."""

import collections
import re

import pytest

from jobsight.llm import mixing as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling by rounds: ``sizes`` of the sources in order, null last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, full = sum(sizes.values()), set()
    while True:
        left = whole - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and want[s] > 3 * sizes[s]}
        if not over:
            return want
        full |= over


def check(rows, out):
    """``rows`` of (doc_id, text, source); returns the targets."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    got = collections.Counter((r.doc_id, r.source, r["size"], r.source_size) for r in out)
    assert got == collections.Counter((d, s, size(t), sizes[s]) for d, t, s in rows)
    taken, longest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.target <= 3 * r.source_size + 1e-9
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    return want


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_reshared(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 10, "d": 7}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"x": 5, None: 9},
                  {"a": 0, "b": 0}, {"": 3, "A": 3, "a": 3, "é": 3, "漢": 50}, {None: 4}):
        got = X.with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert {r.source: r.target for r in got} == pytest.approx(want)
    assert X.with_targets(spark.createDataFrame([], "source string, source_size long")).collect() == []


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", "a"), (3, "one", "a"), (None, "no id here", None), (4, "w " * 50_000, "b"),
            (5, "\x85 \xa0 ​", ""), (6, " \t\n\x0b\x0c\r ", "empty")] + [(i, "x y z " * (i % 7), "hot") for i in range(10, 400)]
    out = X.op11(make(spark, rows)).collect()
    check(rows, out)
    assert X.op11(make(spark, []).limit(0)).collect() == []
    again = X.op11(make(spark, rows[::-1]).repartition(7)).collect()
    order = lambda rs: sorted((tuple(r) for r in rs), key=str)
    assert order(out) == order(again)


def test_mixture_holds_the_copies(docs_of):
    rows = [(i, "word " * (1 + i % 9), "en", ("s1", "s2", None)[i % 3]) for i in range(120)] + [(7, "twice twice", "en", "s1")] * 5
    table = docs_of(rows)
    plan = X.op11(table).collect()
    out = X.mix(table)
    assert out.columns == table.columns
    got = collections.Counter((r.doc_id, r.source) for r in out.collect())
    want = collections.Counter()
    for r in plan:
        want[(r.doc_id, r.source)] += r.copies
    same = {s: sum(v for (_, t), v in got.items() if t == s) for s in ("s1", "s2", None)}
    # the two hash whole rows of different columns, so only sums per source must agree closely
    assert all(abs(same[s] - sum(v for (_, t), v in want.items() if t == s)) <= 1 for s in same)


def test_whole_table(spark, small):
    from jobsight.llm.queries import op11_mixing
    rows = [(r.doc_id, r.text, r.source) for r in small("documents").collect()]
    check(rows, op11_mixing(spark, "/root/testdata/sf0.001").collect())
