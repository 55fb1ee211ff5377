"""Cycle sets against taking nodes away one level at a time; few jobs on long chains."""

import random

import pytest

from jobsight.operators import dag as D


def model(edges):
    def survivors(e):
        e = set(e)
        while True:
            alive = {d for _, d in e}
            kept = {(s, d) for s, d in e if s in alive}
            if kept == e:
                return {d for _, d in e}
            e = kept
    fwd = survivors(edges)
    inner = {(s, d) for s, d in edges if s in fwd}
    return fwd, survivors({(d, s) for s, d in inner})


def run(spark, edges):
    df = spark.createDataFrame(sorted(edges), "parent_id long, child_id long")
    down, between = D.cycles(df)
    return {r.node_id for r in down.collect()}, {r.node_id for r in between.collect()}


@pytest.mark.parametrize("seed,nodes,edges", [(1, 30, 25), (2, 30, 40), (3, 60, 70)])
def test_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    e = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)}
    assert run(spark, e) == model(e)


def test_small_shapes(spark):
    shapes = [{(1, 1)}, {(1, 2), (2, 3)}, {(1, 2), (2, 1), (2, 3), (3, 4), (0, 1), (9, 0)},
              {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6)}, {(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)}]
    off, joined, want_down, want_between = 0, set(), set(), set()
    for e in shapes:                            # side by side in one graph
        joined |= {(s + off, d + off) for s, d in e}
        down, between = model(e)
        want_down |= {n + off for n in down}
        want_between |= {n + off for n in between}
        off += 100
    assert run(spark, joined) == (want_down, want_between)
    empty = spark.createDataFrame([], "parent_id long, child_id long")
    assert [x.count() for x in D.cycles(empty)] == [0, 0]


def test_long_chain_takes_few_jobs(spark, monkeypatch):
    """A chain of 10,000 nodes into a ring, one out of it, and diamonds in between."""
    n = 10_000
    edges = [(i, i + 1) for i in range(n)] + [(i, i + 2) for i in range(0, n, 50)]
    edges += [(n, n + 1), (n + 1, n)] + [(n + i, n + i + 1) for i in range(1, 3_000)]
    cuts, real = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: cuts.append(1) or real(df))
    down, between = run(spark, set(edges))
    assert down == set(range(n, n + 3_001)) and between == {n, n + 1}
    assert len(cuts) <= 45
    with pytest.raises(D.RoundLimitExceeded):
        D.cycles(spark.createDataFrame([(1, 2), (2, 3)], "parent_id long, child_id long"), max_rounds=1)


def test_many_short_chains_take_few_jobs(spark, monkeypatch):
    """Every node of a chain has two parents, so that no chain folds up: few jobs all the same."""
    edges = set()
    for c in range(40):
        at = 1_000 * c
        edges |= {(at + i, at + i + lag) for i in range(60) for lag in (1, 2)}
        if c % 4 == 0:
            edges.add((at + 60, at + 3))
    cuts, real = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: cuts.append(1) or real(df))
    assert run(spark, edges) == model(edges)
    assert len(cuts) <= 15


@pytest.mark.parametrize("whole", [0, 4, 30])
def test_large_components_in_rounds(spark, monkeypatch, whole):
    """Components above the bound take the distributed rounds; a small buffer cuts batches inside components."""
    rng = random.Random(whole)
    e = {(50 * (k % 6) + rng.randrange(25), 50 * (k % 6) + rng.randrange(25)) for k in range(130)} | {(7, 7), (900, 900), (901, 902)}
    df = spark.createDataFrame(sorted(e), "parent_id long, child_id long")
    down, between = D.cycles(df, whole=whole)
    assert ({r.node_id for r in down.collect()}, {r.node_id for r in between.collect()}) == model(e)
