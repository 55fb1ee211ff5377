"""SimHash fingerprints, trie links and classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from jobsight.llm import simhash as S


def brute_fp(text, k=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(ids, fps, bits=2):
    par = list(range(len(ids)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                par[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprints():
    r = random.Random(2)
    texts = ["", "  \n", "One", "one  TWO", "a b c", "É a É", "x y z w", " ".join(r.choices(["ab", "C", "dd", "é"], k=70_000))]
    for t in texts:
        assert S.fingerprint_of(t.encode()) == brute_fp(t)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c))
                                      for b in range(0, 64, 9) for c in range(0, 64, 7)]))
    group = np.zeros(len(codes), np.int64)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    got = S.trie_links(codes, group, 2)
    assert {(min(a, b), max(a, b)) for a, b in got.tolist()} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("limit", [S.TRIE_LIMIT, 3])
def test_links_split_hot_tries(spark, limit):
    """Splitting tries again loses no link: classes equal those of all pairs."""
    rng = np.random.default_rng(6)
    low = rng.integers(0, 1 << 12, 60, dtype=np.int64)
    high = rng.integers(-(1 << 40), 1 << 40, 40, dtype=np.int64) << 23
    codes = sorted({int(x) for x in np.concatenate([low, high, high ^ 5, high ^ (1 << 60)])})
    from jobsight.llm.components import components
    edges = S.links(spark.createDataFrame([(c,) for c in codes], "fp long"), 2, limit)
    roots = {r.node: r.root for r in components(edges).collect()}
    want = brute_classes(list(range(len(codes))), codes)
    got = [codes.index(roots.get(c, c)) for c in codes]
    classes = lambda v: sorted(sorted(i for i in range(len(v)) if v[i] == x) for x in set(v))
    assert classes(got) == classes(want)


def test_near_duplicates_edge_rows(docs_of):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word299", "other")
    rows = [(5, base), (3, near), (9, base.upper()), (7, "alone in here"), (1, None), (2, ""), (2, ""), (None, base), (4, "\t\n")]
    out = S.op2(docs_of(rows)).collect()
    assert len(out) == len(rows)
    fps = {(t or ""): brute_fp(t) for _, t in rows}
    ids, codes = [d for d, _ in rows], [fps[t or ""] for _, t in rows]
    want = sorted(zip([d or 0 for d in ids], [f"{c:016x}" for c in codes], brute_classes(ids, codes)))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in out) == want
    kept = S.keep_one(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in brute_classes(ids, codes)})
    assert kept.columns == docs_of(rows).columns


def test_one_row_of_each_class_is_kept(docs_of):
    """Different texts without doc_id or of one doc_id all stay; each class keeps one row."""
    words = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=300))
    rows = [(None, words(i)) for i in range(6)] + [(None, words(0)), (None, words(1).upper())]
    for i in range(10, 16):          # doc_id i: one text of its own, one that doc 2 .. 7 has as well
        rows += [(i, words(i)), (i, words(i + 100)), (i - 8, words(i + 100))]
    rows += [(20, words(20)), (20, words(20)), (None, words(20))]
    kept = [(r.doc_id, r.text) for r in S.keep_one(docs_of(rows)).collect()]
    codes = [brute_fp(t) for _, t in rows]
    classes = {}
    for (d, t), c in zip(rows, codes):
        classes.setdefault(next((k for k in classes if (k ^ c).bit_count() <= 2), c), []).append((d, t))
    assert len(classes) == 6 + 12 + 1 and len(kept) == len(classes)
    assert sorted(brute_fp(t) for _, t in kept) == sorted(classes)
    for d, t in kept:
        members = classes[brute_fp(t)]
        assert (d, t) in members and d == min((x for x, _ in members if x is not None), default=None)


def test_empty(docs_of):
    none = docs_of([(1, "a")]).limit(0)
    assert S.op2(none).collect() == [] and S.keep_one(none).collect() == []


def test_whole_table_query(spark, small):
    from jobsight.llm.queries import op2_simhash
    rows = small("documents").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    codes = [brute_fp(r.text) for r in rows]
    want = {r.doc_id: (f"{c:016x}", k) for r, c, k in zip(rows, codes, brute_classes([r.doc_id for r in rows], codes))}
    assert got == want


def test_components_long_path(spark):
    from jobsight.llm.components import components
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
