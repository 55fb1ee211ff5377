"""Quality rules: counts against brute force, verdicts on labelled and planted rows."""

import collections
import random
import re

import numpy as np

from jobsight.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(zip(words, words[1:], words[2:]))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if tri[words[i], words[i + 1], words[i + 2]] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    n, rep = len(words), sum(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n)


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_whole_table_query(spark, small):
    from jobsight.llm.queries import op7_quality
    out = {r.doc_id: r for r in op7_quality(spark, "/root/testdata/sf0.001").collect()}
    docs = small("documents").collect()
    assert len(out) == len(docs)
    for d in docs:
        assert counts(out[d.doc_id]) == brute(d.text)
        assert not (out[d.doc_id].base_failed and out[d.doc_id].kept)


def test_labelled_quality(spark):
    """Held against the labels, which the method never sees."""
    from jobsight.llm.common import table
    sf = "/root/testdata/sf0.01"
    out = Q.op7(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def vectors(texts):
    return np.array([[min(1 << 20, round(v * Q.SCALE)) for v in Q.text_stats(t.encode())[1]] for t in texts], float)


def ordinary(r, n):
    return [" ".join(r.choice(["alpha", "be", "gammas", "d"]) + str(r.randrange(99)) for _ in range(r.randrange(60, 400))) for _ in range(n)]


def distances(x, mean, cov):
    e = x - mean
    return np.einsum("ij,jk,ik->i", e, np.linalg.inv(cov), e)


def least_determinant(x, rng, starts=300):
    """Minimum covariance determinant by many random starts on exact halves of the rows."""
    h, best = int(np.floor(len(x) * Q.H_PART + 0.5)), (np.inf, None, None)
    floor = np.diag(Q.FLOOR ** 2)
    for _ in range(starts):
        some = x[rng.choice(len(x), Q.D + 1, replace=False)]
        mean, cov, last = some.mean(0), np.cov(some.T, bias=True) + floor, np.inf
        while True:
            near = np.argsort(distances(x, mean, cov), kind="stable")[:h]
            mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) * Q.C_HALF + floor
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
        if last < best[0]:
            best = (last, mean, cov)
    return best


def test_least_determinant_and_distances(spark, docs_of):
    """Against random starts with exact halves; 45 % of the rows lie elsewhere."""
    r = random.Random(3)
    good = ordinary(r, 260)
    junk = [" ".join(["###!!"] * r.randrange(30, 60) + [f"W{i}x{j}" for j in range(r.randrange(60, 90))]) for i in range(210)]
    rows = list(enumerate(good + junk))
    x = vectors(t for _, t in rows)
    det, mean, cov = least_determinant(x, np.random.default_rng(1))
    frame = spark.createDataFrame([("g", len(rows), i % 4, *map(int, v)) for i, v in enumerate(x)],
                                  "grp string, n long, bucket int, " + ", ".join(f"x{i} long" for i in range(Q.D)))
    got = Q.estimate(frame).collect()
    assert len(got) == 1 and got[0].logdet <= det + 0.05
    inside = distances(x, np.array(got[0]["mean"]), np.linalg.inv(np.array(got[0].prec).reshape(Q.D, Q.D))) <= Q.INSIDE
    final = distances(x, x[inside].mean(0), np.cov(x[inside].T, bias=True) * Q.C_INSIDE + np.diag(Q.FLOOR ** 2))
    out = {o.doc_id: o for o in Q.op7(docs_of(rows)).collect()}
    assert np.allclose([out[i].distance for i, _ in rows], final, rtol=1e-6)
    assert all(out[i].kept for i in range(260)) and not any(out[i].kept for i in range(260, 470))


def test_constants():
    """Consistency factors, from draws of the chi-squared laws."""
    g = np.random.default_rng(5)
    c7, c9 = g.chisquare(7, 2_000_000), g.chisquare(9, 2_000_000)
    assert abs(0.5 / (c9 <= np.median(c7)).mean() - Q.C_HALF) < 0.01
    assert abs(np.quantile(c7, 0.975) - Q.INSIDE) < 0.05
    assert abs(0.975 / (c9 <= Q.INSIDE).mean() - Q.C_INSIDE) < 0.002


def test_repeated_lines_alone_reject(docs_of):
    """Repeated lines without three-word windows pass the base rule and are rejected."""
    r = random.Random(8)
    rows = list(enumerate(ordinary(r, 300)))
    for k in range(6):
        lines = [f"be{i}" for i in range(8)]
        seen = set(zip(lines, lines[1:], lines[2:]))
        while len(lines) < 52:      # one-word lines in an order without a repeated window
            word = f"be{r.randrange(8)}"
            if (*lines[-2:], word) not in seen:
                seen.add((*lines[-2:], word))
                lines.append(word)
        rows.append((1000 + k, "\n".join([*lines, *(" ".join(f"alpha{100 * k + 20 * j + i}" for i in range(14)) for j in range(5))])))
    out = {o.doc_id: o for o in Q.op7(docs_of(rows)).collect()}
    planted = [out[1000 + k] for k in range(6)]
    assert all((o.n_dup_lines, o.base_failed, o.kept) == (44, False, False) for o in planted), planted
    assert all(out[i].kept for i in range(300))


def test_order_partitions_and_buckets_do_not_matter(spark, docs_of):
    r = random.Random(4)
    rows = list(enumerate(ordinary(r, 220) + ordinary(r, 40) * 2))
    one = {o.doc_id: o.distance for o in Q.op7(docs_of(rows).coalesce(1)).collect()}
    r.shuffle(rows)
    assert {o.doc_id: o.distance for o in Q.op7(docs_of(rows).repartition(7)).collect()} == one


def test_edge_rows(docs_of):
    long_ = "word " * 300_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long_, None, None), (None, "a b c"), (5, "x y z x y z", None, "s"), (5, "x y z x y z", None, "s")]
    out = Q.op7(docs_of(rows)).collect()
    assert sorted((r.doc_id or 0, *counts(r)) for r in out) == sorted((d[0] or 0, *brute(d[1])) for d in rows)
    assert not any(r.kept for r in out)
    assert Q.op7(docs_of(rows).limit(0)).collect() == []


def test_small_pool_is_not_judged(docs_of):
    t = " ".join(f"w{i}" for i in range(80))
    out = Q.op7(docs_of([(1, t, "xx", "a"), (2, t + " ### $$$", None, None)])).collect()
    assert all(r.kept and r.distance is None for r in out)
