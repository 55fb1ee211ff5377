"""Decontamination against a brute-force search of every neighbourhood."""

import random
import re

from jobsight.llm import decontaminate as D


def strip(text):
    return re.findall(b"[^" + re.escape(D._SEPARATORS) + b"]+", (text or "").encode().lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = prev + 1 if x == y else max(row[j + 1], row[j])
            prev = keep
    return row[-1]


def brute(items, text):
    """Items that some stretch of the text covers (plain dynamic programming)."""
    words, out = strip(text), []
    for item_id, item in items:
        own = strip(item)
        n, k = len(own), max(1, round(len(own) * D.ANSWER_PART))
        for at in range(0, max(1, len(words)), D.STEP):
            region = words[max(0, at - n):at + D.WINDOW + n]
            if sum(w in region for w in own) < D.COVER * n:
                continue                 # no subsequence is longer than what is there
            if own and lcs(own, region) >= D.COVER * n and lcs(own[-k:], region) >= D.ANSWER_COVER * k:
                out.append(item_id)
                break
    return out


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randrange(1, 12))]
        b = [r.choice("abcd") for _ in range(r.randrange(0, 15))]
        assert D.common_subsequence(a, b) == lcs(a, b)


def test_words_and_ids(monkeypatch):
    r = random.Random(9)
    text = "".join(r.choices("abcÉé ,.\n-|", k=4000)).encode() + b"x" * 300
    assert D.words_of(text) == strip(text.decode())
    ids = D.word_ids(text.lower())[2].tolist()
    by: dict = {}
    assert all(by.setdefault(w, i) == i for w, i in zip(D.words_of(text), ids))
    monkeypatch.setattr(D, "PIECE", 64)
    assert D.words_of(text) == strip(text.decode()) and D.word_ids(text.lower())[2].tolist() == ids
    assert D.words_of(b"") == D.words_of(b" .,") == []


def test_planted_passages_and_paraphrases(small, docs_of, spark):
    """Recall against brute force over verbatim, edited and partial items: at least 0.9."""
    r = random.Random(2)
    docs = small("documents")
    items = [(x.item_id, x.text) for x in small("benchmark").collect()]
    pool = [w for d in docs.limit(40).collect() for w in d.text.split()]
    rows, say = [], lambda n: [r.choice(pool) for _ in range(n)]
    for i, (_, text) in enumerate(items):
        w = text.split()
        edited = [r.choice(pool) if r.random() < 0.2 else x for x in w]
        for body in (w, edited, w[:len(w) // 2], [], [x.upper() + "," for x in w]):
            rows.append((len(rows), " ".join(say(r.randrange(0, 60)) + body + say(r.randrange(0, 200)))))
    weight = D.fit(docs, small("benchmark"))
    (index,) = D.blocks(small("benchmark"), weight)
    got = [[index.items[k].item_id for k in index.hits(t.encode())] for _, t in rows]
    want = [brute(items, t) for _, t in rows]
    assert sum(map(len, want)) > 2 * len(items)
    assert all(set(g) <= set(w) for g, w in zip(got, want))
    assert sum(map(len, got)) >= 0.97 * sum(map(len, want))
    verbatim = range(0, len(rows), 5)
    assert all(items[i // 5][0] in got[i] for i in verbatim)
    assert not any(got[i] for i in range(3, len(rows), 5))


def test_recall_does_not_fall_as_the_benchmark_grows(spark):
    """2000 items, 200 of them real: recall by item length and edit rate."""
    from jobsight.llm.common import table
    r = random.Random(3)
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    pool = [w for d in docs.orderBy("doc_id").limit(2000).collect() if len(w := d.text.split()) > 120]
    noise = [x for w in pool[:200] for x in w]

    def passage():
        n, w = r.choice([r.randrange(16, 24), r.randrange(24, 48), r.randrange(48, 90)]), r.choice(pool)
        at = r.randrange(0, len(w) - n)
        return " ".join(w[at:at + n])

    items = [(x.item_id, x.text) for x in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    items += [(10 ** 6 + i, passage()) for i in range(1800)]
    rows, plan = [], []
    for item_id, text in r.sample(items, 300):
        w = text.split()
        for rate in (0, 0.1, 0.2, 0.25):
            body = [r.choice(noise) if r.random() < rate else x for x in w]
            text_ = " ".join(r.choices(noise, k=r.randrange(60)) + body + r.choices(noise, k=r.randrange(20, 90)))
            if item_id in brute([(item_id, text)], text_):
                plan.append((len(rows), item_id, len(w) < 24, rate))
                rows.append((len(rows), text_))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    planted = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    parts = D._split(D._items(bench), 13_000, D.BLOCK)
    assert len(parts) > 4
    background = D._background(docs)
    found = {i: set() for i, _ in rows}
    for i in range(0, len(parts), D.TOGETHER):
        indexes = [D._index(own, D.fit(docs, own, background=background)) for own in parts[i:i + D.TOGETHER]]
        for x in D._flag(planted, indexes, "leaked").collect():
            found[x.doc_id] |= set(x.leaked)
    for short in (True, False):
        for rate in (0, 0.1, 0.2, 0.25):
            got = [item in found[d] for d, item, s, q in plan if (s, q) == (short, rate)]
            print("short" if short else "long", rate, len(got), sum(got) / len(got))
            assert len(got) > 30 and sum(got) >= (1.0 if not rate else 0.95) * len(got)


def test_whole_table_query(spark, small):
    from jobsight.llm.queries import op5_decontaminate
    items = [(x.item_id, x.text) for x in small("benchmark").collect()]
    out = {r.doc_id: r for r in op5_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    docs = small("documents").collect()
    assert len(out) == len(docs)
    want = {d.doc_id: brute(items, d.text) for d in docs if len(d.text) < 6000}
    assert {k: out[k].leaked_items for k in want} == want
    assert all(r.contaminated == bool(r.leaked_items) for r in out.values())


def test_blocks_of_items_give_the_same(small, docs_of, spark, monkeypatch):
    items = [(x.item_id, x.text) for x in small("benchmark").limit(6).collect()]
    docs = docs_of([(1, "a b " + items[0][1]), (2, items[1][1] + " " + items[5][1]), (3, None), (4, ""), (3, None), (None, items[2][1])])
    bench = spark.createDataFrame(items + [(99, None), (98, "  ")], "item_id long, text string")
    whole = sorted((r.doc_id or 0, r.leaked_items) for r in D.op5(docs, bench).collect())
    assert whole == [(0, [items[2][0]]), (1, [items[0][0]]), (2, sorted([items[1][0], items[5][0]])), (3, []), (3, []), (4, [])]
    weight = D.fit(docs, bench)
    parts = D.blocks(bench, weight, size=2)
    assert len(parts) > 1
    found = sorted({(d, i.item_id) for ix in parts for d, t in [(1, "a b " + items[0][1])] for k in ix.hits(t.encode()) for i in [ix.items[k]]})
    assert found == [(1, items[0][0])]
    kept = D.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3, 4] and kept.columns == docs.columns


def test_empty_tables(small, docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.op5(docs_of([(1, "a b c")]), none).collect()] == [False]
    assert D.op5(docs_of([(1, "a")]).limit(0), small("benchmark")).collect() == []


def test_basis_is_fitted_on_the_passages_of_all_documents(docs_of, spark, monkeypatch):
    import numpy as np
    r = random.Random(5)
    texts = [" ".join(f"w{int(r.paretovariate(0.4)) % 3000}" for _ in range(r.choice([1, 5, 15, 16, 17, 40, 100]))) for _ in range(900)]
    texts += [texts[0]] * 40 + [None, "", " . "]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    rows = []
    for t in texts:
        found = D.word_ids((t or "").encode())[2]
        rows += [found[i:i + D.WINDOW] for i in D._starts(len(found), D.WINDOW)] if len(found) else []
    monkeypatch.setattr(D, "CHUNK", 700)
    monkeypatch.setattr(D, "BACKGROUND", 1000)
    background = D._background(docs_of(list(zip(ids, texts))))
    assert background.passages == len(rows) > 2000
    a = np.zeros((len(rows), D.DIM))
    for x, own in zip(a, rows):
        v = background.idf[own]
        np.add.at(x, own, v / np.sqrt((v * v).sum()))
    g = np.random.default_rng(1).standard_normal((D.DIM, 3)).astype(np.float32)
    none = spark.createDataFrame([], "ids binary, weight double")
    got = D._gram_times(none, background, g)
    assert np.allclose(got, a.T @ (a @ g) * 1000 / len(rows), atol=1e-3)
