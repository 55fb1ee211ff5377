"""The pipeline against a chain of brute-force stages."""

import corpus_pipeline as C
from jobsight.llm import language, pii, simhash
from test_decontaminate import brute as leaks
from test_packing import check as check_packing
from test_packing import encode  # noqa: F401
from test_simhash import brute_classes, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in C.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]


def test_run_equals_brute_force(spark, small, encode):  # noqa: F811
    docs = small("documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = language.fit(docs)
    rows = [(d, t) for d, t in rows if model.predict(t)[2]]
    low = brute_classes([d for d, _ in rows], [brute_fp(t, simhash.SHINGLE) for _, t in rows])
    rows = [(d, t) for (d, t), c in zip(rows, low) if d == c]
    items = [(x.item_id, x.text) for x in small("benchmark").collect()]
    rows = [(d, t) for d, t in rows if not leaks(items, t)]
    from test_pii import brute as spans
    masked = []
    for d, t in rows:
        out, at = "", 0
        for k, a, b in sorted(spans(t), key=lambda s: s[1:]):
            if a >= at:
                out += t[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        masked.append((d, out + t[at:]))
    out = C.run(spark, SF).collect()
    assert check_packing(masked, out, encode) > 0.95


def test_stages_keep_columns_and_survive_odd_rows(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (3, "the and of a plain text"), (3, "the and of a plain text"), (None, "the and of me@x.org"),
                   (4, "x" * 50_000, None, None)])
    for name, stage in C.STAGES:
        got = stage(spark, odd, SF)
        assert name == "packing" or got.columns == odd.columns
        got.collect()
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_entry_lists_the_queries():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert pii.KINDS == ("email", "ip", "card", "phone")
