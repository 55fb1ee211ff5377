"""Base spans against the plain patterns; bootstrapped spans; masking; native plans."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from jobsight.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, out):
    want = sorted((d or 0, *[sum(k == kind for k, _, _ in brute(t)) for kind in P.KINDS],
                   hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want


TRICKY = [
    "", None, "a@b.c", "x a@b.c_d@e.f.g- a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567. +12 +1234567890123456 +49.30.123456)", "é漢\U0001f600 a.b%c+d-e@x-y.co.uk 10.0.0.1 4111111111111111",
    "@@ a@ @b.c .@a.b a@.b a@b..c", "12345678901234567890 0000000000000000", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5",
    "1" * 30_000, "a" * 30_000 + "@", "a." * 5_000 + "@x.y", "9 " * 9_000, "+1" * 3_000, "1.2.3.4 " * 500,
]


def test_tricky_texts(docs_of):
    rows = list(enumerate(TRICKY, 1)) + [(None, "me@x.org"), (2, "me@x.org"), (2, "me@x.org")]
    check(rows, P.op10(docs_of(rows)).collect())


def test_whole_table_query(spark, small):
    from jobsight.llm.queries import op10_pii
    out = op10_pii(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    check(rows, out)
    for r in out:
        mine = {f"{k}:{a}:{b}" for k, a, b in brute(dict(rows)[r.doc_id])}
        assert mine <= {x for x in r.spans.split(",") if x}


def boot_rows():
    rows = [(i, f"note {i} mail contact: user{i}@site{i}.org today") for i in range(6)]
    rows += [(10 + i, f"row {i} phone no. +1 (555) 010-{1000 + i} is here") for i in range(5)]
    rows += [(20, "again contact: admin@localhost today"), (21, "plain number 555-010-7777 of parts"),
             (22, "the phone no. 555 010 8888 rings"), (23, "order of 4111 1111 1111 1112 bolts"), (24, "of 300.1.2.3 the")]
    return rows


def test_bootstrapping_finds_by_context(docs_of):
    rows = boot_rows()
    out = {r.doc_id: r for r in P.op10(docs_of(rows)).collect()}
    check(rows, out.values())
    found = {d: {rows_t[int(s.split(":")[1]):int(s.split(":")[2])] for s in out[d].spans.split(",") if s}
             for d, rows_t in rows}
    assert found[20] == {"admin@localhost"} and found[22] == {"555 010 8888"}
    assert not found[21] and not found[23] and not found[24]


def brute_scores(rows):
    """One bootstrapping step by plain counting: pattern -> confidence for emails."""
    import collections
    hits, support, places = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for _, t in rows:
        w = t.lower().split()
        for i, x in enumerate(w):
            places[x] += 1
            if i:
                places[f"{w[i - 1]} {x}"] += 1
        for k, a, b in brute(t):
            if k == "email":
                left = t[:a].lower().split()
                for p in (left[-1:], left[-2:]):
                    hits[" ".join(p)] += 1
                    support[" ".join(p)].add(t[a:b])
    return {p: hits[p] / places[p] for p in hits if len(support[p]) >= P.SUPPORT}


def test_confidences_by_counting():
    conf = brute_scores(boot_rows())
    assert conf["contact:"] == 6 / 7 and conf["mail contact:"] == 1.0     # above CONFIDENCE and ACCEPT


def test_places_of_a_pattern_are_counted_in_all_documents(docs_of, monkeypatch):
    """A frequent word promotes nothing, though most of its places have no digits around."""
    calls = [(i, f"n{i}x ref +1 (555) 010-{1000 + i}") for i in range(5)] + [(9, "nx ref 555 010 8888")]
    plain = [(20 + i, f"see the ref again, the p{'x' * i} ref too") for i in range(20)]
    spans = lambda rows: next(r.spans for r in P.op10(docs_of(rows)).collect() if r.doc_id == 9)
    assert spans(calls) == "phone:7:19" and spans(calls + plain) == ""
    assert {r.doc_id: r.text for r in P.mask(docs_of(calls + plain)).collect()}[9] == calls[-1][1]
    monkeypatch.setattr(P, "SMALL", 0)
    assert spans(calls) == "phone:7:19" and spans(calls + plain) == ""


def test_rounds_go_on_until_nothing_is_found(docs_of):
    """Each round's values carry the pattern of the next; running out of rounds raises."""
    depth, rows = 7, []
    def say(pattern, value):
        rows.append((len(rows), f"t{len(rows)}x {pattern} {value} end"))
    for i in range(6):
        say("p0:", f"user{i}@site{i}.org")
    for k in range(depth):
        for i in range(3):
            say(f"p{k}:", f"v{k}n{i}@host")
            say(f"p{k + 1}:", f"v{k}n{i}@host")
            say(f"p{k + 1}:", f"v{k}n{i}@host")
    out = {r.doc_id: r.spans for r in P.op10(docs_of(rows)).collect()}
    assert all(out[d] for d, _ in rows)
    with pytest.raises(RuntimeError, match="settle"):
        P.find(docs_of(rows), rounds=4)


def test_masking(docs_of):
    rows = boot_rows() + [(30, "card 4111 1111 1111 1111, ip 10.0.0.1 é"), (31, None), (32, "plain"), (None, "x@y.z"), (30, "a@b.cc a@b.cc")]
    df = docs_of(rows)
    out = P.mask(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in out.collect())
    by = {}
    for d, t, n in got:
        by.setdefault(d, []).append(t)
        assert n is None or n == len(t)
    assert len(got) == len(rows)
    assert by[30] == ["[EMAIL] [EMAIL]", "card [CARD], ip [IP] é"] and by[0][0] == "[EMAIL]"
    assert by[20] == ["again contact: [EMAIL] today"] and by[21] == ["plain number 555-010-7777 of parts"]


def test_no_python_in_the_plan(docs_of):
    plan = P.op10(docs_of(boot_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(docs_of):
    none = docs_of([(1, "a@b.c")]).limit(0)
    assert P.op10(none).collect() == [] and P.mask(none).collect() == []
    only = P.op10(docs_of([(1, "nothing here")])).first()
    assert only.spans == "" and only.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_kept_columns_of_rich_rows(docs_of):
    df = docs_of([(1, "call +1 555 123 4567 now")]).withColumn("base", F.lit("b")).withColumn("found", F.lit("f"))
    assert P.mask(df).first().text == "call [PHONE] now"
