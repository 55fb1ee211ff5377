"""Language identification: held-out accuracy, rejection, edge rows."""

import base64
import random
import zlib

from jobsight.llm import language as L


def test_held_out_accuracy_and_scores(spark, small):
    from jobsight.llm.queries import op3_language
    lang = {r.doc_id: r.lang for r in small("documents").select("doc_id", "lang").collect()}
    out = op3_language(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in out) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.accepted for r in out) == len(out)      # ordinary documents all stay


def test_edge_rows(small, docs_of):
    model = L.fit(small("documents"))
    rows = [(1, None), (2, ""), (3, "12 345 !!"), (4, "the and of this"), (None, "the thing and that"), (5, "漢字漢字漢字漢字" * 40),
            (6, "the thing and that " * 80_000), (4, "the and of this")]
    got = {(r.doc_id, r.lang_pred, r.accepted) for r in L.identify(docs_of(rows), model).collect()}
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, "und", False), (2, "und", False), (3, "und", False)}
    assert next(g for g in got if g[0] == 5)[2] is False         # far from every centroid
    assert next(g for g in got if g[0] == 6)[1] == "en"
    kept = L.keep_known(docs_of(rows), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 6]
    assert kept.columns == docs_of(rows).columns


POLISH = """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni
rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i
wolności zawarte w niniejszej Deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka, wyznania."""
FINNISH = """Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki
ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä
julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen perustuvaa erotusta."""


def test_other_latin_texts_go_and_labelled_rows_stay(spark, docs_of):
    from jobsight.llm.common import table
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = L.fit(docs)
    r = random.Random(5)
    junk = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) for _ in range(n)) for n in (20, 100, 400, 4000)]
    junk += [base64.b64encode(r.randbytes(n)).decode() for n in (120, 600, 3000, 30_000)]
    junk += [POLISH, FINNISH, POLISH * 20, FINNISH * 20]
    got = {x.doc_id: x.accepted for x in L.identify(docs_of(list(enumerate(junk))), model).collect()}
    assert not [junk[i][:40] for i, ok in got.items() if ok]
    assert L.keep_known(docs_of([(i, t) for i, t in enumerate(junk)]), model).count() == 0
    assert L.identify(docs, model).where("not accepted").collect() == []


def test_lang_source_and_id_do_not_matter(small, docs_of):
    model = L.fit(small("documents"))
    a = L.identify(docs_of([(1, "ist die und der", "en", "a")]), model).first()
    b = L.identify(docs_of([(77, "ist die und der", None, None)]), model).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score) and a.lang_pred == "de"


def test_counts_in_pieces(monkeypatch):
    t = "Abc déf, ghi! " * 50
    whole = L.gram_counts(t)
    monkeypatch.setattr(L, "PIECE", 37)
    assert (L.gram_counts(t) == whole).all()


def test_sample_is_bounded_in_rows(docs_of):
    """A doc_id with very many rows neither fills the sample nor pushes others out."""
    from jobsight.llm.common import few_rows
    rows = [(7, f"text {i}") for i in range(3000)] + [(7, "text 1")] * 500 + [(i, f"own {i}") for i in range(20, 40)]
    for group in (["lang"], []):
        got = [(r.doc_id, r.text) for r in few_rows(docs_of(rows).select("doc_id", "text", "lang"), group, 30).collect()]
        assert len(got) == len(set(got)) == 30 and set(got) <= set(rows)
        assert {d for d, _ in got} == {7, *range(20, 40)}


def test_rows_sent_to_the_driver_are_bounded(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "_kmeans", lambda x, k, kmeans=L._kmeans: seen.append(len(x)) or kmeans(x, k))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    L.fit(docs_of([(ids[0], f"the text of {'a' * i}") for i in range(1, 400)] + [(i, f"another {'b' * i}") for i in ids]), sample=20)
    assert seen == [20]


def test_no_training_rows(docs_of):
    none = docs_of([(1, "a b c", "en")]).limit(0)
    assert L.op3(none).collect() == []
    alone = L.op3(docs_of([(1, "a b c", None)])).first()
    assert (alone.lang_pred, alone.score, alone.accepted) == ("und", 0.0, False)
