"""Block reading, the recurrent labeller's gradients, held-out layouts, whole pages."""

import html
import re

import numpy as np
import pytest

from jobsight.llm import html_text as H

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(small):
    return H.fit(H.sample_words(small("pages")))


def test_blocks_of_messy_markup():
    page = ("<!DOCTYPE html><title>T</title><script>var a='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> -->"
            "<div class='Main-Content' id=c1>lead <b>bold<br>text<p>one &amp; two&nbsp;three &lt;4<p>five <a href=/x>six</a>"
            "<ul><li>a<li>b</ul> tail<p title='a>b'>end &copy &unknown; <")
    got = [(b.text, b.link_chars) for b in H.blocks(page)]
    assert got == [("lead bold text", 0), ("one & two three <4", 0), ("five six", 3), ("a", 0), ("b", 0), ("tail", 0), ("end © &unknown; <", 0)]
    assert H._token_id(".main") in H.blocks(page)[0].path and H._token_id("div") in H.blocks(page)[0].path
    assert H.blocks("") == [] and [b.text for b in H.blocks("plain  text")] == ["plain text"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = H.Labeller()
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    x = rng.random((4, 2, H.INPUT))
    y = rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0.0]])
    g, _ = m.gradients(x, y, mask)
    for key, at in (("xf", (3, 5)), ("hb", (1, 7)), ("cf", (30,)), ("o", (4, 0)), ("ob", (0,)), ("hf", (2, 60))):
        eps, keep = 1e-4, m.p[key][at]
        m.p[key][at] = keep + eps
        up = m.gradients(x, y, mask)[1]
        m.p[key][at] = keep - eps
        low = m.gradients(x, y, mask)[1]
        m.p[key][at] = keep
        assert abs((up - low) / (2 * eps) - g[key][at]) < 2e-3


def test_held_out_layouts(model, small):
    r = np.random.default_rng(77)
    pages = [H.blocks(H.generated_page(H.sample_words(small("pages")), r)) for _ in range(150)]
    got = np.concatenate(model.keep(pages))
    want = np.concatenate([[b.label for b in p] for p in pages]).astype(bool)
    assert (got == want).mean() > 0.98


def test_whole_table_query(spark, small):
    """The pages' articles, read here by their template."""
    from jobsight.llm.queries import op9_html_text
    out = {r.page_id: r for r in op9_html_text(spark, "/root/testdata/sf0.001").collect()}
    rows = small("pages").collect()
    assert len(out) == len(rows)
    for r in rows:
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())
                 for x in re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", r.html, re.S)[1])]
        assert out[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert (out[r.page_id].url, out[r.page_id].n_chars) == (r.url, len(out[r.page_id].text))


def test_other_templates(spark, model):
    body = "<h1>A headline of some length here</h1>" + "".join(f"<p>Paragraph {i} has enough words to look like prose, and it ends.</p>" for i in range(5))
    wraps = {1: f"<header>Site</header><nav><a href=/>Home</a></nav><main>{body}</main><aside><p>Related things you may like</p></aside><footer>© us</footer>",
             2: f"<div class=menu><a href=/a>News</a> <a href=/b>Sport</a></div><div class=content>{body}</div><div id=comments><p>bob says:</p><p>I do not agree with this at all, sorry.</p></div><div class=footer>Terms</div>",
             3: f"<div class='cookie notice'>We use cookies.</div><article>{body}<div class=ad>Buy now</div></article><form><label>Email</label><button>Subscribe</button></form>"}
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(k, None, f"<html><body>{v}</body></html>") for k, v in wraps.items()], PAGES), model).collect()}
    want = "\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</", body))
    assert all(t == want for t in out.values()), out


def test_closed_in_themselves():
    page = "<p>One</p><svg class='i'/><p>Two</p><iframe src='a/b' /><p>Three</p><svg><text>no</text></svg><iframe>no</iframe><p>Four</p>"
    assert [b.text for b in H.blocks(page)] == ["One", "Two", "Three", "Four"]


PROSE = [f"Paragraph {i} has enough words to look like prose, and it ends." for i in range(6)]


@pytest.mark.parametrize("page, dropped", [
    ("<div class='css-1'><div class='css-9'><a href=/a>News</a> <a href=/b>Sport</a></div><div class='css-77'><h1>A headline of some length</h1>"
     + "".join(f"<div class='css-77'><p>{x}</p></div>" for x in PROSE) + "</div><div class='css-3'>© 2024 Some Company. All rights reserved</div></div>",
     ["News Sport", "© 2024 Some Company. All rights reserved"]),
    ("<div><div><div>" + "".join(f"<p>{x}</p>" for x in PROSE) + "</div></div></div>", []),
    ("<article>" + "".join(f"<p>{x}</p>" for x in PROSE) + "<pre>x = run(y) print(x)</pre><figure><img src=a><figcaption>A picture of a house</figcaption></figure>"
     f"<p>{PROSE[0]}</p></article>", []),
    ("<header>Site</header><article>" + "".join(f"<p>{x}</p>" for x in PROSE) + "</article><p>© 2024 Company name</p>", ["Site", "© 2024 Company name"]),
])
def test_layouts_without_telling_names(model, page, dropped):
    read = H.blocks(f"<html><body>{page}</body></html>")
    assert [b.text for b, ok in zip(read, model.keep([read])[0]) if not ok] == dropped


def test_network_step_by_step(model, small):
    """The labels of whole pages, recomputed block by block with no batches, masks or slices."""
    sig = lambda a: 1 / (1 + np.exp(-a))

    def states(x, d):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), []
        for v in x if d == "f" else x[::-1]:
            i, f, o, g = np.split(v @ model.p[f"x{d}"] + model.p[f"c{d}"] + h @ model.p[f"h{d}"], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        return np.array(out if d == "f" else out[::-1])

    pages = [H.blocks(r.html) for r in small("pages").collect()] + [H.blocks("<article>" + "<p>some words here.</p>" * 5000 + "</article>")]
    for page, kept in zip(pages, model.keep(pages)):
        x = H.vectors(page).astype(np.float64)
        s = sig(np.concatenate([states(x, "f"), states(x, "b")], axis=1) @ model.p["o"] + model.p["ob"])[:, 0]
        sure = abs(s - 0.5) > 1e-3
        assert (kept == (s > 0.5))[sure].all() and sure.mean() > 0.99


def test_edge_rows(spark, model):
    long_ = "<article>" + "<p>some words in a paragraph.</p>" * 6000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<article><p>The same text, twice over.</article>"),
            (3, "u", "<article><p>The same text, twice over.</article>"), (4, "u", long_), (5, "u", "<" * 3000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text", "2 as n_chars", "3 as _html")
    out = sorted(((r.page_id or 0, r.n_chars, r.text) for r in H.extract(df, model).collect()), key=lambda r: r[:2])
    assert [r[0] for r in out] == [0, 1, 2, 3, 3, 4, 5]
    assert out[0][1] == out[1][1] == out[2][1] == 0 and out[3] == out[4]
    assert out[5][2].count("some words") == 6000
    assert all(r[1] == len(r[2]) for r in out)


def test_empty_table(spark):
    assert H.op9(spark.createDataFrame([], PAGES)).collect() == []
