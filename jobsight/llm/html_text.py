"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks (runs of text between block-level tags), each with its tag
path and text. A block becomes a vector of hashed path tokens (tags, class and id words),
hashed words and a few shape numbers; a bidirectional LSTM in numpy reads the whole
sequence of a page and labels every block as article text or not. Kept blocks are joined.

The labeller is trained when a query is built, on ``TRAIN_PAGES`` generated pages: layouts
are drawn from ``ROLES``, the words are at most ``WORDS`` from ``WORD_PAGES`` of the table's
pages (smallest hashes). Its size does not depend on the data.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest_hashes

PATH_DIM, WORD_DIM, SHAPES = 256, 64, 8
INPUT = PATH_DIM + WORD_DIM + SHAPES
HIDDEN = 20
TRAIN_PAGES = 2_400
WORDS = 4_000
WORD_PAGES = 60
EPOCHS = 8
BATCH = 16
DEPTH = 12           # innermost path elements that give tokens
STEP_BLOCKS = 4096   # blocks turned into vectors at a time

# Elements that end a block; all others (a, b, span, ...) run inside one.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the key closes open elements of these kinds, up to an enclosing container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": {"html"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|iframe)\b[^>]*+(?<=/)>"       # closed in itself: no content follows
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Element:
    name: str
    tokens: list[int]
    label: int | None


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    link_chars: int
    label: int | None


def _token_id(s: str) -> int:
    return zlib.crc32(s.encode()) % PATH_DIM


def _element(name: str, attrs: str) -> Element:
    tokens, label = [_token_id(name)], None
    for key, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if key.lower() == "data-y":
            label = int(value)
        else:
            tokens += [_token_id("." + w) for w in _WORD.findall(value.lower())[:8]]
    return Element(name, tokens, label)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; comments, scripts, styles and titles are no text."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links = 0
    depth_a = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(t for e in stack[-DEPTH:] for t in e.tokens)
                label = next((e.label for e in reversed(stack) if e.label is not None), None)
                out.append(Block(text, path, links, label))
            parts.clear()
        links = 0

    def text(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if depth_a:
                links += len(piece.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            depth_a = 0 if m["end"] else 1
            continue
        if name not in BLOCK:
            if name in VOID:
                parts.append(" ")
            continue
        flush()
        depth_a = 0
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in HOLDS[name]:
                    break
                if stack[i].name in CLOSES[name]:
                    del stack[i:]
                    break
        if stack and stack[-1].name == "p":
            stack.pop()
        stack.append(_element(name, m["attrs"]))
    text(page[at:])
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block; all rows of ``page`` belong to one page or a slice of it."""
    x = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        np.add.at(x[i], list(b.path), 1.0)
        words = b.text.lower().split()
        ids = [zlib.crc32(w.encode()) % WORD_DIM for w in words]
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(ids, minlength=WORD_DIM) / max(1, len(ids)) * 2
        n = len(b.text)
        x[i, -SHAPES:] = (np.log1p(n) / 6, min(1.0, b.link_chars / n), b.text[-1] in ".!?:;\"'", len(words) / 20 if len(words) < 20 else 1.0,
                          sum(b.text.count(c) for c in ".,;") / (len(words) + 1), b.text[0].isupper(),
                          b.text.count("©"), 1.0)
    x[:, :PATH_DIM] = np.minimum(x[:, :PATH_DIM], 2.0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output; plain numpy, both passes."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (r.standard_normal((INPUT, 4 * HIDDEN)) * 0.08).astype(np.float32)
            self.p[f"h{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = (r.standard_normal((2 * HIDDEN, 1)) * 0.2).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _scan(self, z: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states for projected inputs ``z`` (steps x pages x 4H), in scan order."""
        steps, pages, _ = z.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        saved = []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            a = z[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(a[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep:
                saved.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[t] = h
        return out, saved

    def project(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p[f"x{d}"] + self.p[f"c{d}"]

    def scores(self, z: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._scan(z[d], mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(h @ self.p["o"] + self.p["ob"])[:, :, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[dict, float]:
        hs, kept = {}, {}
        for d in "fb":
            hs[d], kept[d] = self._scan(self.project(x, d), mask, d, True)
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        s = _sigmoid(h @ self.p["o"] + self.p["ob"])[:, :, 0]
        n = mask.sum()
        loss = float(-(mask * (y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7))).sum() / n)
        ds = ((s - y) * mask / n)[:, :, None].astype(np.float32)
        g = {"o": np.einsum("tph,tpk->hk", h, ds), "ob": ds.sum(axis=(0, 1))}
        dh_out = ds @ self.p["o"].T
        for k, d in enumerate("fb"):
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh_next = np.zeros((mask.shape[1], HIDDEN), np.float32)
            dc_next = np.zeros_like(dh_next)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t, i, f, o, gg, c, tc, hp, m in reversed(kept[d]):
                dh = (dh_out[t][:, k * HIDDEN:(k + 1) * HIDDEN] + dh_next) * m
                dc = (dh * o * (1 - tc * tc) + dc_next) * m
                da = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o),
                                     dc * i * (1 - gg * gg)], axis=1)
                dz[t] = da
                gh += hp.T @ da
                dh_next, dc_next = da @ self.p[f"h{d}"].T, dc * f
            g[f"h{d}"] = gh
            g[f"c{d}"] = dz.sum(axis=(0, 1))
            g[f"x{d}"] = x.reshape(-1, INPUT).T @ dz.reshape(-1, 4 * HIDDEN)
        return g, loss

    def train(self, pages: list[list[Block]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> float:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        data = sorted(((vectors(p), np.array([b.label or 0 for b in p], np.float32)) for p in pages if p), key=lambda v: len(v[1]))
        groups = [data[i:i + BATCH] for i in range(0, len(data), BATCH)]
        step, loss = 0, 0.0
        for _ in range(epochs):
            for j in r.permutation(len(groups)):
                x, y, mask = _padded(groups[j])
                g, loss = self.gradients(x, y, mask)
                step += 1
                now = rate * (1 - 0.9 * step / (epochs * len(groups)))
                for k in self.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * g[k] * g[k]
                    self.p[k] = (self.p[k] - now * (m1[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return loss

    def keep(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are article text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            if not pages[order[at]]:
                at += 1
                continue
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= STEP_BLOCKS:
                end += 1
            group = order[at:end]
            steps = len(pages[group[-1]])
            z = {d: np.zeros((steps, len(group), 4 * HIDDEN), np.float32) for d in "fb"}
            mask = np.zeros((steps, len(group)), np.float32)
            for k, i in enumerate(group):
                for lo in range(0, len(pages[i]), STEP_BLOCKS):
                    part = pages[i][lo:lo + STEP_BLOCKS]
                    x = vectors(part)
                    for d in "fb":
                        z[d][lo:lo + len(part), k] = self.project(x, d)
                mask[:len(pages[i]), k] = 1
            s = self.scores(z, mask)
            for k, i in enumerate(group):
                out[i] = s[:len(pages[i]), k] > 0.5
            at = end
        return out


def _padded(group):
    steps = max(len(y) for _, y in group)
    x = np.zeros((steps, len(group), INPUT), np.float32)
    y = np.zeros((steps, len(group)), np.float32)
    mask = np.zeros((steps, len(group)), np.float32)
    for k, (a, b) in enumerate(group):
        x[:len(b), k], y[:len(b), k], mask[:len(b), k] = a, b, 1
    return x, y, mask


# Layout vocabulary of the generated training pages: element names, class words and phrases
# that pages use for each part. Fixed values, chosen here.
ROLES = {
    "menu": (["nav", "div", "ul"], "nav menu navbar navigation breadcrumb topmenu mainmenu links", ["Home", "About", "Contact", "Menu"]),
    "header": (["header", "div"], "header masthead topbar banner branding logo siteheader", ["Welcome", "Search", "Log in"]),
    "footer": (["footer", "div"], "footer copyright legal bottom siteinfo colophon", ["© 2024", "All rights reserved", "Privacy policy", "Terms"]),
    "sidebar": (["aside", "div", "section"], "sidebar widget related recommended trending popular archive tags", ["Related", "Most read", "More"]),
    "notice": (["div", "section", "dialog"], "cookie consent notice alert gdpr popup modal newsletter subscribe message", ["We use cookies.", "Subscribe to our newsletter", "Accept"]),
    "advert": (["div", "section", "aside"], "ad ads advert advertisement sponsored promo adbox sponsor", ["Advertisement", "Sponsored", "Buy now"]),
    "form": (["form", "div"], "form search login signup contactform field", ["Name", "Email", "Submit", "Search"]),
    "comments": (["section", "div", "ol"], "comments comment discussion replies responses disqus commentlist thread", ["Reply", "Comments", "says:"]),
    "share": (["div", "ul"], "share social sharing follow buttons", ["Share", "Tweet", "Like"]),
}
ARTICLE = (["article", "main", "div", "section", "td"], "article content post entry story body text main page single")
NEUTRAL = "wrap box col row inner outer block unit grid panel left right".split()


def generated_page(words: list[str], r: np.random.Generator) -> str:
    """A page with ``data-y`` marks: 1 on the article, 0 on everything else. On an eighth of
    the pages no name tells a part: elements are neutral, classes too or made up, and only the
    kinds of parts appear that their text, links and place give away."""
    plain = r.random() < 0.125

    def pick(seq):
        return seq[int(r.integers(len(seq)))]

    def say(lo: int, hi: int) -> str:
        n = int(r.integers(lo, hi + 1))
        out = [pick(words) for _ in range(n)]
        return html.escape(" ".join(out).capitalize() + ("." if r.random() < 0.85 else ""))

    def attrs(names: str, bare: float = 0.25) -> str:
        if plain or r.random() < bare:
            u = r.random()
            if u < 0.5:
                return ""
            made_up = f"css-{int(r.integers(1000))}" if r.random() < 0.6 else "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
            return f' class="{pick(NEUTRAL) if u < 0.7 else made_up}"'
        key = "id" if r.random() < 0.3 else "class"
        return f' {key}="{" ".join({pick(names.split()) for _ in range(int(r.integers(1, 3)))})}{pick(["", "-" + pick(NEUTRAL)])}"'

    def link(text: str) -> str:
        return f'<a href="/{pick(words)}">{text}</a>'

    def inline(text: str) -> str:
        if r.random() < 0.15:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
        if r.random() < 0.15:
            text += " " + link(say(1, 4)) + " " + say(3, 12)
        return text

    def part(role: str) -> str:
        tags, names, phrases = ROLES[role]
        tag = pick(tags) if not plain or role == "form" else "div"
        known = tag in ("nav", "header", "footer", "aside", "form")
        a = attrs(names, 0.7 if known else 0.1)
        body = []
        if role in ("menu", "share"):
            items = [link(pick(phrases) if r.random() < 0.3 else say(1, 2)) for _ in range(int(r.integers(2, 9)))]
            listed = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" or r.random() < 0.6 else " ".join(items)
            body.append(listed if tag == "ul" or not listed.startswith("<li") else f"<ul>{listed}</ul>")
        elif role == "comments":
            if r.random() < 0.6:
                body.append(f"<h3>{pick(phrases)}</h3>")
            for _ in range(int(r.integers(1, 6))):
                inner = f"<p>{say(1, 2)} {pick(phrases)}</p><p>{inline(say(4, 50))}</p>"
                body.append(f"<li>{inner}</li>" if tag == "ol" else f"<div{attrs('comment reply response item', 0.3)}>{inner}</div>")
        elif role == "form":
            body += [f"<label>{pick(phrases)}</label><input name=x>" for _ in range(int(r.integers(1, 4)))]
            body.append(f"<button>{pick(phrases)}</button>" + (f"<p>{say(4, 14)}</p>" if r.random() < 0.4 else ""))
        else:
            for _ in range(int(r.integers(1, 4))):
                t = pick(phrases) if r.random() < 0.35 else say(3, 25)
                t = link(t) if r.random() < (0.5 if role == "sidebar" else 0.15) else t
                body.append(pick([f"<p>{t}</p>", f"<div>{t}</div>", t, f"<h3>{t}</h3>"]))
            if role == "sidebar" and r.random() < 0.6:
                body.append("<ul>" + "".join(f"<li>{link(say(2, 6))}</li>" for _ in range(int(r.integers(2, 7)))) + "</ul>")
            if role == "footer" and r.random() < 0.6:
                body.insert(0, "&copy; " + say(1, 8))
        return f"<{tag}{a} data-y=0>{''.join(body)}</{tag}>"

    def article() -> str:
        tags, names = ARTICLE
        tag = "div" if plain else pick(tags)
        a = attrs(names, 0.8 if tag in ("article", "main") else 0.15)
        boxed = plain and r.random() < 0.5      # every paragraph in an element of its own
        body = [f"<h1>{say(3, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(int(r.integers(1, 12))):
            u = r.random()
            if u < 0.72:
                text = f"<p>{inline(say(1, 4) if r.random() < 0.15 else say(2, 70))}" + ("</p>" if boxed or r.random() < 0.8 else "")
                body.append(f"<div{attrs(names)}>{text}</div>" if boxed else text)
            elif u < 0.76:
                body.append(f"<pre>{say(2, 30)}</pre>" if r.random() < 0.5 else f"<pre><code>{say(2, 30)}</code></pre>")
            elif u < 0.8:
                body.append(f"<figure><img src=x><figcaption>{say(2, 20)}</figcaption></figure>")
            elif u < 0.83:
                body.append(f"<h2>{say(1, 8)}</h2>")
            elif u < 0.86:
                body.append("<ul>" + "".join(f"<li>{inline(say(2, 20))}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif u < 0.9:
                body.append(f"<blockquote>{say(5, 30)}</blockquote>")
            elif u < 0.93:
                body.append("<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                body.append(part(pick(["share", "form"] if plain else ["advert", "share", "sidebar", "form", "notice"])))
        return f"<{tag}{a} data-y=1>{''.join(body)}</{tag}>" if tag != "td" else \
            f"<table><tr><td{a} data-y=1>{''.join(body)}</td></tr></table>"

    before = [x for x in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.45]
    after = [x for x in ("share", "sidebar", "comments", "form", "notice", "advert", "menu") if r.random() < 0.35]
    if plain:
        before, after = ([x for x in some if x in ("menu", "form", "share")] for some in (before, after))
    body = "".join(map(part, before)) + (article() if r.random() < 0.95 else "") + "".join(map(part, after))
    u = r.random()
    if u < 0.2 or plain and u < 0.75:           # a bare line instead of a footer
        tag = pick(["p", "div"])
        body += f"<{tag} data-y=0>{pick(['&copy;', 'Copyright ©', '©'])} {int(r.integers(1999, 2030))} {say(1, 6)} {pick(ROLES['footer'][2][1:])}</{tag}>"
    elif u < 0.75:
        body += part("footer")
    for _ in range(int(r.integers(0, 3))):
        body = f"<div{attrs('page site container wrapper layout', 0.4)}>{body}</div>"
    head = f"<head><title>{say(2, 6)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body data-y=0>{body}" + ("</body></html>" if r.random() < 0.8 else "")


def fit(words: list[str], pages: int = TRAIN_PAGES, seed: int = 11) -> Labeller:
    """A labeller trained on ``pages`` generated pages over ``words``."""
    r = np.random.default_rng(seed)
    model = Labeller()
    model.train([blocks(generated_page(words, r)) for _ in range(pages)])
    return model


def sample_words(pages: DataFrame, limit: int = WORDS) -> list[str]:
    """At most ``limit`` different words of ``WORD_PAGES`` whole pages (smallest hashes)."""
    ids = smallest_hashes(pages.select("page_id"), "page_id", WORD_PAGES)
    source = pages.where(F.col("html").isNotNull()).join(F.broadcast(ids), "page_id", "left_semi") \
        .select(F.col("html").cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {w for t in b.column(0) for x in blocks(t.as_py()) for w in x.text.split()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    rows = source.mapInArrow(run, "word string").distinct().orderBy(F.xxhash64("word"), "word").limit(limit).collect()
    return sorted(r["word"] for r in rows) or ["text"]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the kept blocks joined by a blank line.

    A null or blank page gives an empty text; null ids and repeated rows are answered each; a
    very long page is read whole, its vectors made in slices; a score of just 0.5 drops the
    block; an empty table gives an empty result; other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    schema = source.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            read = [blocks(t.as_py()) for t in b.column(2)]
            texts = ["\n\n".join(x.text for x, ok in zip(page, keep) if ok) for page, keep in zip(read, m.keep(read))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*b.schema.names[:2], "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op9(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(sample_words(pages)))
