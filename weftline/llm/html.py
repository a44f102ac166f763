"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks, each with the path of elements above it and its text. A bidirectional LSTM, in numpy, reads
for each block a hashed vector of the path, one of the words, and a few measures, and labels every block with the whole
document on both sides. It is trained here, on pages made by `made_page`, whose blocks' labels are known; no page of the input
is used, so the labels of a page never depend on others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.base import claim

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Elements whose content is no markup up to their end tag, or the page's end; those whose whole content goes if they end.
_RAW = {"script", "style", "title", "iframe", "textarea", "noembed", "noframes", "xmp"}
_SKIPPED = {"noscript", "template", "svg", "math"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
_BLOCKS = set("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_BREAKS = {"hr"}
#: An element whose start ends those of the other set that are open, up to the first of the third.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _elements(html: str, tag: str) -> dict[int, int]:
    """Where the elements of this tag that end begin and end. Those within others of the tag nest; comments and raw text hold none."""
    known = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(_RAW))})(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>?|\Z)|<(/?){tag}(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S | re.I)
    out: dict[int, int] = {}
    begun: list[int] = []
    for m in known.finditer(html):
        if m[2] is None:
            continue
        if m[2] and begun:
            out[begun.pop()] = m.end()
        elif not m[2] and not m[3].endswith("/"):
            begun.append(m.start())
    return out


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, white space within each turned into single spaces; empty ones are left out.

    Raw text elements go to their end tag, or to the page's end without one. Elements of noscript, template, svg and math go
    whole, those within them too; a self-closed one, or one that never ends, is its tag alone. What stands in object, canvas
    and all others is content.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, link_from = 0, None
    elements: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked, link_from
        if text:
            words = unescape("".join(text)).split()
            if words:
                whole = " ".join(words)
                if link_from is not None:
                    linked += sum(map(len, text[link_from:]))
                out.append(Block(stack[-1][1] if stack else (), whole, min(linked, len(whole))))
            text.clear()
        linked, link_from = 0, 0 if link_from is not None else None

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                if link_from is not None:
                    linked, link_from = linked + sum(map(len, text[link_from:])), None
            elif tag in _BLOCKS:
                flush()
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            continue
        if tag in _RAW:
            end = _RAW_ENDS[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag in _SKIPPED:
            if not m[0].endswith("/>"):
                if tag not in elements:
                    elements[tag] = _elements(html, tag)
                at = max(at, elements[tag].get(m.start(), at))
        elif tag == "a":
            if link_from is None:
                link_from = len(text)
        elif tag == "br":
            text.append("\n")
        elif tag in _BREAKS:
            flush()
        elif tag in _BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _ENDS:
                others, until = _ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in others:
                        del stack[k:]
                        break
            if tag == "body":
                stack = [x for x in stack if x[0] != "head"]
            if not m[0].endswith("/>"):
                above = stack[-1][1] if stack else ()
                stack.append((tag, (*above, _step(tag, m[3]))))
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


def _step(tag: str, attributes: str) -> str:
    if not attributes.strip():
        return tag
    names = [p.lower() for _, v in _ATTRIBUTE.findall(attributes) for p in _PART.findall(v.strip("\"'"))]
    return " ".join([tag, *dict.fromkeys(names)])


PATH, LEAF, WORDS, MEASURES = 64, 16, 24, 6
INPUT = PATH + LEAF + WORDS + MEASURES


def _signed(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 16 & 1 else -1.0


class _Paths(dict):
    def __missing__(self, path: tuple[str, ...]) -> np.ndarray:
        if len(self) > 20_000:
            self.clear()
        v = np.zeros(PATH + LEAF, np.float32)
        for step in path:
            tag, *names = step.split(" ")
            if tag not in ("html", "body"):
                for token in (tag, *("." + n for n in names)):
                    k, sign = _signed(token, PATH)
                    v[k] = np.clip(v[k] + sign, -2, 2)
        k, sign = _signed(path[-1].split(" ")[0] if path else "", LEAF)
        v[PATH + k] = sign
        self[path] = v
        return v


class _Words(dict):
    """Twice the bucket, one more for a negative sign."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        k, sign = _signed(word.strip(".,;:!?()\"'").lower(), WORDS)
        value = self[word] = 2 * k + (sign < 0)
        return value


_paths, _words = _Paths(), _Words()


def _forget() -> None:
    _paths.clear()
    _words.clear()


def vectors(page: list[Block]) -> np.ndarray:
    claim("html", _forget)
    out = np.zeros((len(page), INPUT), np.float32)
    n = len(page)
    for k, b in enumerate(page):
        words = b.text.split(" ")
        out[k, : PATH + LEAF] = _paths[b.path]
        both = np.bincount(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)), minlength=2 * WORDS)
        signed = both[::2] - both[1::2]
        out[k, PATH + LEAF : -MEASURES] = signed / max(1.0, float(signed @ signed) ** 0.5)
        out[k, -MEASURES:] = np.log1p(len(words)) / 4, b.linked / max(1, len(b.text)), b.text[-1] in ".!?…", b.text.count(",") / len(words), k / n, len(b.path) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Weights by direction: wx (input to gates), wh (state to gates), b; and the output's wo and bo. Gates: in, forget, out, new."""

    def __init__(self, hidden: int = 20, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["wx" + d] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * hidden)).astype(np.float32)
            self.w["wh" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.w["b" + d] = np.repeat(np.float32([0, 1, 0, 0]), hidden)
        self.w["wo"], self.w["bo"] = rng.normal(0, 0.2, 2 * hidden).astype(np.float32), np.zeros(1, np.float32)

    def _pass(self, d: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction over (pages, blocks, input); padding leaves the state as it is."""
        n, t, _ = x.shape
        hd = self.hidden
        gates = (x.reshape(n * t, -1) @ self.w["wx" + d] + self.w["b" + d]).reshape(n, t, 4 * hd)
        h, c = np.zeros((n, hd), np.float32), np.zeros((n, hd), np.float32)
        out = np.zeros((n, t, hd), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[:, k] + h @ self.w["wh" + d]
            g, new = _sigmoid(z[:, : 3 * hd]), np.tanh(z[:, 3 * hd :])
            c2 = g[:, hd : 2 * hd] * c + g[:, :hd] * new
            tc = np.tanh(c2)
            on = live[:, k, None]
            if keep is not None:
                keep.append((k, h, c, g, new, c2, tc, on))
            h, c = np.where(on, g[:, 2 * hd :] * tc, h), np.where(on, c2, c)
            out[:, k] = h
        return out

    def predict(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._pass("f", x, live), self._pass("b", x, live)], 2)
        return _sigmoid(states @ self.w["wo"] + self.w["bo"])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keeps: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._pass(d, x, live, keeps[d]) for d in "fb"], 2)
        p = _sigmoid(states @ self.w["wo"] + self.w["bo"])
        total = live.sum()
        miss = np.where(live, p - y, 0).astype(np.float32) / total
        out = {"wo": np.einsum("nt,nth->h", miss, states), "bo": miss.sum(keepdims=True).reshape(1)}
        hd = self.hidden
        for i, d in enumerate("fb"):
            back = miss[:, :, None] * self.w["wo"][i * hd : (i + 1) * hd]
            wx, wh, b = (np.zeros_like(self.w[k + d]) for k in ("wx", "wh", "b"))
            dh, dc = np.zeros((len(x), hd), np.float32), np.zeros((len(x), hd), np.float32)
            for k, h, c, g, new, c2, tc, on in reversed(keeps[d]):
                dh = dh + back[:, k]
                own = dc + dh * g[:, 2 * hd :] * (1 - tc**2)
                dz = np.concatenate([own * new, own * c, dh * tc], 1) * g * (1 - g)
                dz = np.where(on, np.concatenate([dz, own * g[:, :hd] * (1 - new**2)], 1), 0)
                wx += x[:, k].T @ dz
                wh += h.T @ dz
                b += dz.sum(0)
                dh, dc = np.where(on, dz @ self.w["wh" + d].T, dh), np.where(on, own * g[:, hd : 2 * hd], dc)
            out |= {"wx" + d: wx, "wh" + d: wh, "b" + d: b}
        loss = -np.where(live, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / total
        return float(loss), out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(map(len, pages)))
    x, live = np.zeros((len(pages), t, INPUT), np.float32), np.zeros((len(pages), t), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], live[k, : len(p)] = p, True
    return x, live


_SYLLABLES = "an ber che da el fi gon ha in jo ka len mo ne or pa qui re sta ti un ver wen xi ya zo ß é ción ou eau heit ung tion ing the ed".split()
_CHROME = "home about contact login register search menu next previous more share reply subscribe cookies accept copyright privacy terms sitemap follow newsletter related tags category archive posted ago".split()


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of known labels: 1 for each block of the article, 0 for any other."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    out: list[str] = []
    labels: list[int] = []

    def words(n: int, chrome: float = 0.0) -> str:
        ws = [pick(*_CHROME) if rng.random() < chrome else "".join(_SYLLABLES[int(i)] for i in rng.integers(0, len(_SYLLABLES), int(rng.integers(1, 4)))) for _ in range(max(1, n))]
        return (" ".join(ws).capitalize() + pick(".", ".", "!", "")) if n > 4 else " ".join(ws)

    def prose(n: int) -> str:
        if chance(0.12):  # rows of words, repeated words, shouting, signs: an article may hold any of them
            kind, ws = int(rng.integers(4)), [words(1) for _ in range(n)]
            return [" | ".join(ws), " ".join(ws[:1] * n), " ".join(w.upper() + "!!" for w in ws), " ".join(w + pick("###", "&amp;&amp;", "***", "%%%", " 4293") for w in ws)][kind]
        parts = []
        while n > 0:
            k = int(min(n, rng.integers(1, 25)))
            ws = [words(1) + ("," if rng.random() < 0.1 else "") for _ in range(k)]
            if chance(0.05):
                ws[0] = f"<a href=x>{ws[0]}</a>"
            parts.append(" ".join(ws).capitalize() + ".")
            n -= k
        return " ".join(parts)

    def leaf(tag: str, text: str, label: int, attributes: str = "") -> None:
        out.append(f"<{tag}{attributes}>{text}" + ("" if tag in ("p", "li") and chance(0.15) else f"</{tag}>"))
        labels.append(label)

    def named(*names: str) -> str:
        return f" {pick('class', 'class', 'id')}=\"{pick(*names)}\"" if names else ""

    def boxed(tag: str, names: tuple, inside) -> None:
        out.append(f"<{tag}{named(*names)}>")
        inside()
        out.append(f"</{tag}>")

    def links(n: int) -> None:
        out.append("<ul>" if chance(0.8) else "<ol>")
        kind = out[-1][1:3]
        for _ in range(n):
            leaf("li", f'<a href="/x">{words(int(rng.integers(1, 4)), 0.4)}</a>', 0)
        out.append(f"</{kind}>")

    def menu() -> None:
        boxed(*pick(("nav", ("main-nav", "top", "breadcrumb")), ("nav", ()), ("div", ("menu", "navbar", "navigation", "breadcrumbs"))), lambda: links(int(rng.integers(2, 9))))

    def advert() -> None:
        boxed(pick("div", "div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "ad-slot"), lambda: leaf(pick("p", "span"), words(int(rng.integers(2, 30))), 0) if chance(0.5) else (out.append(words(int(rng.integers(2, 30)))), labels.append(0)))

    def notice() -> None:
        boxed(pick("div", "section", "aside"), ("notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "paywall-notice", "newsletter", "popup"), lambda: [leaf(pick("p", "div"), words(int(rng.integers(3, 25)), 0.3), 0) for _ in range(int(rng.integers(1, 3)))])

    def form() -> None:
        out.append(f"<form{named('search', 'login', 'subscribe', 'contact') if chance(0.6) else ''}>")
        for _ in range(int(rng.integers(1, 4))):
            leaf(pick("p", "div", "button"), f"<label>{words(int(rng.integers(1, 6)), 0.4)}</label><input>", 0)
        out.append("</form>")

    def side() -> None:
        def inside() -> None:
            for _ in range(int(rng.integers(1, 4))):
                leaf(pick("h2", "h3", "h4"), words(int(rng.integers(1, 5)), 0.4), 0)
                links(int(rng.integers(2, 6))) if chance(0.6) else leaf("p", prose(int(rng.integers(5, 40))), 0)

        boxed(*pick(("aside", ()), ("aside", ("sidebar", "related")), ("div", ("sidebar", "side-bar", "widget", "related-posts", "recommended"))), inside)

    def comments() -> None:
        def inside() -> None:
            if chance(0.6):
                leaf(pick("h2", "h3"), words(2, 0.5), 0)
            for _ in range(int(rng.integers(1, 7))):
                boxed(pick("div", "li", "article"), ("comment", "comment-body", "reply", "user-comment"), lambda: [leaf("p", prose(int(rng.integers(3, 50))), 0) for _ in range(int(rng.integers(1, 3)))])

        boxed(pick("section", "div", "ol"), ("comments", "comment-list", "disqus", "responses", "discussion", "reader-comments"), inside)

    def header() -> None:
        def inside() -> None:
            leaf(pick("div", "p", "h2"), words(int(rng.integers(1, 5)), 0.2), 0)
            if chance(0.5):
                menu()
            if chance(0.3):
                form()

        boxed(*pick(("header", ()), ("header", ("site-header", "masthead")), ("div", ("header", "masthead", "site-header", "top-bar"))), inside)

    def footer() -> None:
        def inside() -> None:
            if chance(0.5):
                out.append("&copy; " + words(int(rng.integers(2, 20)), 0.3))
                labels.append(0)
            else:
                leaf("p", "&copy; " + words(int(rng.integers(2, 20)), 0.3), 0)
            if chance(0.4):
                links(int(rng.integers(2, 6)))

        boxed(*pick(("footer", ()), ("footer", ()), ("footer", ("site-footer",)), ("div", ("footer", "site-footer", "copyright"))), inside)

    def article() -> None:
        if chance(0.8):
            leaf("h1", words(int(rng.integers(2, 14))), 1)
        many = chance(0.12)
        for _ in range(int(rng.integers(14, 120) if many else rng.integers(1, 14))):
            kind = rng.random() * (0.8 if many else 1)
            if kind < 0.72:
                leaf("p", ("<b>" if chance(0.1) else "") + prose(int(rng.choice([1, 3, 12, 40, 90, 200]))) + ("<br>" if chance(0.1) else ""), 1)
            elif kind < 0.79:
                leaf(pick("h2", "h3"), words(int(rng.integers(1, 8))), 1)
            elif kind < 0.85:
                out.append("<ul>")
                for _ in range(int(rng.integers(2, 6))):
                    leaf("li", prose(int(rng.integers(2, 25))), 1)
                out.append("</ul>")
            elif kind < 0.89:
                boxed("blockquote", (), lambda: leaf("p", prose(int(rng.integers(5, 40))), 1))
            elif kind < 0.92:
                leaf(pick("pre", "div", "figcaption"), prose(int(rng.integers(4, 40))), 1)
            elif kind < 0.95:
                advert()
            elif kind < 0.97:
                notice()
            else:
                boxed("table", (), lambda: [boxed("tr", (), lambda: [leaf("td", words(int(rng.integers(1, 5))), 1) for _ in range(2)]) for _ in range(int(rng.integers(1, 4)))])

    for _ in range(int(rng.integers(0, 3))):
        pick(header, menu, menu, notice, advert)()
    wrap = [x for x in (pick(None, "<div>", '<div class="container">', '<div id="wrapper">'),) if x]
    out += wrap
    if chance(0.3):
        pick(side, menu, advert)()
    tag, names = pick(("article", ()), ("article", ()), ("article", ("post", "entry", "story")), ("main", ()), ("main", ("content",)), ("section", ("article", "content")), ("div", ("content", "post", "entry-content", "article-body", "story", "main", "text")), ("", ()))
    if tag:
        boxed(tag, names, article)
    else:
        article()
    for _ in range(int(rng.integers(0, 3))):
        pick(side, comments, comments, form, advert, notice)()
    out += ["</div>"] * len(wrap)
    if chance(0.85):
        footer()
    body = "".join(out)
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if chance(0.8) else ""), labels


_trained: dict[tuple, Labeller] = {}


def trained(pages: int = 700, rounds: int = 20, seed: int = 11) -> Labeller:
    """The labeller after so many rounds over so many made pages; one for each setting and process."""
    if (pages, rounds, seed) in _trained:
        return _trained[pages, rounds, seed]
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        html, labels = made_page(rng)
        found = blocks(html)
        if len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    model = Labeller()
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    step = 0
    data.sort(key=lambda d: len(d[0]))
    batches = [data[k : k + 20] for k in range(0, len(data), 20)]
    for r in range(rounds):
        for k in rng.permutation(len(batches)):
            x, live = padded([d[0] for d in batches[k]])
            x[:, :, PATH + LEAF : -MEASURES] *= rng.random((len(x), 1, 1)) > 0.3
            # Words of some pages and path tokens now and then are dropped, so that neither decides alone.
            x[:, :, :PATH] *= rng.random((len(x), 1, PATH)) > 0.05
            y = np.zeros(live.shape, np.float32)
            for i, d in enumerate(batches[k]):
                y[i, : len(d[1])] = d[1]
            _, grad = model.gradients(x, live, y)
            step += 1
            rate = 0.01 * (1 - r / rounds) + 0.0005
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                model.w[name] = (model.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    _trained[pages, rounds, seed] = model
    return model


#: Blocks, with padding, that are labelled at once.
CELLS = 6_000


def labelled(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page the probability of each of its blocks to be main text."""
    out = [np.zeros(0, np.float32)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    while order:
        some = []
        while order and (not some or len(pages[some[0]]) * (len(some) + 1) <= CELLS):
            some.append(order.pop())
        x, live = padded([vectors(pages[k]) for k in some])
        for k, p in zip(some, model.predict(x, live)):
            out[k] = p[: len(pages[k])]
    return out


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text (the main blocks in page order, one a line; empty if none) and n_blocks.

    Null html is empty. Rows that repeat a page_id, or have none, are each extracted; null urls stay null; an empty table gives
    an empty one; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                some = batch.slice(k, 400)
                found = [blocks(h) for h in some.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, q in zip(page, p) if q >= 0.5) for page, p in zip(found, labelled(sent.value, found))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int32())], names=["page_id", "url", "text", "n_blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks int")
