"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is scanned once into leaf blocks (runs of text between block-level tags) with the tags and the words of class,
id and role of their ancestors. A block's features are a bit set of these and of properties of its text; the field has
one weight per feature and label and one per pair of neighbouring labels. It is trained on labelled pages that
``training_pages`` lays out in many ways, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# A tag's name and its end if it has no attributes; one attribute; both never go back, so each page is read once.
TAG = re.compile(r"</?+([a-zA-Z][^\s/>]*+)\s*+(>)?")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)|(?=>)|([\"']|\Z)))?+)")

# HTML element names by role.
RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "xmp"}
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
UNSEEN = {"script", "style", "title", "textarea", "iframe", "noframes", "head", "template", "svg", "select", "option", "button", "canvas", "audio", "video", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "map", "math", "mi", "mn", "mo", "mrow", "ms", "msub", "msup", "msubsup", "mfrac", "msqrt", "mtext", "semantics", "annotation", "ruby", "rb", "rt", "rp"}
ANCESTORS = ["nav", "header", "footer", "aside", "article", "main", "section", "form", "fieldset", "ul", "ol", "dl", "table", "blockquote", "figure", "menu", "dialog", "address", "div", "body", "pre", "details"]
OWN = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "figcaption", "legend", "caption", "div", "a", "summary"]
# Words in class, id and role attributes, by what they tell of a block.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager toc",
    "head": "header masthead banner logo site-title brand branding",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget widgets rail related recommended popular trending",
    "note": "notice cookie cookies consent gdpr alert modal popup overlay newsletter subscribe signup paywall",
    "comment": "comment comments commentlist reply replies respond discussion disqus",
    "form": "form login search contact",
    "share": "share sharing social follow",
    "main": "article content main post entry story body text page-content",
    "contentinfo": "contentinfo complementary",
}
NAMES = [*(f"in {t}" for t in ANCESTORS), *(f"is {t}" for t in OWN), *(f"hint {h}" for h in HINTS), "hidden", "words 1-2", "words 3-6", "words 7-15", "words 16+", "links", "some links", "ends", "comma", "copyright", "upper", "first", "last", "always"]
BIT = {name: 1 << i for i, name in enumerate(NAMES)}
WORD_BIT = {w: BIT[f"hint {h}"] for h, words in HINTS.items() for w in words.split()}


@dataclass
class Block:
    """A leaf block: its text with white space made single, its feature bits, its label in training pages."""

    text: str
    bits: int
    label: int = -1


@dataclass
class _Open:
    tag: str
    bits: int
    unseen: bool
    label: int


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes of a tag from behind its name, whether it ends with a slash, and where it ends (-1: the page ends first).

    As the standard has it, a quote opens a value only right after an equals sign.
    """
    found: list[tuple[str, str]] = []
    while (m := ATTRIBUTE.match(page, at)) is not None:
        if m[1]:
            return found, page[m.start() : m.end() - 1].endswith("/"), m.end()
        if m[6] is not None:
            break  # a quote that nothing closes
        value = m[3] or m[4] or m[5] or ""
        found.append((m[2].lower(), entities.unescape(value).lower() if "&" in value else value.lower()))
        at = m.end()
    return found, False, -1


def _attribute_bits(attributes: list[tuple[str, str]], labelled: bool) -> tuple[int, bool, int]:
    bits, hidden, label = 0, False, -1
    for name, value in attributes:
        if name in ("class", "id", "role"):
            for w in value.split():
                bits |= WORD_BIT.get(w, 0)
                for part in re.split(r"[-_]|\d+", w):
                    bits |= WORD_BIT.get(part, 0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
        elif labelled and name == "data-label":
            label = int(value)
    return bits, hidden, label


ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "menu", "select", "body", "html"}
IN_HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "script", "style", "title", "noscript", "noframes", "template"}


class _Stack:
    """Open elements, with the places of each tag's, so that no look goes through all of them."""

    def __init__(self):
        self.open = [_Open("html", 0, False, -1)]
        self.places: dict[str, list[int]] = {"html": [0]}

    def push(self, element: _Open) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, 0 without."""
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=0)

    def cut(self, place: int) -> None:
        """Close all elements from a place on; the outermost stays."""
        while len(self.open) > max(1, place):
            self.places[self.open.pop().tag].pop()


def blocks(page: str, labelled: bool = False) -> list[Block]:
    """Leaf blocks of a page in order. Scripts, styles, titles, comments and form controls are no blocks.

    The page is read once, in time that grows with its length, whatever its markup. A tag that the page's end cuts off
    is dropped, as the standard has it. ``labelled``: ``data-label`` attributes are the labels of training pages.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = total = 0
    in_link = False

    def close() -> None:
        nonlocal linked, total
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            top = stack.open[-1]
            out.append(Block(text, top.bits | BIT.get(f"is {top.tag}", 0) | text_bits(text, linked, total), top.label))
        parts.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if not raw:
            return
        if stack.open[-1].unseen:
            if stack.open[-1].tag != "head" or raw.isspace():
                return
            stack.cut(stack.last(["head"]))  # text ends a head that was left open
        text = entities.unescape(raw)
        parts.append(text)
        n = len(text.strip())
        total += n
        linked += n * in_link

    at, n = 0, len(page)  # what stands before at is done
    seek = 0
    while (lt := page.find("<", seek)) >= 0:
        m = TAG.match(page, lt)
        if m is None:
            if not page.startswith(("!", "?", "/"), lt + 1):
                seek = lt + 1  # a plain character
                continue
            add(page[at:lt])
            mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(mark, lt + 2)
            if mark == "]]>":
                add(page[lt + 9 : end if end >= 0 else n])
            seek = at = end + len(mark) if end >= 0 else n
            continue
        add(page[at:lt])
        closing, tag = page[lt + 1] == "/", m[1].lower()
        attributes, empty, at = ([], False, m.end()) if m[2] else _attributes(page, m.end(1))
        if at < 0:
            at = n
            break
        seek = at
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                parts.append(" ")
            continue
        close()
        in_link = False
        if closing:
            if place := stack.last([tag]):
                stack.cut(place)
            continue
        if stack.open[-1].tag == "p" and tag not in RAW:
            stack.cut(len(stack.open) - 1)
        if tag in ENDS_ITSELF and (place := stack.last(ENDS_ITSELF[tag])) > stack.last(HOLDS):
            stack.cut(place)
        if tag not in IN_HEAD and (place := stack.last(["head"])):
            stack.cut(place)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            seek = at = end.end() if end else n
            if end and end[0][-1] != ">":
                gt = page.find(">", at)
                seek = at = gt + 1 if gt >= 0 else n
            continue
        if empty:
            continue
        top = stack.open[-1]
        bits, hidden, label = _attribute_bits(attributes, labelled) if attributes else (0, False, -1)
        stack.push(_Open(tag, top.bits | bits | BIT.get(f"in {tag}", 0) | (BIT["hidden"] if hidden else 0), top.unseen or tag in UNSEEN, label if label >= 0 else top.label))
    add(page[at:])
    close()
    if out:
        out[0].bits |= BIT["first"]
        out[-1].bits |= BIT["last"]
    return out


def text_bits(text: str, linked: int, total: int) -> int:
    n = text.count(" ") + 1
    bits = BIT["always"] | BIT["words 1-2" if n < 3 else "words 3-6" if n < 7 else "words 7-15" if n < 16 else "words 16+"]
    if linked:
        bits |= BIT["links"] if 2 * linked > total else BIT["some links"]
    if text[-1] in ".!?:;…":
        bits |= BIT["ends"]
    if "," in text:
        bits |= BIT["comma"]
    if "\xa9" in text or "copyright" in text.lower():
        bits |= BIT["copyright"]
    if text.isupper():
        bits |= BIT["upper"]
    return bits


class Field:
    """Linear-chain conditional random field with two labels (1: main text) over feature bit sets."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.seen: dict[int, tuple[float, float]] = {}

    def emit(self, bits: int) -> tuple[float, float]:
        if (e := self.seen.get(bits)) is None:
            on = [i for i in range(len(NAMES)) if bits >> i & 1]
            e = self.seen[bits] = tuple(self.weights[on].sum(axis=0).tolist())
        return e

    def viterbi(self, page: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = self.emit(page[0].bits)
        back = []
        for block in page[1:]:
            e0, e1 = self.emit(block.bits)
            from0, from1 = s0 + m00 < s1 + m10, s0 + m01 < s1 + m11
            s0, s1 = e0 + (s1 + m10 if from0 else s0 + m00), e1 + (s1 + m11 if from1 else s0 + m01)
            back.append((from0, from1))
        y = [int(s1 > s0)]
        for step in reversed(back):
            y.append(int(step[y[-1]]))
        return y[::-1]


def fit(pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps with adapted rates; forward and backward passes run on all pages at once."""
    length, n = max(map(len, pages)), len(pages)
    x = np.zeros((n, length, len(NAMES)))
    y, there = np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, page in enumerate(pages):
        for j, block in enumerate(page):
            x[i, j] = [block.bits >> k & 1 for k in range(len(NAMES))]
            y[i, j], there[i, j] = block.label, True
    gold = np.eye(2)[y] * there[..., None]
    gold_moves = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:])
    w, t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    both = there[:, 1:]
    for step in range(1, rounds + 1):
        e = x @ w
        a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        a[:, 0] = e[:, 0]
        for j in range(1, length):
            new = e[:, j] + np.logaddexp(a[:, j - 1, :1] + t[0], a[:, j - 1, 1:] + t[1])
            a[:, j] = np.where(there[:, j, None], new, a[:, j - 1])
        for j in range(length - 2, -1, -1):
            z = e[:, j + 1] + b[:, j + 1]
            new = np.logaddexp(t[:, 0] + z[:, :1], t[:, 1] + z[:, 1:])
            b[:, j] = np.where(there[:, j + 1, None], new, 0)
        log_z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - log_z[:, None, None]) * there[..., None]
        pair = a[:, :-1, :, None] + t + (e + b)[:, 1:, None, :] - log_z[:, None, None, None]
        moved = (np.exp(np.where(both[..., None, None], pair, -np.inf))).sum(axis=(0, 1))
        for k, (value, grad) in enumerate(((w, np.einsum("nlf,nla->fa", x, gold - p) / n - ridge * w), (t, (gold_moves - moved) / n - ridge * t))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(w, t)


def training_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Labelled pages in many layouts: ``data-label`` says what is main text (1). Words are made up."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda p: rng.random() < p

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick("ka", "re", "to", "mi", "sol", "une", "der", "est", "é", "an") for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(lo, hi + 1)))

    def prose(lo: int, hi: int) -> str:
        text = words(lo, hi)
        if maybe(0.1):
            return text.upper() + pick("", "!!", "!")
        if maybe(0.6):
            text = text.replace(" ", ", ", 1)
        return text.capitalize() + pick(".", ".", ".", ".", "?", "")

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def rubbish(kind: str) -> str:
        k = rng.integers(2, 9)
        if kind == "menu":
            inner = pick(f"<ul>{links(k)}</ul>", "".join(f'<a href="#">{words(1, 2)}</a> ' for _ in range(k)))
            return pick(f"<nav>{inner}</nav>", f'<div class="{pick("menu", "navbar", "main-nav", "breadcrumbs")}">{inner}</div>', f'<div role="navigation">{inner}</div>')
        if kind == "head":
            inner = pick(f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<div>{words(1, 4)}</div><p>{words(3, 9)}</p>", f'<a href="/">{words(1, 3)}</a>')
            return pick(f"<header>{inner}</header>", f'<div class="{pick("header", "masthead", "site-header")}">{inner}</div>', f'<div id="header">{inner}</div>')
        if kind == "foot":
            inner = pick(f"&copy; {words(1, 3)} &middot; {prose(2, 12)}", f"<p>{prose(4, 20)}</p>", f"<p>Copyright 2020 {words(2, 6)}</p><ul>{links(3)}</ul>", prose(3, 15))
            return pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{pick("footer", "site-footer", "legal")}">{inner}</div>', f'<div id="footer">{inner}</div>')
        if kind == "ad":
            inner = pick(prose(4, 25), f"<p>{prose(5, 30)}</p>", f'<a href="http://x">{prose(3, 12)}</a>')
            return f'<{(t := pick("div", "div", "aside", "section"))} class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo-box", "ad-slot")}">{inner}</{t}>'
        if kind == "side":
            inner = pick(f"<h3>{words(1, 4)}</h3><ul>{links(k)}</ul>", f"<h2>{words(1, 3)}</h2><p>{prose(8, 40)}</p>", f"<p>{prose(5, 40)}</p>")
            return pick(f"<aside>{inner}</aside>", f'<div class="{pick("sidebar", "widget", "related-posts")}">{inner}</div>', f'<div id="sidebar">{inner}</div>')
        if kind == "note":
            inner = pick(f"<p>{prose(6, 30)}</p>", prose(5, 25), f"<p>{prose(6, 25)}</p><button>OK</button>")
            return f'<{(t := pick("div", "section", "dialog"))} class="{pick("cookie-notice", "notice", "consent", "alert", "newsletter", "popup")}">{inner}</{t}>'
        if kind == "form":
            return pick(f'<form><label>{words(1, 3)}</label><input type="text"><button>{words(1, 2)}</button></form>', f"<form><p>{prose(3, 20)}</p><input><textarea>{words(3, 6)}</textarea></form>", f"<form>{prose(3, 15)}<select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>")
        if kind == "share":
            return f'<div class="{pick("share", "social-links")}">{"".join(f"<a href=#>{words(1, 1)}</a> " for _ in range(3))}</div>'
        item = lambda: pick(f"<p>{prose(5, 60)}</p>", f"<h4>{words(1, 3)}</h4><p>{prose(6, 50)}</p>", prose(4, 40))
        each = pick("div", "li", "article")
        inner = "".join(f'<{each} class="{pick("comment", "reply")}">{item()}</{each}>' for _ in range(rng.integers(1, 5)))
        return f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comments", "commentlist", "discussion", "replies")}">{pick("", f"<h3>{words(1, 3)}</h3>")}{inner}</{t}>'

    def main(bare: bool = False) -> str:
        if bare:
            return f"<x-text>{pick('', f'<h1>{prose(2, 12)}</h1>')}{''.join(pick(f'<p>{prose(4, 60)}</p>', prose(6, 40), f'<div>{prose(6, 40)}</div>') for _ in range(rng.integers(1, 4)))}</x-text>"
        out = [f"<h1>{prose(2, 12)}</h1>"] if maybe(0.85) else []
        for _ in range(rng.integers(1, 10)):
            kind = rng.random()
            if kind < 0.66:
                p = prose(*pick((1, 4), (5, 20), (20, 90), (20, 90)))
                if maybe(0.25):
                    p = p.replace(" ", " <a href=#>link</a> ", 1)
                out.append(pick(f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br><p>{prose(10, 50)}</p>"))
            elif kind < 0.74:
                out.append(f"<{(t := pick('h2', 'h3'))}>{prose(1, 8)}</{t}>")
            elif kind < 0.82:
                out.append(f"<{(t := pick('ul', 'ol'))}>{''.join(f'<li>{prose(2, 20)}</li>' for _ in range(rng.integers(2, 6)))}</{t}>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{prose(5, 40)}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 4)}</td></tr></table>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x><figcaption>{prose(3, 15)}</figcaption></figure>")
            else:
                out.append(f"<pre>{words(5, 20)}</pre>")
            if maybe(0.04):
                out.append(_labelled(rubbish(pick("ad", "share")), 0))
        inner = "".join(out)
        return pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="{pick("content", "post", "entry-content", "story", "article-body")}">{inner}</div>', f'<div id="content">{inner}</div>', f"<div>{inner}</div>", f"<x-text>{inner}</x-text>")

    pages = []
    for _ in range(n):
        chance = lambda kind, p: [_labelled(rubbish(kind), 0)] if maybe(p) else []
        before = chance("head", 0.5) + chance("menu", 0.8) + chance("ad", 0.5) + chance("note", 0.3) + chance("side", 0.2) + chance("form", 0.15)
        after = chance("share", 0.2) + chance("ad", 0.3) + chance("comments", 0.4) + chance("side", 0.4) + chance("form", 0.3) + chance("note", 0.2) + chance("menu", 0.2)
        rng.shuffle(before)
        rng.shuffle(after)
        body = "".join(before) + _labelled(main(), 1) + "".join(after) + "".join(chance("foot", 0.85))
        if maybe(0.08):  # nothing but a text
            body = _labelled(main(bare=True), 1)
        body = pick(body, f"<div>{body}</div>", f'<div class="page"><div class="wrap">{body}</div></div>')
        whole = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var t='</p>'</script></head><body>{body}</body></html>"
        pages.append(whole if maybe(0.9) else body)
    return pages


def _labelled(fragment: str, label: int) -> str:
    """The label on each outermost element of a fragment."""
    return re.sub(r"^<(\w+)", rf'<\1 data-label="{label}"', fragment, count=1)


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted to the labelled pages; a second or two, once per process."""
    pages = [[b for b in blocks(p, labelled=True) if b.label >= 0] for p in training_pages()]
    return fit([p for p in pages if p])


def main_text(page: str, model: Field) -> str:
    """Main text blocks of a page in order, joined by one space."""
    leaves = blocks(page)
    return " ".join(b.text for b, y in zip(leaves, model.viterbi(leaves), strict=True) if y)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    Null and empty html give an empty text; broken markup is read as far as it goes; texts without any tag are one
    block; pages of any length are read whole; repeated rows give repeated rows; other columns are not read.
    """
    model = trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column(2)]
            if len(model.seen) > 100_000:
                model.seen.clear()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
