"""Main text of HTML pages from flat blocks.

A page becomes a flat list of text blocks (no tree): each with its words, link density, those of its neighbours, whether
it stands in an article, and whether in a container that names itself main text or boilerplate. A decision tree, fitted
here to the blocks of a small labelled table of pages, classifies them: in an article the names within it count, elsewhere
words and links.

Null and empty pages give an empty text; pages cut off anywhere are read as far as they go. Every page has its row,
repeated pages too; a row depends on its own page. Empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import load

#: Elements whose content is no text of the page; a template of fixed values from the HTML standard.
SKIPPED = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|datalist|title|audio|video"
#: What stands in a tag after its name; without backtracking, and ended by the next tag, so that reading stays linear.
ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<({SKIPPED})\b{ATTRS}>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)({ATTRS})>", re.S | re.I)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A tag that a cut page leaves open at its end.
OPEN_END = re.compile(r"<[/!?a-zA-Z][^<>]*$")
BROKEN = re.compile(r"</?[a-zA-Z][^<>]*>?")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog search fieldset".split())
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|foot|side-?bar|aside|widget\w*|cookies?|consent|gdpr|notices?|alert|popup|pop-up|modal|overlay|newsletter|subscri\w*|sign-?up|login|comments?|comment-\w+|commentlist|disqus\w*|respon[ds]e?s?|repl(?:y|ies)|discussion|feedback|share|sharing|social\w*|related|recommend\w*|trending|popular|pagination|pager|toolbar|masthead|site-?header|page-?header|topbar|copyright|legal|disclaimer|skip\w*|tags|teaser)(?:$|[\s_-])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body-?text|prose|text)(?:$|[\s_-])", re.I)
NAMED_BY = ("class", "id", "role", "aria-label")
#: Names that say what a page has or lacks, not what the element is.
MODIFIERS = re.compile(r"(?<!\S)(?:has|no|with|without)-\S+|(?<!\S)\S+-(?:open|closed|enabled|disabled)(?!\S)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
UNSEEN_NAMES = frozenset("hidden d-none sr-only visually-hidden screen-reader-text".split())


class Block:
    __slots__ = ("text", "words", "linked", "inside", "good", "bad", "heading", "item", "label")

    def __init__(self, text: str, linked: int, inside: bool, good: bool, bad: bool, heading: bool, item: bool, label: int):
        self.text, self.words, self.linked, self.inside, self.good, self.bad, self.heading, self.item, self.label = text, len(text.split()), linked, inside, good, bad, heading, item, label


def attributes(raw: str) -> dict[str, str]:
    """A tag's attributes by lower-case name, the first of equal ones."""
    out: dict[str, str] = {}
    for name, *values in ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape("".join(values)))
    return out


def unseen(attrs: dict[str, str], names: str) -> bool:
    """Whether an element isn't shown: what its style, its hidden attributes or a class of that one name say."""
    hidden = attrs.get("hidden", "until-found").strip().lower() != "until-found"
    return hidden or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attrs.get("style", ""))) or not UNSEEN_NAMES.isdisjoint(names.lower().split())


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order. Of open elements only block containers are remembered, so tags that are never
    closed do no harm; a closing tag ends the nearest container of its name, and an open p ends at any block's start. The
    names of html and body speak of the whole page and aren't read, nor are those of the outermost article or main, which
    undoes what the names of containers around it say, but not nav, aside and the like, nor what is hidden. The head ends
    where a block begins."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, bool, bool]] = [("", False, False, 0, False, False)]  # name, good, bad, label, bad by more than a name, in article or main
    open_: Counter[str] = Counter()  # names on the stack
    parts: list[str] = []
    linked, in_link, heading, item, head = 0, False, False, False, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not head:
                _, good, bad, label, _, inside = stack[-1]
                out.append(Block(text, linked, inside, good, bad, heading, item, label))
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            if "<" in raw:  # what is left of tags that nothing closes
                raw = BROKEN.sub(" ", raw)
            t = entities.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if in_link:
                linked += len(t.split())

    page, at = page or "", 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        name, closing = name.lower(), bool(m[2])
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            head = name == "head" and not closing or head and name == "html"
            heading = not closing and name in HEADINGS
            item = not closing and name in ("li", "td", "th", "dt", "option")
            if closing:
                if open_[name] and (name != "p" or stack[-1][0] == "p"):
                    while stack[-1][0] != name:
                        open_[stack.pop()[0]] -= 1
                    open_[stack.pop()[0]] -= 1
                continue
            while stack[-1][0] == "p" or (name == "p" or heading) and stack[-1][0] in HEADINGS:  # ends here
                open_[stack.pop()[0]] -= 1
            if name in VOID or (name == "p" or heading) and not m[4]:
                continue
            attrs = attributes(m[4]) if m[4] else {}
            _, good, bad, label, sure, inside = stack[-1]
            names = " ".join(attrs[k] for k in NAMED_BY if k in attrs) if name not in ("html", "body") else ""
            plain = name == "header" and not (good or inside)
            outermost = name in ("article", "main") and not inside
            sure = sure or name in BAD_TAGS or plain or unseen(attrs, names)
            bad = sure or (bad or bool(names and BAD_NAMES.search(MODIFIERS.sub(" ", names)))) and not outermost
            good = good or bool(names and GOOD_NAMES.search(names))
            stack.append((name, good, bad, int(attrs["data-y"]) if "data-y" in attrs else label, sure, inside or name in ("article", "main")))
            open_[name] += 1
    rest = page[at:]
    text(OPEN_END.sub("", rest))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density, of it and its neighbours, and its flags."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    dense = np.array([0, *(b.linked / b.words if b.words else 0 for b in found), 0], float)
    flags = np.array([(b.inside, b.good, b.bad, b.heading, b.item) for b in found], float).reshape(n, 5)
    return np.column_stack([words[1:-1], dense[1:-1], words[:-2], dense[:-2], words[2:], dense[2:], flags])


def labelled_pages(seed: int = 7, pages: int = 240) -> list[str]:
    """The small labelled table: pages put together from parts; data-y marks what is main text. Half have containers that
    name themselves; of the rest some name nothing and some call the whole page content, so that words and links decide."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(r.randint(lo, hi)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

    def paras(k: int) -> str:
        return "".join(f"<p>{words(*r.choice([(1, 3), (5, 30), (30, 120), (30, 120)]))}{f' <a href=x>{words(1, 3)}</a> ' + words(8, 30) if r.random() < 0.2 else ''}</p>" for _ in range(k))

    def boiler() -> str:
        return r.choice([
            lambda: f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>",
            lambda: f'<div class="{r.choice(["ad", "advert", "promo", "sponsored"])}">{words(3, 40)}</div>',
            lambda: f"<aside><h3>{words(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul><p>{words(5, 40)}</p></aside>",
            lambda: f'<div class="sidebar">{words(4, 30)}<ul>{links(3)}</ul></div>',
            lambda: f'<div class="cookie-notice"><p>{words(10, 40)}</p><button>{words(1, 2)}</button></div>',
            lambda: f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><p>{words(5, 20)}</p></form>",
            lambda: f'<div class="comments"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(5, 80)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>",
            lambda: f"<div><ul>{links(r.randint(3, 8))}</ul></div>",
            lambda: f"<div><a href=x>{words(2, 6)}</a> | <a href=y>{words(1, 4)}</a></div>",
            lambda: f"<header><h1>{words(1, 3)}</h1><p>{words(3, 8)}</p></header>",
        ])()

    def bare(page: str) -> str:
        page = re.sub(r"<(/?)(?:nav|aside|form|header|footer|button|label|input)\b", r"<\1div", page)
        return re.sub(r' (?:class|id)="[^"]*"', lambda _: r.choice(["", f' class="c{r.randint(1, 40)}"']), page)

    def nameless() -> str:
        text = f"<h1>{words(4, 12)}</h1>" + "".join(f"<p>{words(*r.choice([(12, 30), (30, 120)]))}{f' <a href=x>{words(1, 3)}</a> ' + words(8, 30) if r.random() < 0.2 else ''}</p>" for _ in range(r.randint(2, 9)))
        short = [lambda: f"<div>{words(1, 8)}</div>", lambda: f"<div><p>{words(2, 9)} <a href=x>{words(1, 3)}</a></p></div>", lambda: f"<table><tr><td><a href=x>{words(1, 4)}</a></td><td>{words(1, 3)}</td></tr></table>"]
        around = [f"<div><ul>{links(r.randint(3, 9))}</ul></div>", *[r.choice([*short, lambda: bare(f"<nav><ul>{links(4)}</ul></nav>")])() for _ in range(r.randint(2, 5))]]
        cut = r.randint(1, len(around))
        wrap = r.choice(['<div data-y="1">{}</div>', '<section data-y="1">{}</section>', '<div class="c7" data-y="1">{}</div>', '<table><tr><td data-y="1">{}</td></tr></table>'])
        whole = "".join(around[:cut]) + wrap.format(text) + "".join(around[cut:]) + f"<div><p>&copy; {words(2, 8)}</p></div>"
        return r.choice(['<body>{}</body>', '<body><div class="content">{}</div></body>', '<body><div id="main">{}</div></body>']).format(whole)

    out = []
    for n in range(pages):
        if n % 2:
            out.append(nameless())
            continue
        body = f"<h1>{words(2, 9)}</h1>" + paras(r.randint(1, 9))
        if r.random() < 0.3:
            body += f"<h2>{words(1, 5)}</h2><ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(3)) + f"</ul><blockquote>{words(5, 40)}</blockquote>" + paras(2)
        if r.random() < 0.4:
            cut = r.choice(['<div class="ad" data-y="0">{}</div>', '<aside data-y="0"><p>{}</p></aside>', '<div class="share" data-y="0"><a href=x>{}</a></div>', '<section id="comments" data-y="0"><p>{}</p></section>'])
            body += cut.format(words(2, 30)) + (paras(2) if r.random() < 0.5 else "")
        wrap = r.choice(['<article data-y="1">{}</article>', '<main data-y="1">{}</main>', '<div class="content" data-y="1">{}</div>', '<div id="x" data-y="1">{}</div>', '<div class="post" data-y="1">{}</div>'])
        if "id=\"x\"" in wrap:
            body = re.sub(r"<p>[a-z]+(?: [a-z]+){0,7}</p>", "", body)  # without a name, short blocks can't be told
        out.append("<body>" + "".join(boiler() for _ in range(r.randint(1, 4))) + wrap.format(body) + "".join(boiler() for _ in range(r.randint(1, 3))) + f"<footer><p>&copy; {words(2, 15)}</p></footer></body>")
    return out


class Tree:
    """A decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4):
        self.p, self.column = float(y.mean()), None
        if depth and len(y) >= 2 * least and 0 < self.p < 1:
            best = (2 * self.p * (1 - self.p) - 1e-9, None, None)
            for c in range(x.shape[1]):
                order = np.argsort(x[:, c], kind="stable")
                v, hits = x[order, c], np.cumsum(y[order])
                n = np.arange(1, len(y))
                cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
                if cut.any():
                    left, right = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
                    g = np.where(cut, (2 * n * left * (1 - left) + 2 * (len(y) - n) * right * (1 - right)) / len(y), 1)
                    k = int(g.argmin())
                    if g[k] < best[0]:
                        best = (g[k], c, (v[k] + v[k + 1]) / 2)
            if best[1] is not None:
                _, self.column, self.cut = best
                low = x[:, self.column] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(x), self.p >= 0.5)
        low = x[:, self.column] <= self.cut
        out = np.zeros(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


@lru_cache(maxsize=1)
def tree() -> Tree:
    found = [blocks(p) for p in labelled_pages()]
    return Tree(np.concatenate([features(b) for b in found]), np.array([x.label for b in found for x in b]))


def main_texts(pages: list[str | None], model: Tree) -> list[str]:
    """The main text of each page; the pages' blocks are classified together."""
    found = [blocks(p) for p in pages]
    kept = model.predict(np.concatenate([features(b) for b in found])) if any(found) else np.zeros(0, bool)
    out, at = [], 0
    for b in found:
        out.append("\n".join(x.text for x, k in zip(b, kept[at : at + len(b)], strict=True) if k))
        at += len(b)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id_col, url, text and n_chars for every row of pages. The tree is fitted once, on the driver."""
    model, kinds = tree(), dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url, "text", "n_chars"])

    return pages.select(id_col, url, html).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url}` string, text string, n_chars long")


def op9_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages", "page_id", "url", "html"))
