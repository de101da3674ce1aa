"""Main-text extraction by boosted trees over DOM nodes and hierarchical decoding.

A node's label is whether its subtree holds main text.  The trees are fitted
on pages that are written here with known labels (a bounded number, seeded).
Attribute tokens enter by their log-odds in the training pages.  The decoding
picks the likeliest labelling in which a node is kept only if its parent is,
so no text survives below a dropped menu and no kept text hangs in the air.
The inline content of a block is one unit with one label, so a paragraph
doesn't lose a short link; only inline elements whose own attribute tokens
speak against them are units of their own.
"""

from __future__ import annotations

import random
from collections import Counter
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting, dom
from .common import pick, to_batch

TRAINING_PAGES = 1200
#: Pages whose nodes are scored together, and bytes of html after which a batch ends early.
BATCH_PAGES, BATCH_BYTES = 256, 4 << 20
#: Marks main text in training pages; removed before features are computed.
_MARK = "\ue000"

_CONTENT = "content article post entry story body text main page single prose markdown".split()
_FRAMES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topbar toc pagination pager skip links".split(),
    "header": "header masthead top banner branding logo site title bar".split(),
    "footer": "footer bottom copyright legal colophon imprint credits".split(),
    "aside": "sidebar side aside widget related recommended popular trending archive tags author bio more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner commercial dfp adsense teaser outbrain".split(),
    "notice": "notice cookie consent gdpr alert warning popup modal overlay newsletter subscribe signup paywall message toast".split(),
    "comments": "comments comment discussion respond reply replies disqus thread responses feedback reader".split(),
    "form": "form search login contact newsletter subscribe signup".split(),
    "share": "share social sharing follow buttons tools meta byline".split(),
}


class _Writer:
    """Writes one training page with a random structure."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.style = self.rng.choice(("plain", "semantic", "classes", "classes", "both", "both"))

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        out = []
        for _ in range(rng.randint(low, high)):
            word = "".join(rng.choice(("ta", "re", "mi", "no", "el", "shu", "or", "an", "ing", "é", "ver")) for _ in range(rng.randint(1, 4)))
            out.append(word + rng.choices(("", ",", ".", ";"), (80, 8, 10, 1))[0])
        return " ".join(out).capitalize()

    def attrs(self, names: list[str]) -> str:
        rng = self.rng
        if self.style in ("plain", "semantic") or rng.random() < 0.15:
            return ""
        name = rng.choice(names)
        if rng.random() < 0.4:
            name += rng.choice("-_") + rng.choice(("wrap", "box", "inner", "area", "block", "list", "container", rng.choice(names)))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def tag(self, semantic: str) -> str:
        return semantic if self.style in ("semantic", "both") and self.rng.random() < 0.85 else "div"

    def menu(self) -> str:
        rng = self.rng
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(rng.randint(2, 12))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice((" | ", " ", "\n")).join(items)

    def short(self) -> str:
        rng = self.rng
        kind = rng.random()
        if kind < 0.35:
            return self.words(2, 14)
        if kind < 0.7:
            return f"<p>{self.words(3, 25)}</p>"
        return f'<p>{self.words(2, 10)} <a href="#">{self.words(1, 3)}</a></p>'

    def frame(self, kind: str) -> str:
        rng = self.rng
        names = _FRAMES[kind]
        if kind == "nav":
            t = self.tag("nav")
            return f"<{t}{self.attrs(names)}>{self.menu()}</{t}>"
        if kind == "header":
            t = self.tag("header")
            inner = rng.choice((f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', self.words(1, 6)))
            return f"<{t}{self.attrs(names)}>{inner}{self.menu() if rng.random() < 0.4 else ''}</{t}>"
        if kind == "footer":
            t = self.tag("footer")
            inner = rng.choice((f"&copy; {rng.randint(1990, 2030)} {self.words(1, 18)}", f"<p>&copy; {self.words(2, 12)}</p>", self.menu(), self.words(4, 30)))
            return f"<{t}{self.attrs(names)}>{inner}</{t}>"
        if kind == "aside":
            t = self.tag("aside")
            inner = f"<h3>{self.words(1, 4)}</h3>" + (self.menu() if rng.random() < 0.6 else self.short())
            return f"<{t}{self.attrs(names)}>{inner}</{t}>"
        if kind == "form":
            fields = '<input name="q">' + (f"<label>{self.words(1, 3)}</label>" if rng.random() < 0.5 else "")
            return f"<form{self.attrs(names)}>{fields}<button>{self.words(1, 2)}</button>{self.words(0, 8) if rng.random() < 0.3 else ''}</form>"
        if kind == "comments":
            t = self.tag("section")
            one = lambda: f"<{rng.choice(('div', 'li', 'article'))} class=\"comment\"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>"
            return f'<{t} {rng.choice(("class", "id"))}="{rng.choice(names)}"><h3>{self.words(1, 3)}</h3>{"".join(one() for _ in range(rng.randint(1, 5)))}</{t}>'
        always = f' class="{rng.choice(names)}"' if kind in ("ad", "notice", "share") else self.attrs(names)
        inner = "".join(self.short() for _ in range(rng.randint(1, 2)))
        return f"<div{always}>{inner}</div>"

    def prose(self, low: int, high: int) -> str:
        """A paragraph's text, every run of it marked."""
        words = self.words(low, high) + _MARK
        if self.rng.random() < 0.2:
            words += f' <a href="/x">{self.words(1, 3)}{_MARK}</a> {self.words(1, 8)}{_MARK}'
        if self.rng.random() < 0.2:
            inline = self.rng.choice(("b", "i", "em", "strong", "span"))
            words = f"<{inline}>{self.words(1, 4)}{_MARK}</{inline}> {words}"
        return words

    def content(self) -> str:
        rng = self.rng
        out = [f"<h1>{self.words(2, 12)}{_MARK}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{self.prose(1, rng.choice((4, 15, 60, 150)))}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.77:
                out.append(f"<p><b>{self.prose(2, 40)}<br>")
            elif kind < 0.82:
                out.append(f"<h2>{self.words(1, 8)}{_MARK}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.prose(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.prose(5, 40)}</blockquote>")
            elif kind < 0.92:
                cells = "".join(f"<tr><td>{self.words(1, 4)}{_MARK}</td><td>{rng.randint(1, 999)}{_MARK}</td></tr>" for _ in range(rng.randint(2, 5)))
                out.append(f"<table>{cells}</table>")
            elif kind < 0.94:
                out.append(f"<div>{self.prose(10, 90)}</div>")
            else:
                out.append(self.frame(rng.choice(("ad", "ad", "share", "aside", "notice", "form"))))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        before = [self.frame(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.55]
        after = [self.frame(k) for k in ("share", "comments", "aside", "ad", "notice", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        t = rng.choice(("article", "main", "div")) if self.style != "plain" else rng.choice(("div", "article"))
        names = self.attrs(_CONTENT) if t == "div" or rng.random() < 0.4 else ""
        inner = f"<{t}{names}>{self.content()}</{t}>" if rng.random() < 0.93 else self.content()
        inside_after = after[:-1] if rng.random() < 0.2 else []
        if inside_after:
            inner = f"<div>{inner}{''.join(inside_after)}</div>"
            after = after[-1:]
        if rng.random() < 0.4:
            inner = f"<div{self.attrs(['wrapper', 'container', 'page', 'outer', 'layout', 'row'])}>{inner}</div>"
        head = f"<head><meta charset=utf-8><title>{self.words(2, 9)}</title><style>p{{}}</style><script>x()</script></head>" if rng.random() < 0.8 else ""
        text = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{inner}{''.join(after)}</body></html>"
        return text[: rng.randint(len(text) // 2, len(text))] if rng.random() < 0.08 else text


def labelled(html: str) -> tuple[dom.Dom, np.ndarray]:
    """The page without its marks, and whether each subtree held one."""
    tree = dom.parse(html)
    labels = np.zeros(len(tree.tags))
    for i in range(len(tree.tags) - 1, 0, -1):
        if _MARK in tree.texts[i]:
            labels[i] = 1
            tree.texts[i] = tree.texts[i].replace(_MARK, "") or " "
        if labels[i]:
            labels[tree.parents[i]] = 1
    return tree, labels


class Extractor:
    def __init__(self, weights: dict[str, float], trees: boosting.BoostedTrees):
        self.weights, self.trees = weights, trees

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page; nodes of all pages are scored at once."""
        parsed = [dom.parse(x) for x in pages]
        rows = [dom.features(t, self.weights) for t in parsed]
        scores = self.trees.margin(np.concatenate(rows)) if rows else np.empty(0)
        out, at = [], 0
        for tree, own in zip(parsed, rows):
            out.append(dom.blocks(tree, self.kept(tree, scores[at : at + len(own)])))
            at += len(own)
        return out

    def kept(self, tree: dom.Dom, margins: np.ndarray) -> np.ndarray:
        return decode(tree.parents, pool_inline(tree, margins, self.weights))


#: Log-odds of an attribute token from which an inline element stands for itself.
AGAINST = -1.0


def pool_inline(tree: dom.Dom, margins: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Give all inline nodes of a block the mean margin of its text runs, weighted by length."""
    n = len(tree.tags)
    unit = [-1] * n
    for i in range(1, n):
        if tree.tags[i] in dom.INLINE:
            p = tree.parents[i]
            unit[i] = unit[p] if unit[p] >= 0 else p
            if tree.attrs[i] and any(weights.get(t, 0) < AGAINST for t in dom.tokens(tree.attrs[i])):
                unit[i] = i
    total, size = [0.0] * n, [0] * n
    values = margins.tolist()
    for i in range(1, n):
        if unit[i] >= 0 and tree.tags[i] == "#text":
            length = len(tree.texts[i].strip())
            total[unit[i]] += length * values[i]
            size[unit[i]] += length
    for i in range(1, n):
        if unit[i] >= 0 and size[unit[i]]:
            values[i] = total[unit[i]] / size[unit[i]]
    return np.array(values)


def decode(parents: list[int], margins: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which every kept node has a kept parent.

    Upwards, a subtree is worth more kept or dropped; downwards, what is worth
    keeping stays as long as its parent stays.  The root is always kept.
    """
    n = len(parents)
    own = np.logaddexp(0, margins)
    dropped = (-own).tolist()  # log(1 - p), summed over the subtree below
    kept = (margins - own).tolist()  # log p, plus the better of each child
    for i in range(n - 1, 0, -1):
        p = parents[i]
        dropped[p] += dropped[i]
        kept[p] += max(kept[i], dropped[i])
    stays = np.zeros(n, bool)
    stays[0] = True
    for i in range(1, n):
        stays[i] = stays[parents[i]] and kept[i] > dropped[i]
    return stays


def train(pages: int = TRAINING_PAGES, seed: int = 0) -> Extractor:
    """Fit on ``pages`` written pages; the same arguments give the same extractor."""
    examples = [labelled(_Writer(seed * 1_000_003 + k).page()) for k in range(pages)]
    good, bad = Counter(), Counter()
    for tree, labels in examples:
        for i, attrs in enumerate(tree.attrs):
            if attrs:
                (good if labels[i] else bad).update(set(dom.tokens(attrs)))
    weights = {}
    for token in good.keys() | bad.keys():
        if good[token] + bad[token] >= 3:
            weights[token] = log((good[token] + 0.5) / (bad[token] + 0.5))
    rows = np.concatenate([dom.features(t, weights) for t, _ in examples])
    return Extractor(weights, boosting.fit(rows, np.concatenate([x for _, x in examples])))


@lru_cache(maxsize=2)
def standard() -> Extractor:
    return train()


def extract(spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (id, url, text, n_chars), one row for each input row.

    Null or empty html has an empty text.  Blocks are joined in page order by
    newlines, white space inside a block is single, character references are
    decoded, br is white space.  Html is read whole; a cut-off tag at its end
    is no text.  Rows that repeat give the same result; other columns aren't
    read.
    """
    extractor = spark.sparkContext.broadcast(standard())
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            texts = extractor.value.texts([h for *_, h in held])
            return to_batch([(i, u, t, len(t)) for (i, u, _), t in zip(held, texts)], schema)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append((row[0], row[1], row[2] or ""))
                size += len(held[-1][2])
                if len(held) >= BATCH_PAGES or size >= BATCH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    work = pick(pages, id=id_col, url=url_col, html=html_col).mapInArrow(run, "id long, url string, text string, n_chars long")
    return work.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
