"""A tolerant HTML parser into flat node arrays, and features of the nodes."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

from .boosting import BINS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "#text a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements that an open p ends at.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section summary table ul".split()
)
#: What a new element of a kind closes, and where the search for it stops.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: An open p further out than one of these isn't closed from inside.
_P_SCOPE = frozenset("article aside body button caption div fieldset footer form header html li main nav object section table td th".split())

_TAG = re.compile(
    r"""<(?:!--(?:(?P<comment>.*?)(?:-->|\Z))|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
    r"""|(?P<bogus>[!?/][^>]*(?:>|\Z))|(?P<cut>/?[a-zA-Z][^>]*\Z))""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Dom:
    """Nodes in page order: tag, parent, attribute tokens, and the text of text nodes."""

    __slots__ = ("attrs", "parents", "tags", "texts")

    def __init__(self):
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [0]
        self.attrs: list[str] = [""]
        self.texts: list[str] = [""]

    def add(self, tag: str, parent: int, attrs: str, text: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attrs.append(attrs)
        self.texts.append(text)
        return len(self.tags) - 1


def parse(html: str) -> Dom:
    """Every element and text run; scripts, styles, comments and cut-off tags give no text."""
    dom = Dom()
    tags = dom.tags
    stack = [0]
    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        stop = found.start() if found else end
        if stop > at:
            text = html[at:stop]
            if not text.isspace():
                dom.add("#text", stack[-1], "", unescape(text) if "&" in text else text)
            else:
                dom.add("#text", stack[-1], "", " ")
        if not found:
            break
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    del stack[k:]
                    break
            continue
        if name in _ENDS_P:
            _close(stack, tags, ("p",), _P_SCOPE)
        elif name in _CLOSES:
            _close(stack, tags, *_CLOSES[name])
        attrs = found["attrs"]
        node = dom.add(name, stack[-1], attrs if attrs and "=" in attrs else "", "")
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return dom


def _close(stack: list[int], tags: list[str], names, scope) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = tags[stack[k]]
        if tag in names:
            del stack[k:]
            return
        if tag in scope:
            return


def tokens(attrs: str) -> list[str]:
    """Lower-case words of class, id, role and the like."""
    if not attrs:
        return []
    out = []
    for _, a, b, c in _ATTR.findall(attrs):
        out += [w.lower() for w in _WORD.findall(a or b or c)]
    return out


GROUPS = (
    ("nav", "menu"), ("header",), ("footer", "address"), ("aside",), ("form", "fieldset", "input", "button", "select", "textarea", "label", "option"),
    ("script", "style", "noscript", "template", "iframe", "svg"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("a",), ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("article", "main"), ("section", "div"), ("table", "tbody", "thead", "tr", "td", "th"),
    ("figure", "img", "figcaption", "picture"), ("#text",), ("head", "title", "meta", "link", "base"), ("html", "body", "#page"),
)
_GROUP_OF = {tag: k for k, group in enumerate(GROUPS) for tag in group}
_OUTSIDE = frozenset((0, 1, 2, 3, 4, 5, 16))
_INSIDE = 11
NUMERIC = (
    "depth", "text", "link_share", "nodes", "text_per_node", "paragraphs", "commas", "children", "place", "siblings", "share_of_parent",
    "twins", "position", "parent_links", "token_high", "token_low", "above_high", "above_low", "outside_above", "inside_above", "end_marks",
    "group", "parent_group", "words_per_run",
)
FEATURES = len(NUMERIC) + len(GROUPS)


def _log(x: float) -> int:
    return min(BINS - 1, int(x).bit_length())


def features(dom: Dom, weights: dict[str, float]) -> np.ndarray:
    """One row of small integers for each node, from one pass down and one up."""
    tags, parents, texts = dom.tags, dom.parents, dom.texts
    n = len(tags)
    text, links, nodes, paragraphs, commas, ends, runs = ([0] * n for _ in range(7))
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parents[i]].append(i)
    total = 0
    before = [0] * n
    for i in range(n):
        before[i] = total
        if texts[i]:
            own = texts[i]
            size = len(own.strip())
            text[i] = size
            total += size
            if size:
                runs[i] = 1
                commas[i] = own.count(",") + own.count(";")
                ends[i] = own.count(". ") + (own.rstrip()[-1:] in ".!?")
    for i in range(n - 1, 0, -1):
        tag, p = tags[i], parents[i]
        if tag == "a":
            links[i] = text[i]
        elif tag == "p":
            paragraphs[i] += 1
        text[p] += text[i]
        links[p] += links[i]
        nodes[p] += nodes[i] + 1
        paragraphs[p] += paragraphs[i]
        commas[p] += commas[i]
        ends[p] += ends[i]
        runs[p] += runs[i]
    depth, outside, inside = [0] * n, [0] * n, [0] * n
    high, low, above_high, above_low = [8] * n, [8] * n, [8] * n, [8] * n
    group = [_GROUP_OF.get(t, -1) for t in tags]
    rows = np.zeros((n, FEATURES), np.uint8)
    top, last = BINS - 1, max(total, 1)
    place = [0] * n
    twins = [0] * n
    for kids in children:
        counts: dict[str, int] = {}
        for k, i in enumerate(kids):
            place[i] = k
            counts[tags[i]] = counts.get(tags[i], 0) + 1
        for i in kids:
            twins[i] = counts[tags[i]]
    out = []
    for i in range(n):
        p = parents[i]
        if i:
            depth[i] = depth[p] + 1
            outside[i] = outside[p] or group[p] in _OUTSIDE
            inside[i] = inside[p] or group[p] == _INSIDE
            above_high[i], above_low[i] = max(above_high[p], high[p]), min(above_low[p], low[p])
        if dom.attrs[i]:
            known = [weights[t] for t in tokens(dom.attrs[i]) if t in weights]
            if known:
                high[i] = max(8, min(top, round(8 + 2 * max(known))))
                low[i] = min(8, max(0, round(8 + 2 * min(known))))
        size, parent_size = text[i], text[p]
        out.append(
            (
                min(top, depth[i]), _log(size), top * links[i] // size if size else 0, _log(nodes[i]), _log(size // (nodes[i] + 1)),
                _log(paragraphs[i]), min(top, commas[i] * 300 // size) if size else 0, _log(len(children[i])), _log(place[i]),
                _log(len(children[p])), top * size // parent_size if parent_size else 0, _log(twins[i]), top * before[i] // last,
                top * links[p] // parent_size if parent_size else 0, high[i], low[i], above_high[i], above_low[i], int(outside[i]),
                int(inside[i]), min(top, ends[i] * 300 // size) if size else 0, min(top, group[i] + 1), min(top, group[p] + 1),
                _log(size // runs[i]) if runs[i] else 0,
            )
        )
    rows[:, : len(NUMERIC)] = out
    marked = np.array(group)
    known = np.flatnonzero(marked >= 0)
    rows[known, len(NUMERIC) + marked[known]] = 1
    return rows


def blocks(dom: Dom, kept: np.ndarray) -> str:
    """Text of the kept text nodes, a line for each block, white space made single."""
    tags, parents = dom.tags, dom.parents
    out: list[str] = []
    line: list[str] = []
    block_of = [0] * len(tags)
    held = -1
    for i in range(1, len(tags)):
        tag, p = tags[i], parents[i]
        block_of[i] = block_of[p] if tag in INLINE else i
        if tag not in INLINE:
            held = -1  # a block begins here, so what comes after belongs to another line
        elif tag == "br":
            line.append(" ")
        elif tag == "#text":
            if block_of[i] != held:
                out.append("".join(line))
                line, held = [], block_of[i]
            if kept[i]:
                line.append(dom.texts[i])
            elif dom.texts[i] == " ":  # blank text between inline elements keeps words apart
                line.append(" ")
    out.append("".join(line))
    lines = (" ".join(x.split()) for x in out)
    return "\n".join(x for x in lines if x)
