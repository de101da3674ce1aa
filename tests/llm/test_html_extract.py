import html
import re

import numpy as np
import pytest

from quire.llm import boosting, dom, html_extract
from tests.llm.hand_pages import PAGES


@pytest.fixture(scope="module")
def extractor():
    return html_extract.standard()


PROSE = "The quick brown fox, as they say, jumped over a lazy dog. It did so twice, and then it slept. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy now</div>
<article><h1>A  title &amp; more</h1><p>{PROSE}<b>bold</b>text.<br><p>{PROSE * 2}<div class="ad">Buy  more</div>
<p>{PROSE}&copy; &eacute;&#33;</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Gamma</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>Nice post, thanks.</p></div></section>
<form><input name=q><button>Send</button></form><footer>&copy; 2020 Site</footer></body></html>"""
TEXT = "\n".join(
    ["A title & more", f"{PROSE}boldtext.", " ".join((PROSE * 2).split()), f"{PROSE}© é!"]
)


def test_page(extractor):
    assert extractor.texts([PAGE]) == [TEXT]


def test_blanks_between_inline_elements(extractor):
    page = f"<article><p>{PROSE}<b>one</b> <i>two</i>\n<em>three</em><b>four</b></p><p>{PROSE}<a href='/x'>a</a> <a href='/y'>b</a> end.</p><p>{PROSE}<span class='advert'>Buy</span> now</p></article>"
    assert extractor.texts([page]) == [f"{PROSE}one two threefour\n{PROSE}a b end.\n{PROSE}now"]


def test_edges(spark, extractor):
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("<", ""), 4: ("<!-- <p>x</p>", ""), 5: ("<script>only", ""),
        6: (f"<article><p>{PROSE}</p><p>{PROSE}</p><p>cut &amp", f"{PROSE.strip()}\n{PROSE.strip()}\ncut &"),
        7: (f"<article><p>{PROSE}<p>{PROSE}</art", f"{PROSE.strip()}\n{PROSE.strip()}"),
    }
    rows = [(i, f"http://{i}", h, "clash") for i, (h, _) in cases.items()] + [(2, "http://2", "", "clash")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(spark, table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars, r.url) == (cases[r.page_id][1], len(cases[r.page_id][1]), f"http://{r.page_id}")
    assert html_extract.extract(spark, table.limit(0)).count() == 0


def test_deep_and_long_pages(extractor):
    deep = "<div>" * 5000 + f"<p>{PROSE}</p>"
    long = "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>"
    assert len(extractor.texts([deep, long])[1]) == 3000 * len(PROSE) - 1


def by_rule(page: str) -> str:
    """The main text of a page of the table, by what its markup says."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<div class=\"ad\">.*?</div>", "\0", inner)
    inner = re.sub(r"</?(p|h[1-6]|div|ul|li)\b[^>]*>", "\0", inner.replace("<br>", " "))
    blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"</?[a-zA-Z][^>]*>", "", inner).split("\0"))
    return "\n".join(b for b in blocks if b)


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    want = {r.page_id: (by_rule(r.html), r.url) for r in pages.collect()}
    got = {r.page_id: (r.text, r.url) for r in html_extract.extract(spark, pages).collect()}
    assert len(want) == 250 and got == want


def test_hand_labelled_pages(extractor):
    found = kept = total = 0
    for name, (page, blocks) in PAGES.items():
        got = extractor.texts([page])[0].split("\n")
        assert len(set(blocks) - set(got)) <= 1, name
        found += sum(len(b) for b in blocks if b in got)
        kept += sum(map(len, got))
        total += sum(map(len, blocks))
    assert found >= 0.97 * total and found >= 0.99 * kept


def test_null_ids(spark):
    table = spark.createDataFrame([(None, None, PAGE), (None, "u", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.text) for r in html_extract.extract(spark, table).collect() if r.url) == [(None, "u", "")]


def test_held_out_accuracy(extractor):
    right = total = 0
    for k in range(120):
        tree, labels = html_extract.labelled(html_extract._Writer(5_000_000 + k).page())
        kept = extractor.kept(tree, extractor.trees.margin(dom.features(tree, extractor.weights)))
        for i, text in enumerate(tree.texts):
            total += len(text.strip())
            right += len(text.strip()) * (kept[i] == labels[i])
    assert right >= 0.97 * total


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = 9
        parents = [0] + [int(rng.integers(0, i)) for i in range(1, n)]
        margins = rng.normal(size=n) * 2
        best, chosen = -np.inf, None
        for bits in range(1 << n):
            keep = [(bits >> i) & 1 for i in range(n)]
            if keep[0] and all(keep[parents[i]] or not keep[i] for i in range(1, n)):
                value = sum(-np.logaddexp(0, -m if k else m) for m, k in zip(margins, keep))
                if value > best:
                    best, chosen = value, keep
        assert html_extract.decode(parents, margins).tolist() == [bool(k) for k in chosen]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 16, (4000, 5)).astype(np.uint8)
    labels = ((rows[:, 0] > 7) ^ (rows[:, 3] > 4)).astype(float)
    assert ((boosting.fit(rows, labels).margin(rows) > 0) == labels).mean() > 0.97
