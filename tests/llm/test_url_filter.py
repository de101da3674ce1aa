import duckdb
import pytest

from quire.llm import common, url_filter

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/De/1", "http://a.net", "http://a.net/", "http://net/x", "http://xnet/x",
    "http://a.example.net/en/1", "http://a.example.net/enx", "https://b.example.com/de/5?x=1#y", "https://example.com/de", "http://c.org/fr/",
    "http://c.org?u=http://d.net/", "http://e.org#/fr/", "a://b://c/d", "http://ÀÉ.Org/fr/ü/7.html", "http://x.io/a/b/c/d/e/f", "http://x.io//a///b",
    "http://x.io/0123abcd-ef", "http://x.io/9.PHP",
]
URLS += [f"http://casino-win.x.com/en/{i}" for i in range(30)] + [f"http://casino-win.x.com/fr/{i}.html" for i in range(30)]
URLS += [f"http://blog.x.com/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}/page" for i in range(60)] + ["http://blog.x.com/about"] * 40
URLS += [f"http://s.example.com/{lang}/{i}" for lang in ("de", "en", "es") for i in range(9)]
#: Branches that differ from the fifth segment on, and hundreds of segments.
URLS += [f"http://deep.casino.io/2024/05/12/section/slug{i}/x" for i in range(30)] + ["http://deep.io/" + "a/" * 15 + "b"]
URLS += [f"http://d.example.com/{lang}/b/c/d/{kind}/{i}" for lang in ("de", "en") for kind in ("spam", "news") for i in range(8)]
URLS += ["http://dup.net/de/a"] * 3 + ["http://long.org/" + "y" * 70_000 + "/z"]


@pytest.mark.parametrize("rows", [50_000, 2])
def test_equals_sql(spark, rows, monkeypatch):
    monkeypatch.setattr(common.hot_join, "__kwdefaults__", {**common.hot_join.__kwdefaults__, "rows": rows})
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r) for r in url_filter.judge(spark, table).collect()}
    assert len(got) == len(URLS)
    con = duckdb.connect()
    con.register("pages", table.select("page_id", "url").toPandas())
    want = {r[0]: r for r in con.sql(url_filter.oracle()).fetchall()}
    assert got == want


def test_cases(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {URLS[r.page_id]: r for r in url_filter.judge(spark, table).collect()}
    assert (got[None].host, got[None].path, got[None].verdict) == ("", "", "allow")
    assert (got["HTTP://WWW.Example.COM/De/1"].host, got["HTTP://WWW.Example.COM/De/1"].path) == ("www.example.com", "/De/1")
    assert got["http://a.net"].rule is None
    assert (got["http://net/x"].rule, got["http://net/x"].verdict) == ("net/", "block")
    assert got["http://xnet/x"].rule is None
    assert (got["http://a.example.net/en/1"].rule, got["http://a.example.net/en/1"].verdict) == ("example.net/en/", "allow")
    assert got["http://a.example.net/enx"].rule == "net/"
    assert got["https://b.example.com/de/5?x=1#y"].rule == "example.com/de/"
    assert got["https://example.com/de"].rule is None
    assert (got["http://c.org?u=http://d.net/"].host, got["http://c.org?u=http://d.net/"].path) == ("c.org", "")
    assert got["http://e.org#/fr/"].rule is None
    assert got["http://casino-win.x.com/en/3"].verdict == "block"
    assert got["http://blog.x.com/tag/wordaa/page"].template == "/tag/{*}/page"
    assert got["http://blog.x.com/about"].template == "/about"
    assert got["http://s.example.com/en/1"].verdict == "allow"
    assert got["http://deep.casino.io/2024/05/12/section/slug3/x"].template == "/{n}/{n}/{n}/section/{*}/x"
    assert got["http://deep.io/" + "a/" * 15 + "b"].template == "/" + "a/" * 15 + "b"
    assert url_filter.judge(spark, table.limit(0)).count() == 0


def test_given_labels(spark):
    urls = [f"http://shop.io/{kind}/item{chr(97 + i)}" for kind in ("offers", "guides") for i in range(20)] + ["http://shop.io/offers/new", "http://shop.io/guides/new", None]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(i, i < 20) for i in range(40) if i % 2] + [(1, False), (None, True), (3, None)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark, table, labels=spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert [got[i] for i in (0, 1, 20, 21, 40, 41, 42)] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    assert url_filter.judge(spark, table, labels=spark.createDataFrame([], "page_id long, bad boolean")).count() == len(urls)
