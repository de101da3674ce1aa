import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from quire.llm import media
from quire.llm.common import Scratch

TEXTS = [None, "", " ", "a", "x" * 192, "x" * 193, "ünï\x00cödé" * 50, "same", "same", "z" * 100_000]


def test_documents(spark):
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(7, "same", "c")], "doc_id long, text string, digest string")
    rows = media.document_media(spark, table).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        blob = media.write_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert media.read_png(blob).tobytes() == payload
    assert len({r.feature for r in rows if r.doc_id in (7, 8)}) == 1
    assert media.document_media(spark, table.limit(0)).count() == 0


def test_feature_counts_samples():
    samples = np.zeros((2, 64, 3), np.uint8)
    samples[:, :32, 1] = 200
    assert media.feature_of(samples) == "h2;m0,100000,0;affffffff00000000"


def test_sequence_order_and_captions():
    one, two = "1" * 64, "2" * 64
    page = f"""<p>first <b>text</b><img src='sha256:{one}' alt="an  alt">after</p><script>no</script>
      <figure><img src="sha256:{two}"><figcaption>the &amp; caption</figcaption></figure><p>last<img src="http://other">"""
    assert media.parse_html(page) == [
        (0, "text", "first text", None, None),
        (1, "media", None, one, "an alt"),
        (2, "text", "after", None, None),
        (3, "media", None, two, "the & caption"),
        (4, "text", "last", None, None),
        (5, "media", None, hashlib.sha256(b"http://other").hexdigest(), None),
    ]
    held = "".join(f'<img src="{u}">' for u in ("data:image/png;base64,YWI=", "data:,ab", "DATA:text/plain,%61b", "data:;base64,YW I=", "data:;base64,*", ""))
    assert [x[3] for x in media.parse_html(held)] == [hashlib.sha256(b"ab").hexdigest()] * 4 + [hashlib.sha256(b"").hexdigest()]
    assert media.parse_html(None) == media.parse_html("") == []


def test_unresolved_references_keep_their_place(spark):
    pages = spark.createDataFrame([(1, f'<img src="sha256:{"a" * 64}"><p>t<img src="sha256:{"b" * 64}">'), (2, None)], "page long, html string")
    records = spark.createDataFrame([("b" * 64, 5)], "digest string, size int")
    found = media.resolve(media.parse_sequences(pages, id_col="page", html_col="html"), records, id_col="page").collect()
    assert sorted((r.page, r.position, r.digest[0], r["size"]) for r in found) == [(1, 0, "a", None), (1, 2, "b", 5)]


def test_real_pages_keep_all_text_in_order(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    records = spark.createDataFrame([], "digest string, size int")
    sequences = media.parse_sequences(pages, id_col="page_id", html_col="html")
    got = {r.page_id: r["items"] for r in media.interleave(sequences, records, id_col="page_id", scratch=Scratch(spark, "media")).collect()}
    for r in pages.collect():
        items = got[r.page_id]
        assert [x.position for x in items] == list(range(len(items))) and all(x.kind == "text" and x.text for x in items)
        bare = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", " ", r.html)
        words = html.unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        assert sorted("".join(words)) == sorted("".join(" ".join(x.text for x in items).split()))


@pytest.mark.parametrize("hot", [1000, 1])
def test_sequences_are_whole_again(spark, hot, monkeypatch):
    monkeypatch.setattr(media, "HOT", hot)
    a, b = "a" * 64, "b" * 64
    told = [
        (1, f'<p>one<img src="sha256:{b}" alt="x">two<img src="sha256:{a}">' + "".join(f'<p>{k}<img src="sha256:{b}">' for k in range(20)) + "<p>end"),
        (1, "<p>only text"), (1, "<p>only text"), (2, None), (3, f'<img src="sha256:{b}">'), (None, "<p>no id"),
    ]
    pages = spark.createDataFrame(told, "page long, html string").repartition(3)
    records = spark.createDataFrame([(b, 5), (a[:-1] + "0", 6), ("c" * 64, 7)], "digest string, size int")
    sequences = media.parse_sequences(pages, id_col="page", html_col="html")
    got = media.interleave(sequences, records, id_col="page", scratch=Scratch(spark, "media")).collect()
    want = [(i, [(*x, (5,) if x[3] == b else None) for x in media.parse_html(page)]) for i, page in told]
    plain = [(r.page, [(*x[:5], None if x.record is None else tuple(x.record)) for x in r["items"]]) for r in got]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
