"""Interleaved document sequences: text and media references in order.

HTML becomes an ordered sequence of text and media structs; a media struct
names its payload by digest: the one that its source names, the digest of what
a data URL holds, or else the digest of the source itself, under which a crawl
stores what it fetched.  A join on the digest resolves the payload's record, and the sequence is put together again by position, so captions and
places stay aligned whether a payload is found or not.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, heavier, pick

#: Samples of one image row: 64 pixels of 3 channels, 8 bits each.
ROW_BYTES = 192
#: Digests that a task remembers in order to store a payload once; beyond that copies are stored again and merged later.
SEEN = 50_000
#: Digests whose records are broadcast.
HOT = 1000

ITEM = "struct<position:int, kind:string, text:string, digest:string, caption:string>"
_PNG = b"\x89PNG\r\n\x1a\n"
_BREAKING = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol br hr table tr td th section article header footer figure blockquote pre".split())
_MEDIA = frozenset("img video audio source embed".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))


def digest_of(source: str) -> str:
    """The digest under which a reference's payload is stored."""
    named = re.fullmatch(r"sha256:([0-9a-f]{64})", source.lower())
    if named:
        return named[1]
    held = re.match(r"data:[^,]*,", source, re.I)
    if not held:
        return hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest()
    body = unquote_to_bytes(source[held.end() :])
    if held[0].lower().endswith(";base64,"):
        try:
            body = base64.b64decode(re.sub(rb"\s", b"", body) + b"==")
        except binascii.Error:
            body = b""
    return hashlib.sha256(body).hexdigest()


class _Sequence(HTMLParser):
    """Gathers text runs and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def close_text(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKING:
            self.close_text()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.close_text()
            self.caption = []
        elif tag in _MEDIA:
            values = dict(attrs)
            source = (values.get("src") or "").strip()
            if source:
                self.close_text()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append(["media", None, digest_of(source), " ".join((values.get("alt") or "").split()) or None])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        if tag in _BREAKING:
            self.close_text()
        if tag == "figure":
            self.figure = None

    def end_caption(self):
        caption = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure and caption:
            for k in self.figure:
                self.items[k][3] = caption
        elif caption:  # a caption of no figure is text
            self.items.append(["text", caption, None, None])

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    def done(self) -> list[tuple]:
        self.close()
        if self.caption is not None:
            self.end_caption()
        self.close_text()
        return [(k, *item) for k, item in enumerate(self.items)]


def parse_html(html: str | None) -> list[tuple]:
    """(position, kind, text, digest, caption) in order; nothing for null or empty html."""
    parser = _Sequence()
    parser.feed(html or "")
    return parser.done()


def parse_sequences(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """(id, items): an ordered array of text and media structs for each row."""

    def rows():
        def one(row):
            yield row["id"], [dict(zip(("position", "kind", "text", "digest", "caption"), x)) for x in parse_html(row["html"])]

        return one

    return arrow_rows(pick(pages, id=id_col, html=html_col), f"`{id_col}` long, items array<{ITEM}>", rows)


def resolve(sequences: DataFrame, media: DataFrame, *, id_col: str, scratch: Scratch | None = None) -> DataFrame:
    """(row, id, position, digest, caption, *record) for every media reference.

    ``media`` has one row for each digest.  The ``HOT`` digests that most
    references name are broadcast with their records; of any other digest a
    task gets not many more than (references / HOT) rows.  A reference without payload
    keeps its place with null record columns.
    """
    scratch = scratch or Scratch(sequences.sparkSession, "media")
    refs = sequences.select(F.col(f"`{id_col}`"), F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = refs.select(F.col(f"`{id_col}`"), F.col("item.position").alias("position"), F.col("item.digest").alias("ref"), F.col("item.caption").alias("caption"))
    counts = scratch.keep(refs.groupBy(F.col("ref").alias("hot")).agg(F.count(F.lit(1)).alias("n_refs")).where("n_refs > 1"), "counts")
    hot = F.broadcast(counts.where(heavier(counts, "n_refs", HOT)).select("hot"))
    records = F.broadcast(media.join(hot, F.col("digest") == F.col("hot"), "left_semi"))
    frequent = refs.join(hot, F.col("ref") == F.col("hot"), "left_semi").join(records, F.col("ref") == F.col("digest"), "left")
    other = refs.join(hot, F.col("ref") == F.col("hot"), "left_anti").join(media, F.col("ref") == F.col("digest"), "left")
    return frequent.unionByName(other).drop("digest").withColumnRenamed("ref", "digest")


def interleave(sequences: DataFrame, media: DataFrame, *, id_col: str, scratch: Scratch) -> DataFrame:
    """(id, items): every sequence with its media resolved, one row for each row of ``sequences``.

    An item is a struct of position, kind, text, digest, caption and record; a
    record is a struct of the other columns of ``media``, null for text and for
    a reference without payload.  Only references pass the join on the digest
    (see :func:`resolve`).  Items meet again by row and are put in order by
    position, so a task holds one document's items at a time; a sequence
    without items stays, empty.
    """
    numbered = scratch.keep(
        sequences.select(F.monotonically_increasing_id().alias("s_row"), F.col(f"`{id_col}`").alias("s_id"), "items"), "sequences"
    )
    records = media.select("digest", F.struct(*[F.col(f"`{c}`") for c in media.columns if c != "digest"]).alias("record"))
    found = resolve(numbered, records, id_col="s_row", scratch=scratch)
    other = numbered.select("s_row", "s_id", F.explode_outer(F.filter("items", lambda x: x["kind"] != "media")).alias("item"))
    kind = records.schema["record"].dataType
    own = [F.col(f"item.{c}").alias(c) for c in ("position", "kind", "text", "digest", "caption")]
    texts = other.select("s_row", "s_id", *own, F.lit(None).cast(kind).alias("record"))
    shown = found.select(
        "s_row", F.lit(None).cast(texts.schema["s_id"].dataType).alias("s_id"), "position", F.lit("media").alias("kind"),
        F.lit(None).cast("string").alias("text"), "digest", "caption", "record",
    )
    item = F.when(F.col("position").isNotNull(), F.struct("position", "kind", "text", "digest", "caption", "record"))
    whole = texts.unionByName(shown).groupBy("s_row").agg(F.first("s_id", ignorenulls=True).alias(id_col), F.sort_array(F.collect_list(item)).alias("items"))
    return whole.drop("s_row")


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, padded with spaces to a positive multiple of the row."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def write_png(payload: bytes) -> bytes:
    """A PNG of 64 pixels across whose 8-bit RGB samples are the payload."""
    height = len(payload) // ROW_BYTES
    rows = np.zeros((height, ROW_BYTES + 1), np.uint8)  # filter type 0 in front of each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW_BYTES)
    header = struct.pack(">IIBBBBB", ROW_BYTES // 3, height, 8, 2, 0, 0, 0)
    chunks = ((b"IHDR", header), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b""))
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def read_png(blob: bytes) -> np.ndarray:
    """The samples of a PNG that :func:`write_png` made, as (height, 64, 3)."""
    at, data, height = len(_PNG), [], 0
    while at < len(blob):
        n, kind = struct.unpack_from(">I4s", blob, at)
        body = blob[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", blob, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW_BYTES + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return rows[:, 1:].reshape(height, ROW_BYTES // 3, 3)


def feature_of(samples: np.ndarray) -> str:
    """Height, mean of each channel in thousandths, and a 64-bit brightness hash of the columns."""
    height = samples.shape[0]
    sums = samples.sum(axis=(0, 1), dtype=np.int64)
    columns = samples.sum(axis=(0, 2), dtype=np.int64)
    bright = columns * len(columns) > columns.sum()
    means = ",".join(str(int(s) * 1000 // (height * samples.shape[1])) for s in sums)
    return f"h{height};m{means};a{int(np.packbits(bright).tobytes().hex(), 16):016x}"


def store_media(docs: DataFrame, *, text_col: str) -> DataFrame:
    """(digest, blob): every text's payload as PNG, about once for each task."""

    def rows():
        seen: set[bytes] = set()

        def one(row):
            payload = payload_of(row["text"])
            digest = hashlib.sha256(payload)
            if digest.digest() not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest.digest())
                yield digest.hexdigest(), write_png(payload)

        return one

    return arrow_rows(pick(docs, text=text_col), "digest string, blob binary", rows)


RECORD = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def inspect_media(media: DataFrame) -> DataFrame:
    """One record for each digest, computed from the stored bytes as read back."""

    def rows():
        def one(row):
            samples = read_png(row["blob"])
            payload = samples.tobytes()
            yield (
                row["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                len(row["blob"]), hashlib.sha256(row["blob"]).hexdigest(), feature_of(samples),
            )

        return one

    records = arrow_rows(media.select("digest", "blob"), RECORD, rows)
    rest = [c for c in records.columns if c != "digest"]
    return records.groupBy("digest").agg(*[F.min(c).alias(c) for c in rest])


def illustrated(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, html): a page for each document that shows its payload as a figure."""

    def rows():
        def one(row):
            n = len((row["text"] or "").encode())
            digest = hashlib.sha256(payload_of(row["text"])).hexdigest()
            yield row["id"], n, f'<article><p>{n} bytes</p><figure><img src="sha256:{digest}" alt=""><figcaption>{n}</figcaption></figure></article>'

        return one

    return arrow_rows(pick(docs, id=id_col, text=text_col), f"`{id_col}` long, n_bytes long, html string", rows)


def document_media(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, name it in an interleaved page and resolve it again.

    Return (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature), one row for each input row.  A null
    text is an empty one.  The stored media are a table in the shared folder;
    equal texts share one record.  The columns are read from the resolved
    sequences of :func:`interleave`.  The caption carries n_bytes through the
    page, which shows that captions stay with their media.
    """
    scratch = Scratch(spark, "media")
    media = scratch.keep(store_media(docs, text_col=text_col), "media")
    records = scratch.keep(inspect_media(media), "records")
    pages = illustrated(docs, id_col=id_col, text_col=text_col)
    sequences = parse_sequences(pages, id_col=id_col, html_col="html")
    whole = interleave(sequences, records, id_col=id_col, scratch=scratch)
    shown = whole.select(F.col(f"`{id_col}`"), F.filter("items", lambda x: x["kind"] == "media")[0].alias("item"))
    return shown.select(
        F.col(f"`{id_col}`"), F.col("item.caption").cast("long").alias("n_bytes"),
        *[F.col(f"item.record.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")],
    )
