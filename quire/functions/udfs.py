"""Column functions and table functions over PDF bytes and cos columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import cosjson, filters, fonts, lexer, writer
from ..kernel import files as kernel
from ..kernel import inflate as inflater
from ..kernel.lexer import Cursor, TokenReader
from ..kernel.values import Name, PdfError, PdfString, Stream, kind_of


def _arrow(function: Callable[..., Any], kind: T.DataType, arrow_type: pa.DataType):
    """An Arrow function that calls ``function`` for each row; errors of a file and null inputs give null."""

    def run(*columns):
        out = []
        for values in zip(*(c.to_pylist() for c in columns)):
            try:
                out.append(None if None in values else function(*values))
            except Exception:  # noqa: BLE001 - a value that can't be read is null
                out.append(None)
        return pa.array(out, arrow_type)

    if function.__code__.co_argcount == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return F.arrow_udf(one, kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(two, kind)


def _entry(cos: str, key: str) -> str | None:
    value = cosjson.loads(cos)
    value = value.dict if isinstance(value, Stream) else value
    return _shown(value.get(key)) if isinstance(value, dict) else None


def _entries(cos: str) -> list[tuple[str, str | None]] | None:
    value = cosjson.loads(cos)
    value = value.dict if isinstance(value, Stream) else value
    return [(str(k), _shown(v)) for k, v in value.items()] if isinstance(value, dict) else None


def _shown(found: Any) -> str | None:
    if found is None:
        return None
    if isinstance(found, (Name, bool, int)):
        return str(found)
    return repr(found) if isinstance(found, float) else cosjson.dumps(found)


def _text(cos: str, key: str) -> str | None:
    value = cosjson.loads(cos)
    found = value.get(key) if isinstance(value, dict) else None
    return found.data.decode("utf-8", "replace") if isinstance(found, PdfString) else None


def _bytes(cos: str) -> bytes | None:
    value = cosjson.loads(cos)
    if isinstance(value, PdfString):
        return value.data
    return filters.decode_stream(value) if isinstance(value, Stream) else None


def _raw(cos: str) -> bytes | None:
    value = cosjson.loads(cos)
    return value.raw if isinstance(value, Stream) else None


def _inflate_differs(data: bytes) -> bool:
    return inflater.differs(data, filters.inflate)


def _encoding_refusal(name: str) -> str | None:
    try:
        filters.encode_stream(b"", name)
    except PdfError as error:
        return str(error)
    return None


#: Syntactic classes of bytes, and the sum of hexadecimal digits' values.
CLASSES = ("whitespace", "newline", "delimiter", "regular", "digit", "octal", "hex", "boundary", "value")
_PREDICATES = (
    lexer.is_whitespace, lexer.is_newline, lexer.is_delimiter, lexer.is_regular, lexer.is_digit, lexer.is_octal_digit, lexer.is_hex_digit,
    lexer.is_token_boundary, lambda b: lexer.hex_value(b) if lexer.is_hex_digit(b) else 0,
)
_WEIGHTS = np.array([[int(p(b)) for b in range(256)] for p in _PREDICATES], np.int64)


def _byte_classes(data: bytes) -> dict[str, int]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return dict(zip(CLASSES, (_WEIGHTS @ counts).tolist()))


def _real(value: float) -> str:
    return writer.format_real(value)


def _font_format(data: bytes) -> str:
    return fonts.sniff(data).format


def _subset_tag(data: bytes) -> str:
    return fonts.subset_tag(data)


def _inflate(data: bytes) -> bytes:
    return filters.inflate(data)


#: A dictionary's entry as text; null where it is missing or null.
cos_entry = _arrow(_entry, T.StringType(), pa.string())
#: All entries of a dictionary as a map of text; one reading of the column for all of them.
cos_entries = _arrow(_entries, T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string()))
#: A dictionary's string entry as UTF-8 text.
cos_text = _arrow(_text, T.StringType(), pa.string())
#: A string's bytes, or a stream's decoded data.
cos_bytes = _arrow(_bytes, T.BinaryType(), pa.binary())
#: A stream's bytes as they stand.
cos_raw = _arrow(_raw, T.BinaryType(), pa.binary())
#: Whether the library and the second inflater disagree.
inflate_differs = _arrow(_inflate_differs, T.BooleanType(), pa.bool_())
#: Why a filter isn't written; null if it is.
encoding_refusal = _arrow(_encoding_refusal, T.StringType(), pa.string())
#: Counts of a text's bytes by class.
byte_classes = _arrow(
    _byte_classes, T.StructType([T.StructField(c, T.LongType()) for c in CLASSES]), pa.struct([(c, pa.int64()) for c in CLASSES])
)
#: A double as a PDF real.
format_real = _arrow(_real, T.StringType(), pa.string())
#: A font program's format, null where it is none that can be embedded.
font_format = _arrow(_font_format, T.StringType(), pa.string())
subset_tag = _arrow(_subset_tag, T.StringType(), pa.string())
#: Strict zlib data, null where it is damaged.
inflate = _arrow(_inflate, T.BinaryType(), pa.binary())


class PdfTokens:
    """Table function: tokens of bare syntax as (seq, kind, value, offset)."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        reader = TokenReader(Cursor(bytes(content or b"")))
        for seq in range(len(content or b"") + 1):
            try:
                token = reader.take()
            except PdfError as error:
                yield seq, "error", str(error), error.offset
                return
            if token.kind == "eof":
                return
            yield seq, token.kind, None if token.value is None else str(token.value), token.offset


class PdfObjects:
    """Table function: a file's live objects as (number, generation, kind, cos)."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            document = kernel.parse(bytes(content or b""))
        except PdfError:
            return
        for number, generation, _ in document.live():
            try:
                value = document.get(number, generation)
            except PdfError:
                continue
            yield number, generation, kind_of(value), cosjson.dumps(value)


class PdfXrefSection:
    """Table function: the entries of the section at an offset as (number, kind, a, b)."""

    def eval(self, content: bytes, offset: int, origin: int) -> Iterator[tuple]:
        try:
            section = kernel.read_section(bytes(content or b""), origin or 0, offset)
        except PdfError:
            return
        for number, entry in section.entries.items():
            yield number, *entry


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL by the names below."""
    columns = {
        "pdf_entry": cos_entry, "pdf_text": cos_text, "pdf_bytes": cos_bytes, "pdf_real": format_real, "pdf_font_format": font_format,
        "pdf_subset_tag": subset_tag, "pdf_inflate": inflate,
    }
    for name, function in columns.items():
        spark.udf.register(name, function)
    tables = (
        ("pdf_tokens", PdfTokens, "seq int, kind string, value string, offset long"),
        ("pdf_objects", PdfObjects, "object_number long, generation int, kind string, cos string"),
        ("pdf_xref_section", PdfXrefSection, "object_number long, kind string, a long, b long"),
    )
    for name, handler, schema in tables:
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
