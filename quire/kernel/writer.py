"""Values to bytes: objects, whole files, and updates behind a file."""

from __future__ import annotations

import math
import re
from decimal import Decimal
from functools import lru_cache
from typing import Any, Literal

from .files import Document, Entry
from .lexer import DELIMITERS
from .values import Name, PdfString, Ref, Stream, WriteError, get, references

#: Fixed value: the second line of a file, which marks it as binary.
BINARY_MARK = b"%\xe2\xe3\xcf\xd3\n"
FREE = Entry("free", 0, 65535)
#: Entries that belong to a cross-reference stream's form, not to a trailer.
STREAM_ONLY = ("Type", "Index", "W", "Length", "Filter", "DecodeParms", "F", "FFilter", "FDecodeParms", "DL")

Form = Literal["table", "stream"]


def format_real(value: float) -> str:
    """The shortest digits that read back equal, without exponent and always with a period."""
    if not math.isfinite(value):
        raise WriteError(f"{value} is no PDF number")
    if value == 0:
        return "0.0"
    text = format(Decimal(repr(value)), "f")
    return text if "." in text else text + ".0"


_PLAIN_NAME = frozenset(range(0x21, 0x7F)) - DELIMITERS - {0x23}


def write_name(name: str) -> bytes:
    return _write_name(name.raw if isinstance(name, Name) and name.raw is not None else name.encode("utf-8"))


@lru_cache(maxsize=4096)
def _write_name(raw: bytes) -> bytes:
    if 0 in raw:
        raise WriteError("a name can't hold the byte 0")
    body = b"".join(bytes([b]) if b in _PLAIN_NAME or b >= 0x80 else b"#%02X" % b for b in raw)
    return b"/" + body


_STRING_ESCAPE = re.compile(rb"[()\\]|[^\x20-\x7e]")
_STRING_ESCAPES = {bytes([b]): b"\\%03o" % b for b in range(256)} | {bytes([b]): b"\\" + bytes([b]) for b in b"()\\"}


def write_string(value: PdfString) -> bytes:
    if value.form == "hex":
        return b"<" + value.data.hex().encode() + b">"
    return b"(" + _STRING_ESCAPE.sub(lambda m: _STRING_ESCAPES[m[0]], value.data) + b")"


_SCALARS: dict[type, Any] = {Ref: lambda r: b"%d %d R" % r, int: lambda n: b"%d" % n, Name: write_name}


def _flat(value: Any) -> bytes | None:
    """The text of a scalar of the commonest types, or of a container that holds no others; None for all else."""
    kind = type(value)
    if kind in _SCALARS:
        return _SCALARS[kind](value)
    if kind is list:
        kinds = set(map(type, value))
        if not kinds <= _SCALARS.keys():
            return None
        return b"[" + b" ".join(map(_SCALARS[kinds.pop()], value) if len(kinds) == 1 else [_SCALARS[type(v)](v) for v in value]) + b"]"
    return b"<<>>" if kind is dict and not value else None


def write_object(value: Any) -> bytes:
    """A direct object; streams are indirect and refused."""
    out: list[bytes] = []
    waiting: list[Any] = [value]
    while waiting:
        at = waiting.pop()
        if type(at) is bytes:
            out.append(at)
        elif isinstance(at, list):
            text = _flat(at)
            if text is not None:
                out.append(text)
                continue
            parts: list[Any] = [b"["]
            for k, item in enumerate(at):
                parts += [b" ", item] if k else [item]
            waiting.extend(reversed([*parts, b"]"]))
        elif isinstance(at, dict):
            parts, whole = [b"<<"], True
            for key, item in at.items():
                text = _flat(item)
                whole &= text is not None
                parts += [write_name(key) + b" ", item if text is None else text]
            parts.append(b">>")
            if whole:
                out += parts
            else:
                waiting.extend(reversed(parts))
        elif at is None:
            out.append(b"null")
        elif isinstance(at, bool):
            out.append(b"true" if at else b"false")
        elif isinstance(at, int):
            out.append(b"%d" % at)
        elif isinstance(at, float):
            out.append(format_real(at).encode())
        elif isinstance(at, Name):
            out.append(write_name(at))
        elif isinstance(at, PdfString):
            out.append(write_string(at))
        elif isinstance(at, Ref):
            out.append(b"%d %d R" % at)
        else:
            raise WriteError(f"{type(at).__name__} is no direct object")
    return b"".join(out)


def write_indirect(number: int, generation: int, value: Any) -> bytes:
    """``N G obj``, the value and ``endobj``; a stream's /Length is made right."""
    return b"%d %d obj\n%s\nendobj\n" % (number, generation, _write_body(value))


def _write_body(value: Any) -> bytes:
    if isinstance(value, Stream):
        return write_object({**value.dict, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    return write_object(value)


def xref_entry(offset: int, generation: int, kind: bytes) -> bytes:
    if offset >= 10**10 or generation >= 10**5:
        raise WriteError(f"offset {offset} or generation {generation} doesn't fit an entry")
    return b"%010d %05d %s \n" % (offset, generation, kind)


def runs(numbers) -> list[tuple[int, int]]:
    """(first, count) of every run of consecutive numbers."""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([n, 1])
    return [(a, b) for a, b in out]


def width_for(value: int) -> int:
    return max(1, (value.bit_length() + 7) // 8)


def build_xref_stream(entries: dict[int, Entry], size: int, extra: dict[str, Any]) -> Stream:
    codes = {"free": 0, "in-use": 1, "compressed": 2}
    widths = [1, *(width_for(max((e[k] for e in entries.values()), default=0)) for k in (1, 2))]
    ranges = runs(entries)
    rows = b"".join(
        b"".join(v.to_bytes(w, "big") for v, w in zip((codes[entries[n].kind], entries[n].a, entries[n].b), widths))
        for first, count in ranges
        for n in range(first, first + count)
    )
    carried = {k: v for k, v in extra.items() if k not in STREAM_ONLY and k != "Size"}
    entries_of = {"Type": Name("XRef"), "Size": size, "W": widths, "Index": [x for r in ranges for x in r], **carried}
    return Stream(entries_of, rows)


def partition_for_object_stream(objects, encrypt: int | None):
    """(compressible, plain): streams, other generations, bare references and the encryption dictionary stay plain."""
    packed, plain = [], []
    for item in objects:
        number, generation, value = item
        keep_out = isinstance(value, (Stream, Ref)) or generation != 0 or number == encrypt
        (plain if keep_out else packed).append(item)
    return packed, plain


def build_object_stream(objects) -> Stream:
    bodies = [write_object(value) + b"\n" for _, _, value in objects]
    pairs, at = [], 0
    for (number, _, _), body in zip(objects, bodies):
        pairs.append(b"%d %d" % (number, at))
        at += len(body)
    header = b" ".join(pairs) + b"\n"
    return Stream({"Type": Name("ObjStm"), "N": len(bodies), "First": len(header)}, header + b"".join(bodies))


def highest_reference(objects, trailer: dict[str, Any]) -> int:
    values = [trailer, *(value for _, _, value in objects)]
    return max((r.number for v in values for r in references(v)), default=0)


def write_file(
    objects: list[tuple[int, int, Any]], trailer: dict[str, Any], *, version: str = "2.0", xref: Form = "table", object_streams: bool = False
) -> bytes:
    """A whole file of (number, generation, value); the same input gives the same bytes.

    A value that several objects in a row share is put into text once.
    """
    if not re.fullmatch(r"[12]\.[0-9]", version):
        raise WriteError(f"{version} is no version")
    if object_streams and xref != "stream":
        raise WriteError("object streams need a cross-reference stream")
    objects = sorted(objects, key=lambda o: o[0])
    numbers = [n for n, _, _ in objects]
    if numbers and numbers[0] < 1:
        raise WriteError(f"object number {numbers[0]} can't be written")
    for a, b in zip(numbers, numbers[1:]):
        if a == b:
            raise WriteError(f"object {a} was given twice")
    fresh = max([0, *numbers[-1:], highest_reference(objects, trailer)]) + 1 if xref == "stream" else 0
    compressed: dict[int, Entry] = {}
    container = None
    if object_streams:
        container, fresh = fresh, fresh + 1
        encrypt = trailer.get("Encrypt")
        packed, plain = partition_for_object_stream(objects, encrypt.number if isinstance(encrypt, Ref) else None)
        if packed:
            compressed = {n: Entry("compressed", container, k) for k, (n, _, _) in enumerate(packed)}
            objects = sorted([*plain, (container, 0, build_object_stream(packed))], key=lambda o: o[0])
    out = [f"%PDF-{version}\n".encode(), BINARY_MARK]
    at = sum(map(len, out))
    placed: dict[int, tuple[int, int]] = {}
    before: Any = out
    for number, generation, value in objects:
        if value is not before:
            before, text = value, _write_body(value)
        body = b"%d %d obj\n%s\nendobj\n" % (number, generation, text)
        placed[number] = at, generation
        out.append(body)
        at += len(body)
    if xref == "stream":
        highest = fresh
        in_use = {n: Entry("in-use", *where) for n, where in placed.items()}
        entries = {0: FREE, **{n: FREE for n in range(1, highest + 1)}, **in_use, **compressed, fresh: Entry("in-use", at, 0)}
        carried = {k: v for k, v in trailer.items() if k not in ("Prev", "XRefStm")}
        out.append(write_indirect(fresh, 0, build_xref_stream(entries, highest + 1, carried)))
    else:
        highest = max([0, *numbers[-1:]])
        out.append(b"xref\n0 %d\n" % (highest + 1) + xref_entry(0, 65535, b"f"))
        for n in range(1, highest + 1):
            out.append(xref_entry(*placed[n], b"n") if n in placed else xref_entry(0, 65535, b"f"))
        carried = {k: v for k, v in trailer.items() if k not in (*STREAM_ONLY, "Prev", "XRefStm", "Size")}
        out.append(b"trailer\n" + write_object({"Size": highest + 1, **carried}) + b"\n")
    out.append(b"startxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def rewrite(document: Document, *, xref: Form = "table", object_streams: bool = False) -> bytes:
    """The document written anew; refused where its history couldn't be read."""
    document.require_history()
    return write_file(document.collect(), document.trailer, version=document.header_version, xref=xref, object_streams=object_streams)


_LAST_START = re.compile(rb"startxref[ \r\n]+(\d+)")


def find_last_startxref(data: bytes) -> int:
    at = data.rfind(b"startxref")
    found = _LAST_START.match(data, at) if at >= 0 else None
    if not found:
        raise WriteError("the file has no readable startxref")
    return int(found[1])


def append_update(
    original: bytes,
    objects: list[tuple[int, int, Any]],
    deleted: list[tuple[int, int]],
    *,
    previous: int,
    previous_size: int,
    trailer: dict[str, Any],
    origin: int = 0,
    xref: Form = "table",
    stream_number: int | None = None,
) -> bytes:
    """The original bytes with an update behind them; only what changed is written.

    ``deleted`` holds (number, generation of the free entry).  Objects stand
    in the order given.
    """
    begin = b"" if original.endswith((b"\n", b"\r")) else b"\n"
    tail, _ = update_tail(
        len(original) + len(begin) - origin, objects, deleted, previous=previous, previous_size=previous_size, trailer=trailer, xref=xref,
        stream_number=stream_number,
    )
    updated = original + begin + tail
    assert_original_intact(original, updated)
    return updated


def update_tail(
    at: int, objects: list[tuple[int, int, Any]], deleted: list[tuple[int, int]], *, previous: int, previous_size: int,
    trailer: dict[str, Any], xref: Form = "table", stream_number: int | None = None,
) -> tuple[bytes, int]:
    """The bytes of an update that begins at an offset behind the header, and the offset of its section."""
    if not objects and not deleted:
        raise WriteError("an update shall name an object")
    named = [n for n, _, _ in objects] + [n for n, _ in deleted]
    if len(set(named)) != len(named) or min(named) < 1:
        raise WriteError("an update shall name each object once, by a positive number")
    out = bytearray()
    entries: dict[int, Entry] = {n: Entry("free", 0, g) for n, g in deleted}
    for number, generation, value in objects:
        entries[number] = Entry("in-use", at + len(out), generation)
        out += write_indirect(number, generation, value)
    start = at + len(out)
    if xref == "stream":
        if stream_number is None or stream_number in entries:
            raise WriteError("a cross-reference stream needs an object number of its own")
        entries[stream_number] = Entry("in-use", start, 0)
    size = max(previous_size, max(entries) + 1)
    carried = {k: v for k, v in trailer.items() if k not in (*STREAM_ONLY, "Size", "Prev", "XRefStm")}
    carried = {"Size": size, **carried, "Prev": previous}
    if xref == "stream":
        out += write_indirect(stream_number, 0, build_xref_stream(entries, size, carried))
    else:
        out += b"xref\n"
        for first, count in runs(entries):
            out += b"%d %d\n" % (first, count)
            for n in range(first, first + count):
                out += xref_entry(entries[n].a, entries[n].b, b"n" if entries[n].kind == "in-use" else b"f")
        out += b"trailer\n" + write_object(carried) + b"\n"
    out += b"startxref\n%d\n%%%%EOF\n" % start
    return bytes(out), start


def assert_original_intact(original: bytes, updated: bytes) -> None:
    if not updated.startswith(original):
        raise WriteError("an update shall leave the original bytes as they are")


def append_update_to(
    document: Document, objects, deleted, *, xref: Form = "table", trailer: dict[str, Any] | None = None
) -> bytes:
    """An update behind a parsed file; its newest section becomes the previous one."""
    numbers = [*document.entries, *(n for n, _, _ in objects), *(n for n, _ in deleted), document.size - 1]
    return append_update(
        document.data, objects, deleted, previous=find_last_startxref(document.data), previous_size=document.size,
        trailer=document.trailer if trailer is None else trailer, origin=document.origin, xref=xref, stream_number=max(numbers) + 1,
    )


