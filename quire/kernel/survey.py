"""Judging whole files: what parses, what a rewrite changes, and how failures group."""

from __future__ import annotations

import re
from typing import Any

from . import files, writer
from .values import PdfError, PdfString, Stream, TruncatedHistory, get, kind_of

MODES = (("table", "table", False), ("stream", "stream", False), ("objstm", "stream", True))


def try_parse(data: bytes) -> tuple[files.Document | None, str | None]:
    """The document with every object parsed, or the first error's message."""
    try:
        document = files.parse(data)
        for number, generation, _ in document.live():
            document.get(number, generation)
        if not isinstance(document.catalog(), dict):
            return None, "the catalog is no dictionary"
    except PdfError as error:
        return None, str(error)
    return document, None


def normalise(message: str) -> str:
    """A message with its numbers and names blanked, so that equal failures group."""
    message = re.sub(r"0x[0-9a-fA-F]+", "0xN", message)
    message = re.sub(r"/[A-Za-z][A-Za-z0-9]*", "/Name", message)
    return re.sub(r"\d+(?!x)", "N", message)


def flatten(value: Any, path: str = "") -> list[tuple[str, str, str]]:
    """(path, kind, text) of a value and all inside it; /Length of streams is left out."""
    out: list[tuple[str, str, str]] = []
    waiting: list[tuple[str, Any]] = [(path, value)]
    while waiting:
        at, item = waiting.pop()
        kind = kind_of(item)
        text = ""
        if isinstance(item, Stream):
            text = item.raw.hex()
            waiting.extend((f"{at}/{k}", v) for k, v in item.dict.items() if k != "Length")
        elif isinstance(item, dict):
            waiting.extend((f"{at}/{k}", v) for k, v in item.items())
        elif isinstance(item, list):
            text = str(len(item))
            waiting.extend((f"{at}[{k}]", v) for k, v in enumerate(item))
        elif isinstance(item, PdfString):
            text = f"{item.form}:{item.data.hex()}"
        else:
            text = repr(item) if item is not None else ""
        out.append((at, kind, text))
    return sorted(out)


def same(one: Any, other: Any) -> bool:
    """Whether two values flatten to the same, without flattening them."""
    waiting = [(one, other)]
    while waiting:
        a, b = waiting.pop()
        if a is b:
            continue
        if type(a) is not type(b):
            return False
        if isinstance(a, Stream):
            if a.raw != b.raw:
                return False
            a, b = ({k: v for k, v in x.dict.items() if k != "Length"} for x in (a, b))
        if isinstance(a, dict):
            if a.keys() != b.keys():
                return False
            waiting.extend((v, b[k]) for k, v in a.items())
        elif isinstance(a, list):
            if len(a) != len(b):
                return False
            waiting.extend(zip(a, b))
        elif a != b and repr(a) != repr(b):
            return False
        elif isinstance(a, float) and repr(a) != repr(b):
            return False
    return True


def first_difference(before: files.Document, after: files.Document) -> str | None:
    """Where the written document differs from its source; None if nowhere."""
    for number, generation, value in before.collect():
        other = after.get(number, generation)
        if not same(value, other):
            found = sorted(set(flatten(value)) ^ set(flatten(other)))[0]
            return f"{number} {generation}{found[0]}"
        for side in (value, other):
            if isinstance(side, Stream) and before.resolve(get(side.dict, "Length")) not in (len(side.raw), None):
                return f"{number} {generation}/Length"
    return None


def round_trip(data: bytes, xref: writer.Form, object_streams: bool) -> tuple[str, str | None]:
    """(outcome, detail): ok, mismatch, write-failed, reparse-failed, unreadable or not-measurable."""
    return rewrite_outcome(*try_parse(data), xref, object_streams)


def rewrite_outcome(before: files.Document | None, problem: str | None, xref: writer.Form, object_streams: bool) -> tuple[str, str | None]:
    """The outcome for a document that :func:`try_parse` has read."""
    if before is None:
        return "unreadable", problem
    try:
        written = writer.rewrite(before, xref=xref, object_streams=object_streams)
    except TruncatedHistory as error:
        return "not-measurable", str(error)
    except PdfError as error:
        return "write-failed", str(error)
    after, problem = try_parse(written)
    if after is None:
        return "reparse-failed", problem
    where = first_difference(before, after)
    return ("ok", None) if where is None else ("mismatch", where)
