"""PDF values as Python values, and the errors of every layer.

bool, int, float and None are themselves; arrays are lists; dictionaries are
dicts with str keys in file order; the rest are the classes below.  A real
stays a float even if integral, so integers and reals never mix.
"""

from __future__ import annotations

from typing import Any, NamedTuple


class Name(str):
    """A name's text; ``raw`` has its bytes where the text can't give them back."""

    raw: bytes | None

    def __new__(cls, text: str, raw: bytes | None = None):
        made = super().__new__(cls, text)
        made.raw = raw
        return made


class PdfString(NamedTuple):
    data: bytes
    form: str = "literal"  # or hex


class Ref(NamedTuple):
    number: int
    generation: int = 0


class Stream(NamedTuple):
    dict: dict[str, Any]
    raw: bytes


class Keyword(str):
    """A bare word that isn't a value."""


class PdfError(Exception):
    """An error of one file: a layer's name, a message and perhaps a byte offset."""

    layer = "pdf"

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message if offset is None else f"{message} (at byte {offset})")
        self.offset = offset


class LexError(PdfError):
    layer = "lex"


class ParseError(PdfError):
    layer = "parse"


class FilterError(PdfError):
    layer = "filter"


class WriteError(PdfError):
    layer = "write"


class TruncatedHistory(PdfError):
    layer = "history"


class Refusal(PdfError):
    """A rule or several that input breaks; ``violations`` has (clause, message, object number or None)."""

    layer = "refusal"

    def __init__(self, violations: list[tuple[str, str, int | None]]):
        super().__init__("; ".join(f"{clause}: {message}" for clause, message, _ in violations))
        self.violations = violations


def kind_of(value: Any) -> str:
    """One of the ten kinds."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "real"
    for cls, kind in ((Name, "name"), (PdfString, "string"), (Ref, "ref"), (Stream, "stream"), (list, "array"), (dict, "dict")):
        if isinstance(value, cls):
            return kind
    raise TypeError(f"not a PDF value: {type(value).__name__}")


def get(mapping: dict[str, Any], key: str, default: Any = None) -> Any:
    """A dictionary's entry; one that holds null counts as absent."""
    value = mapping.get(key)
    return default if value is None else value


def references(value: Any):
    """Every reference inside a value."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, Ref):
            yield at
        elif isinstance(at, Stream):
            waiting.append(at.dict)
        elif isinstance(at, dict):
            waiting.extend(at.values())
        elif isinstance(at, list):
            waiting.extend(at)
