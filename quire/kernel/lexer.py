"""Bytes to tokens to objects."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from functools import lru_cache
from typing import Any, NamedTuple

from .values import Keyword, LexError, Name, ParseError, PdfString, Ref, Stream

EOF = -1
#: Digits of the longest integer that is read, and the highest object number that a reference may name.
MOST_DIGITS, HIGHEST = 4000, 2**63 - 1
#: The white-space and delimiter bytes.
WHITESPACE = frozenset(b"\x00\t\n\x0c\r ")
DELIMITERS = frozenset(b"()<>[]{}/%")

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?(?:\d+(\.\d*)?|(\.\d+))")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_STRING_PART = re.compile(rb"[^()\\\r]+")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12, ord("("): 40, ord(")"): 41, ord("\\"): 92}
_HEX = frozenset(b"0123456789abcdefABCDEF")
_NOT_HEX = re.compile(rb"[^0-9a-fA-F]")


def is_whitespace(byte: int) -> bool:
    return byte in WHITESPACE


def is_newline(byte: int) -> bool:
    return byte in (10, 13)


def is_delimiter(byte: int) -> bool:
    return byte in DELIMITERS


def is_regular(byte: int) -> bool:
    return 0 <= byte <= 255 and byte not in WHITESPACE and byte not in DELIMITERS


def is_digit(byte: int) -> bool:
    return 48 <= byte <= 57


def is_octal_digit(byte: int) -> bool:
    return 48 <= byte <= 55


def is_hex_digit(byte: int) -> bool:
    return byte in _HEX


def hex_value(byte: int) -> int:
    return int(chr(byte), 16)


def is_token_boundary(byte: int) -> bool:
    return byte == EOF or byte in WHITESPACE or byte in DELIMITERS


class Cursor:
    """A place in bytes; reading outside them gives EOF, moving outside stops at the ends."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data = data
        self.pos = pos

    def __len__(self) -> int:
        return len(self.data)

    @property
    def at_end(self) -> bool:
        return self.pos >= len(self.data)

    def peek(self, ahead: int = 0) -> int:
        at = self.pos + ahead
        return self.data[at] if 0 <= at < len(self.data) else EOF

    def next(self) -> int:
        byte = self.peek()
        self.advance(1)
        return byte

    def advance(self, count: int) -> None:
        self.seek(self.pos + count)

    def seek(self, pos: int) -> None:
        self.pos = min(max(pos, 0), len(self.data))

    def slice(self, start: int, end: int) -> bytes:
        return self.data[max(start, 0) : max(end, 0)]

    def matches(self, wanted: bytes) -> bool:
        return self.data.startswith(wanted, self.pos)

    def try_consume(self, wanted: bytes) -> bool:
        found = self.matches(wanted)
        if found:
            self.pos += len(wanted)
        return found

    def try_consume_eol(self) -> bool:
        """CR LF, CR or LF, as one marker."""
        return any(self.try_consume(mark) for mark in (b"\r\n", b"\r", b"\n"))

    def skip_whitespace_and_comments(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def skip_whitespace(self) -> None:
        while self.peek() in WHITESPACE:
            self.pos += 1


class Token(NamedTuple):
    kind: str
    value: Any
    offset: int


_OPENERS = {b"<<": "dict-open", b">>": "dict-close"}
_SINGLES = {ord("["): "array-open", ord("]"): "array-close"}


def next_token(cursor: Cursor) -> Token:
    """The next token; kind ``eof`` at the end."""
    cursor.skip_whitespace_and_comments()
    start, byte = cursor.pos, cursor.peek()
    if byte == EOF:
        return Token("eof", None, start)
    if byte in _SINGLES:
        cursor.pos += 1
        return Token(_SINGLES[byte], None, start)
    pair = cursor.data[start : start + 2]
    if pair in _OPENERS:
        cursor.pos += 2
        return Token(_OPENERS[pair], None, start)
    if byte == 0x2F:
        return Token("name", _read_name(cursor), start)
    if byte == 0x28:
        return Token("string", PdfString(_read_literal(cursor), "literal"), start)
    if byte == 0x3C:
        return Token("string", PdfString(_read_hex(cursor), "hex"), start)
    if byte in DELIMITERS:
        raise LexError(f"unexpected {chr(byte)!r}", start)
    if byte in b"+-.0123456789":
        found = _NUMBER.match(cursor.data, start)
        if not found:
            raise LexError("a number without digits", start)
        cursor.pos = found.end()
        if found[1] is None and found[2] is None:
            if len(found[0]) > MOST_DIGITS:
                raise LexError(f"an integer of more than {MOST_DIGITS} digits", start)
            return Token("integer", int(found[0]), start)
        return Token("real", float(found[0]), start)
    cursor.pos = _REGULAR.match(cursor.data, start).end()
    return Token("keyword", Keyword(cursor.data[start : cursor.pos].decode("latin-1")), start)


def _read_name(cursor: Cursor) -> Name:
    found = _REGULAR.match(cursor.data, cursor.pos + 1)
    cursor.pos = found.end()
    return _name_of(found[0])


@lru_cache(maxsize=4096)
def _name_of(written: bytes) -> Name:
    raw = _NAME_ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), written)
    try:
        return Name(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return Name(raw.decode("cp1252", "replace"), raw)


def _read_literal(cursor: Cursor) -> bytes:
    start, data = cursor.pos, cursor.data
    at, depth, out = start + 1, 1, bytearray()
    while True:
        part = _STRING_PART.match(data, at)
        if part:
            out += part[0]
            at = part.end()
        if at >= len(data):
            raise LexError("a literal string has no end", start)
        byte = data[at]
        at += 1
        if byte == 0x28:
            depth += 1
            out.append(byte)
        elif byte == 0x29:
            depth -= 1
            if not depth:
                cursor.pos = at
                return bytes(out)
            out.append(byte)
        elif byte == 0x0D:
            at += data[at : at + 1] == b"\n"
            out.append(0x0A)
        else:
            if at >= len(data):
                raise LexError("a literal string has no end", start)
            byte = data[at]
            at += 1
            if byte in _ESCAPES:
                out.append(_ESCAPES[byte])
            elif is_octal_digit(byte):
                digits = re.compile(rb"[0-7]{1,3}").match(data, at - 1)[0]
                out.append(int(digits, 8) & 0xFF)
                at += len(digits) - 1
            elif byte == 0x0D:
                at += data[at : at + 1] == b"\n"
            elif byte != 0x0A:
                out.append(byte)


def _read_hex(cursor: Cursor) -> bytes:
    start = cursor.pos
    end = cursor.data.find(b">", start)
    if end < 0:
        raise LexError("a hexadecimal string has no end", start)
    body = cursor.data[start + 1 : end]
    digits = body.translate(None, b"\x00\t\n\x0c\r ")
    odd = _NOT_HEX.search(digits)
    if odd:
        raise LexError(f"{chr(odd[0][0])!r} in a hexadecimal string", start + 1 + body.index(odd[0]))
    cursor.pos = end + 1
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class TokenReader:
    """Tokens with look-ahead; while none is held the cursor is right behind the last taken."""

    def __init__(self, cursor: Cursor):
        self.cursor = cursor
        self.held: deque[Token] = deque()

    def peek(self, ahead: int = 0) -> Token:
        while len(self.held) <= ahead:
            self.held.append(next_token(self.cursor))
        return self.held[ahead]

    def take(self) -> Token:
        return self.held.popleft() if self.held else next_token(self.cursor)


_WORDS = {"true": True, "false": False, "null": None}

#: A container in its plain form: no comments, escapes or long numbers.  Each match is a dictionary's key with
#: its value or the value's beginning, an array's item or its beginning, or the end of either.
_GAP, _BREAK = rb"[\x00\t\n\x0c\r ]*+", rb"[\x00\t\n\x0c\r ]++"
_STOP = rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
_PLAIN_REF = rb"(\d{1,18}+)" + _BREAK + rb"(\d{1,9}+)" + _GAP + rb"R" + _STOP
_PLAIN_VALUE = b"|".join(
    (
        rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*+)", _PLAIN_REF,
        rb"\[((?:" + _GAP + rb"[+-]?\d{1,18}+(?=[\x00\t\n\x0c\r \]]))*+)" + _GAP + rb"\]",
        rb"\[((?:" + _GAP + _PLAIN_REF.replace(b"(\\d", b"(?:\\d") + rb")++)" + _GAP + rb"\]",
        rb"([+-]?\d{1,18}+)(?![\d.])", rb"(<<)" + _GAP + rb">>", rb"(<<)", rb"(\[)", rb"([+-]?(?:\d++\.\d*+|\.\d++))", rb"\(([^()\\\r]*+)\)", rb"<([0-9A-Fa-f]*+)>", rb"(true|false|null)" + _STOP,
    )
)
_PLAIN_PAIR = re.compile(_GAP + rb"(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*+)" + _GAP + rb"(?:" + _PLAIN_VALUE + rb")|(>>))")
_PLAIN_ITEM = re.compile(_GAP + rb"(?:()(?:" + _PLAIN_VALUE + rb")|(\]))")
_NAME, _REF, _INTEGERS, _REFS, _INTEGER, _EMPTY, _DICT, _ARRAY, _REAL, _LITERAL, _HEXADECIMAL, _WORD, _CLOSE = 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15
_BLANK = bytes.maketrans(b"\x00R", b"  ")


def _plain_container(data: bytes, at: int) -> tuple[Any, int] | None:
    """A container in its plain form and where it ends; None for all else, which is then read token by token."""
    stack: list[Any] = []
    top: Any = None
    while True:
        in_dict = type(top) is dict
        found = (_PLAIN_PAIR if in_dict else _PLAIN_ITEM).match(data, at)
        if found is None:
            return None
        at, kind = found.end(), found.lastindex
        if kind == _CLOSE:
            if not stack:
                return None
            closed, top = top, stack.pop()
            if top is None:
                return closed, at
            continue
        if kind == _NAME:
            value = _name_of(found[_NAME])
        elif kind == _REF:
            value = Ref(int(found[_REF - 1]), int(found[_REF]))
            if not value.number:
                return None
        elif kind == _INTEGERS:
            value = list(map(int, found[_INTEGERS].translate(_BLANK).split()))
        elif kind == _REFS:
            numbers = list(map(int, found[_REFS].translate(_BLANK).split()))
            value = list(map(Ref, numbers[::2], numbers[1::2]))
            if 0 in numbers[::2]:
                return None
        elif kind == _INTEGER:
            value = int(found[_INTEGER])
        elif kind == _DICT or kind == _EMPTY:
            value = {}
        elif kind == _ARRAY:
            value = []
        elif kind == _REAL:
            value = float(found[_REAL])
        elif kind == _LITERAL:
            value = PdfString(found[_LITERAL], "literal")
        elif kind == _HEXADECIMAL:
            digits = found[_HEXADECIMAL].decode()
            value = PdfString(bytes.fromhex(digits + "0" * (len(digits) % 2)), "hex")
        else:
            value = _WORDS[found[_WORD].decode()]
        if in_dict:
            key = _name_of(found[1])
            if key in top:
                return None
            top[key] = value
        elif top is not None:
            top.append(value)
        if kind == _DICT or kind == _ARRAY:
            stack.append(top)
            top = value
        elif top is None:
            return (value, at) if type(value) is list or kind == _EMPTY else None


def parse_object(reader: TokenReader) -> Any:
    """One direct object or a reference.  Containers are built on a stack, so depth has no limit."""
    if not reader.held:
        plain = _plain_container(reader.cursor.data, reader.cursor.pos)
        if plain is not None:
            reader.cursor.pos = plain[1]
            return plain[0]
    stack: list[tuple[str, Any, list]] = []
    while True:
        token = reader.take()
        kind = token.kind
        if kind == "integer":
            value = _number_or_reference(token, reader)
        elif kind in ("real", "name", "string"):
            value = token.value
        elif kind == "keyword" and token.value in _WORDS:
            value = _WORDS[token.value]
        elif kind in ("array-open", "dict-open"):
            stack.append((kind, token.offset, []))
            continue
        elif kind == "array-close" and stack and stack[-1][0] == "array-open":
            value = stack.pop()[2]
        elif kind == "dict-close" and stack and stack[-1][0] == "dict-open":
            items = stack.pop()[2]
            if len(items) % 2:
                raise ParseError("a dictionary key has no value", token.offset)
            value = dict(zip(items[::2], items[1::2]))
        elif kind == "eof":
            raise ParseError("the input ends inside a container" if stack else "an object was expected", token.offset)
        else:
            raise ParseError(f"unexpected {kind} {token.value or ''}".rstrip(), token.offset)
        if not stack:
            return value
        opened, _, items = stack[-1]
        if opened == "dict-open" and len(items) % 2 == 0:
            if not isinstance(value, Name) or kind != "name":
                raise ParseError("a dictionary key shall be a name", token.offset)
            if value in items[::2]:
                raise ParseError(f"the key /{value} occurs twice", token.offset)
        items.append(value)


def _number_or_reference(token: Token, reader: TokenReader) -> Any:
    """Two integers and R are a reference, never three values."""
    try:
        second = reader.peek(0)
        is_ref = second.kind == "integer" and reader.peek(1) == Token("keyword", "R", reader.peek(1).offset)
    except LexError:
        return token.value  # what follows is somebody else's error
    if not is_ref:
        return token.value
    if not 1 <= token.value <= HIGHEST or not 0 <= second.value < 2**31:
        raise ParseError(f"{token.value} {second.value} R is no reference", token.offset)
    reader.take()
    reader.take()
    return Ref(token.value, second.value)


class IndirectObject(NamedTuple):
    number: int
    generation: int
    value: Any


_PLAIN_HEAD = re.compile(_GAP + rb"([1-9]\d{0,17}+)" + _BREAK + rb"(\d{1,18}+)" + _BREAK + rb"obj" + _STOP)
_PLAIN_TAIL = re.compile(_GAP + rb"endobj" + _STOP)
#: Bytes of the longest body that is kept.
KEPT_BODY = 512


def plain_indirect(data: bytes, at: int, known: dict[bytes, Any]) -> tuple[tuple[int, int], Any] | None:
    """((number, generation), value) where a container in its plain form is all of an indirect object; None for all else.

    ``known`` has the values of short bodies; objects of the same body share one.
    """
    head = _PLAIN_HEAD.match(data, at)
    if head is None:
        return None
    start = head.end()
    end = data.find(b"endobj", start, start + KEPT_BODY)
    body = data[start : end + 7] if end >= 0 else b""  # with endobj and the byte behind it
    value = known.get(body)
    if value is not None:
        return (int(head[1]), int(head[2])), value
    plain = _plain_container(data, start)
    tail = None if plain is None else _PLAIN_TAIL.match(data, plain[1])
    if tail is None:
        return None
    if tail.end() == end + 6:
        known[body] = plain[0]
    return (int(head[1]), int(head[2])), plain[0]


def parse_indirect(reader: TokenReader, resolve_length: Callable[[Ref], int] | None = None) -> IndirectObject:
    """``N G obj ... endobj``, with a stream's body if there is one."""
    number, generation = reader.take(), reader.take()
    if number.kind != "integer" or generation.kind != "integer" or number.value < 1 or generation.value < 0:
        raise ParseError("an indirect object begins with its number and generation", number.offset)
    _expect(reader, "obj")
    value = parse_object(reader)
    token = reader.take()
    if token.kind == "keyword" and token.value == "stream":
        if not isinstance(value, dict):
            raise ParseError("a stream shall begin with a dictionary", token.offset)
        value = Stream(value, _stream_body(reader, value, token.offset, resolve_length))
        _expect(reader, "endstream")
        token = reader.take()
    if token.kind != "keyword" or token.value != "endobj":
        raise ParseError("endobj was expected", token.offset)
    return IndirectObject(number.value, generation.value, value)


def _expect(reader: TokenReader, word: str) -> None:
    token = reader.take()
    if token.kind != "keyword" or token.value != word:
        raise ParseError(f"{word} was expected", token.offset)


def _stream_body(reader: TokenReader, entries: dict, offset: int, resolve_length) -> bytes:
    cursor = reader.cursor  # nothing is held here, so it is right behind the keyword
    if not cursor.try_consume(b"\r\n") and not cursor.try_consume(b"\n"):
        raise ParseError("the keyword stream shall end with CR LF or LF", offset)
    length = entries.get("Length")
    if isinstance(length, Ref):
        if resolve_length is None:
            raise ParseError("an indirect /Length can't be resolved here", offset)
        length = resolve_length(length)
    if not isinstance(length, int) or isinstance(length, bool) or length < 0:
        raise ParseError("a stream's /Length shall be a non-negative integer", offset)
    start = cursor.pos
    if start + length > len(cursor):
        raise ParseError("a stream's /Length goes past the end of the file", offset)
    cursor.seek(start + length)
    body = cursor.slice(start, start + length)
    cursor.try_consume_eol()
    return body
