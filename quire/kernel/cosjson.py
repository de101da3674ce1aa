"""Values as compact JSON, for columns between kernels.

Integers, booleans, null and arrays are JSON's own; the rest are one-key
objects, so that an integer and a real, or a name and a string, stay apart.
"""

from __future__ import annotations

import json
import re
from base64 import b64decode, b64encode
from typing import Any

from .values import Name, PdfString, Ref, Stream


def dumps(value: Any) -> str:
    try:
        return json.dumps(_out(value), ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return _dumps_deep(value)


def loads(text: str) -> Any:
    try:
        return _in(json.loads(text))
    except RecursionError:
        return _loads_deep(text)


def _dumps_deep(value: Any) -> str:
    """The same text for values of any depth."""
    out: list[str] = []
    waiting: list[Any] = [value]
    while waiting:
        at = waiting.pop()
        if type(at) is _Raw:
            out.append(at)
        elif isinstance(at, Stream) or type(at) is dict:
            head = f'{{"x":"{b64encode(at.raw).decode()}","d":[' if isinstance(at, Stream) else '{"d":['
            parts: list[Any] = [_Raw(head)]
            for i, (k, v) in enumerate((at.dict if isinstance(at, Stream) else at).items()):
                parts += [_Raw(("," if i else "") + "[" + json.dumps(str(k), ensure_ascii=False) + ","), v, _Raw("]")]
            waiting.extend(reversed([*parts, _Raw("]}")]))
        elif type(at) is list:
            parts = [_Raw("[")]
            for i, v in enumerate(at):
                parts += [_Raw(","), v] if i else [v]
            waiting.extend(reversed([*parts, _Raw("]")]))
        else:
            out.append(json.dumps(_out(at), ensure_ascii=False, separators=(",", ":")))
    return "".join(out)


class _Raw(str):
    pass


_PART = re.compile(r'\s*([\[\]{},:]|"(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+)')


def _loads_deep(text: str) -> Any:
    """Values of any depth: containers stand on a stack, and a one-key object becomes its value where it closes."""
    stack: list[tuple[str, list]] = [("", [])]
    for part in _PART.finditer(text):
        token = part[1]
        if token in "[{":
            stack.append((token, []))
        elif token in "]}":
            opened, items = stack.pop()
            stack[-1][1].append(items if opened == "[" else _close(dict(zip(items[::2], items[1::2]))))
        elif token not in ",:":
            stack[-1][1].append(json.loads(token))
    return stack[0][1][0]


def _out(value: Any) -> Any:
    if isinstance(value, Name):
        return {"n": str(value)} if value.raw is None else {"n": str(value), "b": value.raw.hex()}
    if isinstance(value, PdfString):
        return {"s" if value.form == "literal" else "h": value.data.hex()}
    if isinstance(value, Ref):
        return {"R": [value.number, value.generation]}
    if isinstance(value, Stream):
        return {"x": b64encode(value.raw).decode(), "d": [[k, _out(v)] for k, v in value.dict.items()]}
    if isinstance(value, float):
        return {"r": repr(value)}
    if isinstance(value, dict):
        return {"d": [[k, _out(v)] for k, v in value.items()]}
    if isinstance(value, list):
        return [_out(v) for v in value]
    return value


def _in(value: Any) -> Any:
    if isinstance(value, list):
        return [_in(v) for v in value]
    if not isinstance(value, dict):
        return value
    return _close(value | {"d": [[k, _in(v)] for k, v in value["d"]]} if "d" in value else value)


def _close(value: dict) -> Any:
    """What a one-key object stands for; the values inside a dictionary are done."""
    if "n" in value:
        return Name(value["n"], bytes.fromhex(value["b"]) if "b" in value else None)
    if "s" in value or "h" in value:
        form = "literal" if "s" in value else "hex"
        return PdfString(bytes.fromhex(value["s" if form == "literal" else "h"]), form)
    if "R" in value:
        return Ref(*value["R"])
    if "r" in value:
        return float(value["r"])
    entries = dict(value["d"])
    return Stream(entries, b64decode(value["x"])) if "x" in value else entries
