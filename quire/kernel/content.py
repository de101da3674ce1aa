"""Content streams: which operator may stand where, and the bytes of a stream."""

from __future__ import annotations

from typing import Any, NamedTuple

from .values import PdfError, Ref, Stream
from .writer import write_object

# The operators by the graphics objects that they may stand in.
PAGE_OR_TEXT = (
    "q Q cm w J j M d ri i gs CS cs SC sc SCN scn G g RG rg K k Tc Tw Tz TL Tf Tr Ts MP DP BMC BDC EMC BX EX".split()
)
PAGE_ONLY = "sh Do BT".split()
PATH_START = "m re".split()
PATH_ONLY = "l c v y h W W*".split()
PAINTERS = "S s f F f* B B* b b* n".split()
TEXT_ONLY = "ET Td TD Tm T* Tj TJ ' \"".split()
OPENS = {"q": "q", "BT": "text", "BMC": "mc", "BDC": "mc"}
CLOSES = {"Q": "q", "ET": "text", "EMC": "mc"}
ENTERS = {"m": "path", "re": "path", "W": "clip", "W*": "clip", "BT": "text", "ET": "page"} | dict.fromkeys(PAINTERS, "page")
REFUSED = {
    "BI": "inline images aren't written; use an image XObject", "ID": "inline images aren't written; use an image XObject",
    "EI": "inline images aren't written; use an image XObject", "d0": "glyph descriptions aren't written", "d1": "glyph descriptions aren't written",
}


class Operator(NamedTuple):
    name: str
    where: tuple[str, ...]
    enters: str | None
    opens: str | None
    closes: str | None


def _table() -> dict[str, Operator]:
    places = (
        (PAGE_OR_TEXT, ("page", "text")), (PAGE_ONLY, ("page",)), (PATH_START, ("page", "path")), (PATH_ONLY, ("path",)),
        (PAINTERS, ("path", "clip")), (TEXT_ONLY, ("text",)),
    )
    return {n: Operator(n, where, ENTERS.get(n), OPENS.get(n), CLOSES.get(n)) for names, where in places for n in names}


OPERATORS = _table()


class ContentError(PdfError):
    layer = "content"


class ContentStream:
    """Writes operators one by one and refuses what breaks the order of graphics objects."""

    def __init__(self):
        self.context = "page"
        self.open_brackets: list[str] = []
        self._out = bytearray()

    def op(self, name: str, *operands: Any) -> ContentStream:
        self.context, self.open_brackets = step(self.context, self.open_brackets, name)
        for operand in operands:
            check_direct(operand, name)
            self._out += write_object(operand) + b" "
        self._out += name.encode() + b"\n"
        return self

    def finish(self) -> bytes:
        problem = unfinished(self.context, self.open_brackets)
        if problem:
            raise ContentError(problem)
        return bytes(self._out)


def step(context: str, brackets: list[str], name: str) -> tuple[str, list[str]]:
    """Context and open brackets after an operator; raises where it may not stand."""
    if name in REFUSED:
        raise ContentError(f"{name}: {REFUSED[name]}")
    own = OPERATORS.get(name)
    if own is None:
        raise ContentError(f"{name} is no operator (R-7.8.2-14)")
    if context not in own.where:
        if name == "BT" and context == "text":
            raise ContentError("BT: text objects shall not be nested (R-9.4.1-7)")
        raise ContentError(f"{name} shall not appear at the {context} level (R-8.2-10)")
    if own.closes:
        if not brackets or brackets[-1] != own.closes:
            raise ContentError(f"{name} closes {own.closes}, but {brackets[-1] if brackets else 'nothing'} is open (R-9.4.1-6 / R-14.6.1-12)")
        brackets = brackets[:-1]
    if own.opens:
        brackets = [*brackets, own.opens]
    return own.enters or context, brackets


def unfinished(context: str, brackets: list[str]) -> str | None:
    if brackets:
        return f"the stream ends with open brackets {', '.join(brackets)} (R-9.4.1-6 / R-14.6.1-12)"
    if context != "page":
        return f"the stream ends inside a {context} object"
    return None


def check_direct(operand: Any, name: str) -> None:
    """No reference and no stream, at any depth."""
    waiting = [operand]
    while waiting:
        at = waiting.pop()
        if isinstance(at, (Ref, Stream)):
            raise ContentError(f"{name}: indirect objects shall not be operands (R-7.8.2-8)")
        waiting.extend(at.values() if isinstance(at, dict) else at if isinstance(at, list) else ())


def validate(names: list[str]) -> str | None:
    """The first problem of a sequence of operators, or None."""
    context, brackets = "page", []
    for name in names:
        try:
            context, brackets = step(context, brackets, name)
        except ContentError as error:
            return str(error)
    return unfinished(context, brackets)
