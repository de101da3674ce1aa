"""Embedded font programs: what they are, and the four objects of a composite font."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from .values import Name, PdfError, PdfString, Ref, Stream

#: Tables that an embedded TrueType program shall have.
TRUETYPE_TABLES = ("glyf", "head", "hhea", "hmtx", "loca", "maxp")


class FontError(PdfError):
    layer = "font"


class FontProgram(NamedTuple):
    format: str  # truetype, opentype-cff or bare-cff
    tables: list[str]
    glyphs: int | None
    data: bytes


class FontFile(NamedTuple):
    key: str
    subtype: str | None
    cid_subtype: str


FONT_FILES = {
    "truetype": FontFile("FontFile2", None, "CIDFontType2"),
    "opentype-cff": FontFile("FontFile3", "OpenType", "CIDFontType0"),
    "bare-cff": FontFile("FontFile3", "CIDFontType0C", "CIDFontType0"),
}


def sniff(data: bytes) -> FontProgram:
    """Tell a program's format from its first bytes and its table directory."""
    if len(data) < 4:
        raise FontError("a font program has at least 4 bytes")
    mark = data[:4]
    if mark == b"ttcf":
        raise FontError("a collection holds several fonts; an embedded program is one")
    if mark[0] == 1 and mark[1] == 0 and mark[2] >= 4 and 1 <= mark[3] <= 4:
        return FontProgram("bare-cff", [], None, data)
    if mark not in (b"\x00\x01\x00\x00", b"true", b"OTTO"):
        raise FontError("the program is neither sfnt nor CFF")
    number = lambda at, size: int.from_bytes(data[at : at + size].ljust(size, b"\0"), "big")
    directory = [data[at : at + 16] for at in range(12, 12 + 16 * number(4, 2), 16)]
    if any(len(row) < 16 for row in directory):
        raise FontError("the table directory goes past the end of the program")
    tables = [row[:4].decode("latin-1") for row in directory]
    glyphs = None
    for row in directory:
        at = int.from_bytes(row[8:12], "big")
        if row[:4] == b"maxp" and at + 6 <= len(data):
            glyphs = number(at + 4, 2)
    for table, kind in (("CFF ", "opentype-cff"), ("glyf", "truetype")):
        if table in tables:
            return FontProgram(kind, tables, glyphs, data)
    raise FontError("the program has no outlines, neither glyf nor CFF")


def subset_tag(data: bytes) -> str:
    """Six capital letters from a 32-bit FNV-1a hash of the program."""
    value = 0x811C9DC5
    for byte in data:
        value = (value ^ byte) * 0x01000193 & 0xFFFFFFFF
    letters = []
    for k in range(6):
        value, letter = divmod(value, 26)
        letters.append(chr(ord("A") + letter))
        value += 7 * k
    return "".join(letters)


def composite_font(
    allocate: Callable[[Any], Ref],
    program: FontProgram,
    name: str,
    descriptor: dict[str, Any],
    *,
    subset: bool = True,
    default_width: int | None = None,
    widths: Any = None,
    to_unicode: Any = None,
) -> tuple[Ref, list[str]]:
    """Allocate program, descriptor, descendant and Type 0 font, in this order; the font and notes."""
    file = FONT_FILES[program.format]
    notes: list[str] = []
    if program.format == "truetype":
        missing = [t for t in TRUETYPE_TABLES if t not in program.tables]
        if missing:
            raise FontError(f"the program lacks {', '.join(missing)} (R-9.9.1-34)")
        if "cmap" in program.tables:
            notes.append("R-9.9.1-21")
    base = f"{subset_tag(program.data)}+{name}" if subset else name
    if subset and not re.match(r"[A-Z]{6}\+", base):
        raise FontError("a subset's name begins with six capitals and a plus sign (R-9.9.2-2)")
    clash = [k for k in ("FontFile", "FontFile2", "FontFile3") if k in descriptor]
    if clash:
        raise FontError(f"/{clash[0]} is decided by the program")
    head: dict[str, Any] = {"Subtype": Name(file.subtype)} if file.subtype else {}
    if program.format == "truetype":
        head["Length1"] = len(program.data)
    program_ref = allocate(Stream(head, program.data))
    described = {**descriptor, "Type": Name("FontDescriptor"), "FontName": Name(base), file.key: program_ref}
    descriptor_ref = allocate(described)
    system = {"Registry": PdfString(b"Adobe"), "Ordering": PdfString(b"Identity"), "Supplement": 0}
    cid = {"Type": Name("Font"), "Subtype": Name(file.cid_subtype), "BaseFont": Name(base), "CIDSystemInfo": system, "FontDescriptor": descriptor_ref}
    optional = {"DW": default_width, "W": widths, "CIDToGIDMap": Name("Identity") if file.cid_subtype == "CIDFontType2" else None}
    cid_ref = allocate(cid | {k: v for k, v in optional.items() if v is not None})
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(base), "Encoding": Name("Identity-H"), "DescendantFonts": [cid_ref]}
    return allocate(font | ({} if to_unicode is None else {"ToUnicode": to_unicode})), notes
