"""Files put together by hand, apart from the writer, with shapes that the writer never gives them."""

from __future__ import annotations

from . import writer
from .files import Entry
from .values import Name, Ref, Stream

MARK = b"startxref\n%d\n%%%%EOF\n"
CATALOG = b"1 0 obj\n<</Type/Catalog>>\nendobj\n"


def table_file(bodies: dict[int, bytes], *, junk: bytes = b"", header: bytes = b"%PDF-1.7\n", eol: bytes = b" \n", more: bytes = b"", behind: bytes = b"") -> bytes:
    """Indirect objects by number under a table of single-entry subsections; ``more`` goes to the trailer, ``behind`` stands before the table."""
    out, places = bytearray(header), {}
    for number, body in bodies.items():
        places[number] = len(out)
        out += body
    out += behind
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f" + eol
    for number in sorted(places):
        out += b"%d 1\n%010d 00000 n" % (number, places[number]) + eol
    out += b"trailer\n<</Size %d/Root 1 0 R%s>>\n" % (max(places) + 1, more) + MARK % start
    return junk + bytes(out)


def hybrid_file(text: bytes, number: int) -> bytes:
    """Object 2 stands in the table and, as a decoy, in the stream that /XRefStm names; object 3 only in the stream."""
    head = b"%PDF-1.5\n" + CATALOG
    decoy_at = len(head)
    decoy = b"2 0 obj\n(decoy)\nendobj\n"
    hidden_at = decoy_at + len(decoy)
    hidden = b"3 0 obj\n%d\nendobj\n" % number
    stream_at = hidden_at + len(hidden)
    entries = {2: Entry("in-use", decoy_at, 0), 3: Entry("in-use", hidden_at, 0)}
    stream = writer.write_indirect(4, 0, writer.build_xref_stream(entries, 5, {}))
    own_at = stream_at + len(stream)
    own = b"2 0 obj\n<" + text.hex().encode() + b">\nendobj\n"
    start = own_at + len(own)
    rows = b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n" % (len(b"%PDF-1.5\n"), own_at)
    trailer = b"trailer\n<</Size 5/Root 1 0 R/XRefStm %d>>\n" % stream_at
    return head + decoy + hidden + stream + own + rows + trailer + MARK % start


def length_file(data: bytes, kind: int) -> bytes:
    """Object 3 is a stream whose /Length is direct (0), an object in use (1) or inside an object stream (2)."""
    out = bytearray(b"%PDF-1.5\n")
    entries = {0: writer.FREE}

    def put(number: int, body: bytes) -> None:
        entries[number] = Entry("in-use", len(out), 0)
        out.extend(body)

    put(1, CATALOG)
    put(3, b"3 0 obj\n<</Length %s>>\nstream\n%s\nendstream\nendobj\n" % (b"4 0 R" if kind else b"%d" % len(data), data))
    if kind == 1:
        put(4, b"4 0 obj\n%d\nendobj\n" % len(data))
    elif kind == 2:
        put(5, writer.write_indirect(5, 0, writer.build_object_stream([(4, 0, len(data))])))
        entries[4] = Entry("compressed", 5, 0)
    start = len(out)
    put(6, writer.write_indirect(6, 0, writer.build_xref_stream(entries | {6: Entry("in-use", start, 0)}, 7, {"Root": Ref(1)})))
    return bytes(out) + MARK % start


#: How the second of two sections tells where the first begins.
HISTORIES = ("complete", "prev-zero", "unreadable", "cyclic", "malformed")


def history_file(number: int, kind: str) -> bytes:
    """A file with one update, which repeats the catalog; the way to the older section is told in one of the ways above."""
    catalog = {"Type": Name("Catalog")}
    first = writer.write_file([(1, 0, catalog), (2, 0, number)], {"Root": Ref(1)})
    previous = writer.find_last_startxref(first)
    tail, start = writer.update_tail(len(first), [(1, 0, catalog), (2, 0, number + 1)], [], previous=previous, previous_size=3, trailer={"Root": Ref(1)})
    told = {"complete": b"%d" % previous, "prev-zero": b"0", "unreadable": b"99999999", "cyclic": b"%d" % start, "malformed": b"(x)"}[kind]
    return first + tail.replace(b"/Prev %d" % previous, b"/Prev " + told)


#: Font programs: the first bytes and, for sfnt programs, the tables.
PROGRAMS = {
    "truetype": (b"\0\1\0\0", ("glyf", "head", "hhea", "hmtx", "loca", "maxp")),
    "truetype-cmap": (b"true", ("cmap", "glyf", "head", "hhea", "hmtx", "loca", "maxp")),
    "opentype-cff": (b"OTTO", ("CFF ", "head")),
    "bare-cff": (b"\1\0\4\2", ()),
    "truetype-short": (b"\0\1\0\0", ("glyf", "head", "maxp")),
}


def font_program(kind: str) -> bytes:
    """The head of a program; what follows it is free."""
    mark, tables = PROGRAMS[kind]
    if not tables:
        return mark
    return mark + len(tables).to_bytes(2, "big") + bytes(6) + b"".join(t.encode() + bytes(12) for t in tables)


def filter_file(data: bytes, names: list[str]) -> bytes:
    """Object 2 is a stream under the named filters, whatever its bytes are."""
    return writer.write_file([(1, 0, {"Type": Name("Catalog")}), (2, 0, Stream({"Filter": [Name(n) for n in names]}, data))], {"Root": Ref(1)})
