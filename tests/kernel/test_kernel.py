import random
import zlib

import numpy as np
import pytest

from quire.kernel import content, declare, files, filters, fixture, fonts, inflate, lexer, pagetree, structure, survey, writer
from quire.kernel.editor import Editor
from quire.kernel.values import FilterError, LexError, Name, ParseError, PdfError, PdfString, Ref, Refusal, Stream, TruncatedHistory, WriteError, kind_of

from .build import PAGE, build_pdf, tree


def read(text):
    return lexer.parse_object(lexer.TokenReader(lexer.Cursor(text if isinstance(text, bytes) else text.encode("latin-1"))))


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("12", 12), ("+17", 17), ("-0", 0), ("34.5", 34.5), ("-.002", -0.002), ("4.", 4.0), ("true", True), ("null", None),
        ("(a\\(b\\)(c)\\n\\053\\53x\\0053)", PdfString(b"a(b)(c)\n++x\x053")), ("(a\\\r\nb\rc\r\nd\\q)", PdfString(b"ab\nc\ndq")),
        ("<90 1f A>", PdfString(b"\x90\x1f\xa0", "hex")), ("/A#42#zz", "AB#zz"), ("/", ""), ("[1 0 R 2 3]", [Ref(1), 2, 3]),
        ("<</A 1/B[/C null]>>", {"A": 1, "B": [Name("C"), None]}), ("% c\n7", 7), ("[1.2.3]", [1.2, 0.3]), ("[12 abc]", ParseError),
        ("<</A 1/A 2>>", ParseError), ("<</A>>", ParseError), ("<<1 2>>", ParseError), ("(open", LexError), ("<4x>", LexError), ("+", LexError),
        (")", LexError), ("[1", ParseError), ("0 0 R", ParseError), ("", ParseError), ("[" * 5000 + "]" * 5000, "deep"),
    ],
)
def test_objects(text, value):
    if isinstance(value, type):
        with pytest.raises(value):
            read(text)
    elif value == "deep":
        assert kind_of(read(text)) == "array"
    else:
        found = read(text)
        assert (found, kind_of(found)) == (value, kind_of(found))
        assert type(found) is not bool or found is value


def test_names_keep_their_bytes():
    odd = read("/x#ffy")
    assert (odd.raw, writer.write_name(odd)) == (b"x\xffy", b"/x\xffy")
    assert writer.write_name("A é#/") == "/A#20é#23#2F".encode()


@pytest.mark.parametrize(("value", "text"), [(0.0, "0.0"), (-0.0, "0.0"), (1.0, "1.0"), (1e-7, "0.0000001"), (1e21, "1" + "0" * 21 + ".0"), (0.1, "0.1"), (123456.789, "123456.789")])
def test_reals(value, text):
    assert writer.format_real(value) == text
    assert read(text) == value and isinstance(read(text), float)


def test_values_read_back_as_written():
    value = {"A": [1, -2.5, True, None, Name("x y"), PdfString(b"()\\\x00\xff\r"), PdfString(b"\x01", "hex"), Ref(3, 1), {}, []], "B": {"C": Name("")}}
    assert read(writer.write_object(value)) == value
    with pytest.raises(WriteError):
        writer.write_object([Stream({}, b"")])
    with pytest.raises(WriteError):
        writer.format_real(float("nan"))


PIECES = (
    "<<", ">>", "<<", ">>", "[", "]", "[", "]", "/A", "/B", "/A#20b", "/\xff", "/", "1", "+2", "-3", "0", "1.5", ".5", "-4.", "7 0 R", "7 1R", "0 0 R", "8 0 R/C", "9 0 Rx",
    "[1 2 3]", "[1 0 R 2 0 R]", "[]", "<<>>", "(a)", "(a(b)\\n)", "(\r)", "<4f4>", "<4 f>", "<4g>", "true", "false", "null", "nulls", "R", "%c\n", "%c", "9" * 18, "9" * 20, "\0", "\x0c", "1 2147483648 R", ")",
)


def outcome(parse):
    try:
        return repr(parse())
    except PdfError as error:
        return type(error).__name__, str(error)


def test_plain_containers_are_read_as_token_by_token(monkeypatch):
    """The short way gives the values and the errors of the long one, whatever stands in a container."""
    chance = random.Random(5)
    texts = ["<</A 1 /A 2>>", "[1 0 R 0 0 R]", "<</K[1 2 3 R]>>", "<</A(x)/B<41>/C[<<>>[]]>>x"]
    texts += [chance.choice(("<<", "[", "")) + "".join(chance.choice(PIECES) + chance.choice((" ", "", "\n")) for _ in range(chance.randrange(9))) + chance.choice((">>", "]", "")) for _ in range(4000)]
    objects = [b"%s 0 obj%s%s endobj%s" % (n, gap, t.encode("latin-1"), end) for t in texts for n, gap, end in ((b"5", b" ", b" "), (b"0", b"\n", b"x"))]
    long = lambda data: outcome(lambda: lexer.parse_indirect(lexer.TokenReader(lexer.Cursor(data)))[::2])
    short = lambda data: [outcome(lambda: (p[0][0], p[1])) for _ in range(2) if (p := lexer.plain_indirect(data, 0, known)) is not None]
    known, read_short = {}, [outcome(lambda: read(t)) for t in texts]
    plain = [short(data) for data in objects]
    monkeypatch.setattr(lexer, "_plain_container", lambda data, at: None)
    assert read_short == [outcome(lambda: read(t)) for t in texts]
    assert sum(map(bool, plain)) > 100 and all(p == long(data) for data, found in zip(objects, plain) for p in found)


def test_plain_files_are_read_without_single_tokens(monkeypatch):
    """A page tree in the form that the writer gives costs no token for each object, and what pages share is written and read once."""
    taken, texts = [], []
    real, text_of = lexer.next_token, writer._write_body
    monkeypatch.setattr(lexer, "next_token", lambda cursor: taken.append(cursor.pos) or real(cursor))
    monkeypatch.setattr(writer, "_write_body", lambda value: texts.append(value) or text_of(value))
    page = {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 9, 9], "Resources": {}}
    kids = [Ref(3 + k // 2) for k in range(600)]
    objects = [(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2)}), (2, 0, {"Type": Name("Pages"), "Kids": kids, "Count": 600}), *((n, 0, page) for n in range(3, 303))]
    document = files.parse(writer.write_file(objects, {"Root": Ref(1)}))
    assert document.collect() == objects and len(texts) == 3 and len(taken) < 20
    assert document.get(3) is document.get(302)
    assert [v[2] for v in pagetree.check_page_tree(document) if v[0] == pagetree.DUPLICATE] == list(range(3, 303))


@pytest.mark.parametrize("eol", [" \n", " \r", "\r\n"])
def test_classic_files(eol):
    document = files.parse(build_pdf(["<< /Pages 2 0 R >>", "(x)"], eol=eol, junk="junk\n"))
    assert (document.origin, document.version, document.get(2)) == (5, "1.7", PdfString(b"x"))
    assert document.get(9) is None and document.get(2, 1) is None and document.get(0) is None


@pytest.mark.parametrize(
    "options",
    [
        {"header": "%PDF-9.9\n"}, {"header": "nothing\n"}, {"startxref": 3}, {"startxref": 99999}, {"tail": lambda n: ""},
        {"trailer": lambda n: "trailer\n<< /Root 1 0 R >>\n"}, {"trailer": lambda n: "trailer\n[]\n"}, {"eol": "\n"},
    ],
)
def test_bad_files_are_errors_not_crashes(options):
    with pytest.raises(PdfError):
        files.parse(build_pdf(["<< >>"], **options))


def test_catalog_version_wins_if_later():
    assert files.parse(build_pdf(["<< /Version /2.0 >>"])).version == "2.0"
    assert files.parse(build_pdf(["<< /Version /1.2 >>"])).version == "1.7"
    with pytest.raises(ParseError):
        files.parse(build_pdf(["<< /Version (2.0) >>"]))


def test_stream_lengths():
    body = "<< /Length {} >>\nstream\nabc\nendstream"
    assert files.parse(build_pdf(["<< >>", body.format("3 0 R"), "3"])).get(2).raw == b"abc"
    for bad in ("-1", "9999", "(3)", "2 0 R", "2"):
        with pytest.raises(ParseError):
            files.parse(build_pdf(["<< >>", body.format(bad), "3"])).get(2)


OBJECTS = [
    (1, 0, {"Type": Name("Catalog"), "Pages": Ref(2)}),
    (2, 0, {"Type": Name("Pages"), "Kids": [Ref(4)], "Count": 1}),
    (4, 0, {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(7, 2), "Dangling": Ref(30)}),
    (7, 2, Stream({"A": 1.0}, b"raw\xff")),
    (9, 0, [1, 2.5, PdfString(b"s")]),
]


@pytest.mark.parametrize(("name", "xref", "packed"), survey.MODES)
def test_write_and_read_in_every_form(name, xref, packed):
    data = writer.write_file(OBJECTS, {"Root": Ref(1), "Prev": 5}, version="1.5", xref=xref, object_streams=packed)
    assert data == writer.write_file(list(reversed(OBJECTS)), {"Root": Ref(1), "Prev": 5}, version="1.5", xref=xref, object_streams=packed)
    document = files.parse(data)
    assert [(n, g) for n, g, _ in document.collect()] == [(n, g) for n, g, _ in OBJECTS]
    for n, g, value in OBJECTS:
        assert survey.flatten(document.get(n, g)) == survey.flatten(value)
    assert document.chain.sections[0].form == xref
    for _, other, also in survey.MODES:
        assert survey.round_trip(data, other, also) == ("ok", None)
    assert ("compressed" in {e.kind for e in document.entries.values()}) == packed


def test_writer_refusals():
    for objects in ([(0, 0, 1)], [(1, 0, 1), (1, 0, 2)]):
        with pytest.raises(WriteError):
            writer.write_file(objects, {})
    with pytest.raises(WriteError):
        writer.write_file([], {}, object_streams=True)


@pytest.mark.parametrize("xref", ["table", "stream"])
def test_updates_leave_the_original_and_the_newest_wins(xref):
    first = b"junk\n" + writer.write_file(OBJECTS, {"Root": Ref(1)})
    editor = Editor.open(first)
    editor.set(9, PdfString(b"new"))
    added = editor.allocate({"N": 1})
    assert added.number > 30 or added.number == 10
    editor.delete(7, 2)
    broken = dict(editor.get(4))
    broken["MediaBox"], broken["Resources"] = [0, 0, 1, 1], {}
    editor.set(4, broken)
    data = editor.append_update(xref=xref)
    assert data.startswith(first)
    document = files.parse(data)
    assert document.get(9) == PdfString(b"new") and document.get(*added) == {"N": 1}
    assert document.get(7, 2) is None and document.get(7, 3) is None and document.entries[7].kind == "free"
    assert len(document.chain.sections) == 2 and document.stop.kind == "complete"
    again = Editor.open(data)
    again.set(9, 5)
    assert files.parse(again.append_update(xref=xref)).get(9) == 5


def test_hybrid_and_old_history():
    plain = writer.write_file(OBJECTS, {"Root": Ref(1)})
    stream = writer.write_indirect(20, 0, writer.build_xref_stream({11: files.Entry("compressed", 12, 0)}, 13, {}))
    holder = writer.write_indirect(12, 0, writer.build_object_stream([(11, 0, 77)]))
    data = plain + holder + stream
    at = len(data)
    data += b"xref\n12 1\n" + writer.xref_entry(len(plain), 0, b"n")
    data += b"trailer\n<</Size 21/Root 1 0 R/Prev %d/XRefStm %d>>\nstartxref\n%d\n%%%%EOF\n" % (
        writer.find_last_startxref(plain), len(plain) + len(holder), at,
    )
    document = files.parse(data)
    assert document.get(11) == 77 and document.chain.sections[0].form == "hybrid"
    for prev, stop in ((0, "prev-zero"), (10**6, "unreadable"), (at, "cyclic")):
        cut = plain + b"xref\n0 0\ntrailer\n<</Size 10/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (len(plain) if stop == "cyclic" else prev, len(plain))
        broken = files.parse(cut)
        assert broken.stop.kind == stop
        with pytest.raises(TruncatedHistory):
            writer.rewrite(broken)


def test_unknown_entry_kinds_read_as_null():
    assert files.make_entry(9, 1, 2).kind == "unknown"


DATA = [b"", b"x", b"short text", b"abcabc" * 20_000, bytes(300_000), bytes((i * 37 + (i * i % 251)) & 255 for i in range(100_000))]


@pytest.mark.parametrize("data", DATA, ids=len)
@pytest.mark.parametrize("mode", [(0, 0), (1, 0), (6, 0), (9, 0), (6, zlib.Z_FIXED), (6, zlib.Z_RLE), (6, zlib.Z_HUFFMAN_ONLY)])
def test_inflate(data, mode):
    packer = zlib.compressobj(mode[0], zlib.DEFLATED, 15, 8, mode[1])
    assert filters.inflate(packer.compress(data) + packer.flush()) == data


@pytest.mark.parametrize("bad", [b"", b"\x78", zlib.compress(b"abc")[:-1], zlib.compress(b"abc") + b"x", b"\x79\x9c\x03\x00", b"\x78\x9c\x07", zlib.compress(b"abc")[:-4] + b"0000"])
def test_inflate_refusals(bad):
    with pytest.raises(FilterError):
        filters.inflate(bad)


def test_predictors():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 4 * 3)).astype(np.uint8)
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    rows = []
    for k, row in enumerate(image):
        above = image[k - 1] if k else np.zeros(12, np.uint8)
        left = np.concatenate([np.zeros(3, np.uint8), row[:-3]])
        corner = np.concatenate([np.zeros(3, np.uint8), above[:-3]])
        guess = [0 * row, left, above, ((left.astype(int) + above) // 2).astype(np.uint8), np.array([filters.paeth(*map(int, x)) for x in zip(left, above, corner)], np.uint8)][k]
        rows.append(bytes([k]) + (row - guess).tobytes())
    assert filters.apply_predictor(b"".join(rows), parms) == image.tobytes()
    tiff = np.diff(image.reshape(5, 4, 3), axis=1, prepend=np.zeros((5, 1, 3), np.uint8)).astype(np.uint8)
    assert filters.apply_predictor(tiff.tobytes(), {**parms, "Predictor": 2}) == image.tobytes()
    for bad in ({"Predictor": 3}, {"Predictor": 2, "BitsPerComponent": 4}):
        with pytest.raises(FilterError):
            filters.apply_predictor(b"abcd", bad)
    packed = Stream({"Filter": [Name("FlateDecode")], "DecodeParms": [parms]}, zlib.compress(b"".join(rows)))
    assert filters.decode_stream(packed) == image.tobytes()
    with pytest.raises(FilterError):
        filters.decode_stream(Stream({"Filter": Name("LZWDecode")}, b""))
    with pytest.raises(FilterError):
        filters.encode_stream(b"", "FlateDecode")


def node(kids, count, more=""):
    return f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {count} {more} >>"


def test_page_trees():
    page = PAGE.format(parent=2, more="")
    flat = files.parse(tree(node([3, 4], 2), page, page))
    walked = pagetree.read_page_tree(flat)
    assert [p.ref for p in walked.pages] == [Ref(3), Ref(4)]
    assert pagetree.check_page_tree(flat) == [] and pagetree.count_corrections(flat) == {}
    nested = files.parse(
        tree(
            node([3], 9, "/MediaBox [0 0 1 1] /Tabs /S /Resources << /A 1 >> /Rotate 90"),
            node([4], 1, "/Parent 2 0 R /MediaBox [0 0 2 2] /Resources << /B 1 >>"),
            "<< /Parent 3 0 R >>",
        )
    )
    page = pagetree.read_page_tree(nested).pages[0]
    got = {k: pagetree.inherited(page, k) for k in ("MediaBox", "Tabs", "Resources", "Rotate", "CropBox")}
    assert got == {"MediaBox": [0, 0, 2, 2], "Tabs": None, "Resources": {"B": 1}, "Rotate": 90, "CropBox": None}
    assert {r.number: c for r, (_, c) in pagetree.count_corrections(nested).items()} == {2: 1}


@pytest.mark.parametrize(
    ("bodies", "clause"),
    [
        ((node([3, 3], 1), PAGE.format(parent=2, more="")), pagetree.DUPLICATE),
        ((node([3], 1), "<< /Parent << >> /MediaBox [] /Resources << >> >>"), pagetree.PARENT),
        ((node([3], 1), PAGE.format(parent=9, more="")), pagetree.PARENT),
        ((node([3], 1), "<< /MediaBox [] /Resources << >> >>"), pagetree.PARENT),
        ((node([3], 1), PAGE.format(parent=2, more="/Rotate 45")), pagetree.ROTATION),
        ((node([3], 1), PAGE.format(parent=2, more="/Contents []")), pagetree.EMPTY_CONTENTS),
        ((node([3], 1), "<< /Parent 2 0 R /MediaBox [] >>"), pagetree.REQUIRED_ATTRIBUTE),
    ],
)
def test_broken_page_trees_are_read_and_not_written(bodies, clause):
    data = tree(*bodies)
    assert [c for c, _, _ in pagetree.check_page_tree(files.parse(data))] == [clause]
    with pytest.raises(Refusal):
        Editor.open(data).save()


def test_editor_from_scratch():
    editor = Editor.create("1.6")
    page = editor.allocate({"Type": Name("Page"), "Parent": Editor.pages_ref, "MediaBox": [0, 0, 9, 9], "Resources": {}})
    assert page == Ref(3)
    editor.set(2, {"Type": Name("Pages"), "Kids": [page], "Count": 7})
    document = files.parse(editor.save())
    assert (document.version, document.get(2)["Count"], len(editor.pages())) == ("1.6", 1, 1)
    assert editor.page_attribute(0, "MediaBox") == [0, 0, 9, 9]
    for act in (lambda: editor.append_update(), lambda: editor.set_trailer_entry("Size", 1), lambda: editor.remove_trailer_entry("Root"), lambda: editor.set(0, 1)):
        with pytest.raises(WriteError):
            act()
    with pytest.raises(IndexError):
        editor.page_attribute(1, "MediaBox")


def test_operator_table():
    assert len(content.OPERATORS) == 68
    for good in ("q cm Q", "BT Tf Td Tj ET", "m l c h S", "re W n", "BMC BT Tj ET EMC", "re f* m l S", ""):
        assert content.validate(good.split()) is None
    for bad in ("Q", "q", "l", "m", "BT BT", "ET", "re W", "m q", "BT re", "q BMC Q EMC", "BI", "d0", "zz", "Tj", "re Do"):
        assert content.validate(bad.split())
    made = content.ContentStream().op("BT").op("Tf", Name("F1"), 12).op("Tj", PdfString(b"x")).op("ET")
    assert made.finish() == b"BT\n/F1 12 Tf\n(x) Tj\nET\n"
    for operand in (Ref(1), [[Ref(1)]], {"A": Ref(1)}, Stream({}, b"")):
        with pytest.raises(content.ContentError):
            content.ContentStream().op("q", operand)


def sfnt(mark, *tables):
    at = 12 + 16 * len(tables)
    rows = b"".join(t + bytes(4) + (at).to_bytes(4, "big") + (6).to_bytes(4, "big") for t in tables)
    return mark + len(tables).to_bytes(2, "big") + bytes(6) + rows + b"\0\0\0\0\0\x2a"


def test_fonts():
    true = fonts.sniff(sfnt(b"\0\1\0\0", b"glyf", b"head", b"hhea", b"hmtx", b"loca", b"maxp", b"cmap"))
    assert (true.format, true.glyphs) == ("truetype", 42)
    assert fonts.sniff(sfnt(b"OTTO", b"CFF ", b"glyf")).format == "opentype-cff"
    assert fonts.sniff(b"\1\0\4\2rest").format == "bare-cff"
    for bad in (b"ab", b"ttcf....", b"abcd....", sfnt(b"true", b"head"), sfnt(b"true", b"glyf")[:20]):
        with pytest.raises(fonts.FontError):
            fonts.sniff(bad)
    made = []
    font, notes = fonts.composite_font(lambda v: made.append(v) or Ref(len(made)), true, "Name", {"Flags": 4}, default_width=500)
    assert (font, notes, len(made)) == (Ref(4), ["R-9.9.1-21"], 4)
    assert made[0].dict == {"Length1": len(true.data)} and made[1]["FontFile2"] == Ref(1) and made[2]["CIDToGIDMap"] == "Identity"
    assert made[3]["BaseFont"] == fonts.subset_tag(true.data) + "+Name" and made[3]["DescendantFonts"] == [Ref(3)]
    with pytest.raises(fonts.FontError):
        fonts.composite_font(lambda v: Ref(1), true, "N", {"FontFile": 1})
    with pytest.raises(fonts.FontError):
        fonts.composite_font(lambda v: Ref(1), true._replace(tables=["glyf"]), "N", {})
    assert len(fonts.subset_tag(b"")) == 6 and fonts.subset_tag(b"a") != fonts.subset_tag(b"b")


class Sink(dict):
    def reserve(self):
        self[len(self) + 1] = None
        return Ref(len(self))

    def write(self, ref, value):
        self[ref.number] = value


def test_structure_tree():
    tree = structure.StructureTree()
    top = tree.element("Document", title="T")
    one, two = tree.element("P", top, alt="a"), tree.element("P", top)
    first, second = tree.stream(Ref(50)), tree.stream(Ref(60))
    first.item(one, lambda c: c.op("q").op("Q")).artifact(lambda c: None, "Footer").item(two, lambda c: None)
    second.item(two, lambda c: None).artifact(lambda c: None)
    with pytest.raises(structure.StructureError):
        first.item(one, lambda c: first.item(two, lambda c: None))
    sink = Sink()
    built = tree.finish(sink)
    assert (built.root, built.keys) == (Ref(1), {first: 0, second: 1})
    assert sink[1]["K"] == Ref(2) and sink[1]["ParentTreeNextKey"] == 2
    assert sink[3]["Pg"] == Ref(50) and sink[3]["P"] == Ref(2) and sink[3]["Alt"] == PdfString(b"a")
    assert sink[4]["K"] == [{"Type": "MCR", "Pg": Ref(50), "MCID": 1}, {"Type": "MCR", "Pg": Ref(60), "MCID": 0}] and "Pg" not in sink[4]
    assert b"/P <</MCID 0>> BDC\nq\nQ\nEMC\n/Artifact <</Subtype /Footer>> BDC" in first.content._out
    assert second.finish().endswith(b"/Artifact BMC\nEMC\n")
    with pytest.raises(structure.StructureError):
        structure.StructureTree().finish(Sink())


def test_declarations():
    facts = declare.Facts(title="A & B", lang="en", viewer_preferences={"DisplayDocTitle": True}, mark_info={"Marked": True}, struct_tree_root=Ref(1))
    made = declare.declare("pdfua-1", facts)
    assert b"<pdfuaid:part>1</pdfuaid:part>" in made.xmp and b"A &amp; B" in made.xmp and made.catalog_entries["Lang"] == PdfString(b"en")
    with pytest.raises(Refusal) as refusal:
        declare.declare("pdfua-1", declare.Facts())
    assert [c for c, _, _ in refusal.value.violations] == ["R-7.1-12", "R-7.1-15", "R-7.1-1", "R-7.2-5"]
    with pytest.raises(Refusal) as refusal:
        declare.declare("pdfa-4", declare.Facts(encrypted=True, info={"A": 1}, embedded_files=({},)))
    assert [c for c, _, _ in refusal.value.violations] == ["PRE-OUTPUTINTENT", "PRE-NOENCRYPT", "PRE-FILEID", "PRE-NOINFO", "PRE-NOATTACHMENTS"]
    a = declare.Facts(output_intents=({"S": Name("GTS_PDFA1"), "DestOutputProfile": Ref(1)},), has_file_identifier=True, create_date="2020")
    for level, part in (("pdfa-3b", b"<pdfaid:conformance>B<"), ("pdfa-4f", b"<pdfaid:rev>2020<")):
        assert part in declare.declare(level, a).xmp


def test_failures_group():
    assert survey.normalise("no /Foo12 at 0x1F, byte 33") == "no /Name at 0xN, byte N"
    assert survey.round_trip(b"nothing", "table", False)[0] == "unreadable"


@pytest.mark.parametrize("level", range(10))
def test_second_inflater_agrees_with_the_library(level):
    rng = random.Random(level)
    for n in (0, 1, 100, 4000):
        data = bytes(rng.choice(b"abcde \n") for _ in range(n)) + rng.randbytes(n // 8)
        packed = zlib.compress(data, level)
        assert inflate.inflate(packed) == data
        damaged = bytearray(packed)
        damaged[rng.randrange(len(packed))] ^= 1 << rng.randrange(8)
        for other in (bytes(damaged), packed[:-1], packed + b"x", b"", b"x"):
            assert not inflate.differs(other, filters.inflate)


@pytest.mark.parametrize("tags", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4), (4, 3)])
def test_predicted_rows_come_back(tags):
    rng = random.Random(sum(tags))
    for n in (0, 1, 64, 1000):
        data = rng.randbytes(n)
        assert filters.apply_predictor(filters.png_rows(data, 64, tags), {"Predictor": 15, "Columns": 64})[:n] == data
        assert filters.apply_predictor(filters.tiff_rows(data, 21, 3), {"Predictor": 2, "Columns": 21, "Colors": 3})[:n] == data


@pytest.mark.parametrize("kind", fixture.HISTORIES)
def test_histories(kind):
    document = files.parse(fixture.history_file(41, kind))
    assert (document.stop.kind, document.get(2)) == (kind, 42)
    assert len(document.chain.sections) == (2 if kind == "complete" else 1)


def test_editor_lists_what_changed():
    made = Editor.create()
    refs = [made.allocate(k) for k in range(3)]
    made.delete(refs[1].number)
    made.set(9, None)
    assert [n for n, _, _ in made.changed()] == [1, 2, 3, 5, 9] and made.deleted() == [(4, 1)] and made.dirty


def test_same_is_equal_flattening():
    values = [
        1, 1.0, True, None, 0, 0.0, -0.0, float("nan"), Name("a"), PdfString(b"a"), PdfString(b"a", "hex"), Ref(1), Ref(1, 1), [], [1], [1.0], {}, {"a": 1}, {"a": None},
        {"b": [1, {"c": 2}]}, {"b": [1, {"c": 2.0}]}, Stream({}, b""), Stream({"Length": 3}, b""), Stream({"Length": 3}, b"x"), Stream({"A": {"Length": 1}}, b""),
    ]
    for a in values:
        for b in values:
            assert survey.same(a, b) == (survey.flatten(a) == survey.flatten(b)), (a, b)
