"""Scanning PDF files into tables.

``files`` is any DataFrame of (file_id, content).  A file is parsed where it
lies; scans never shuffle its bytes.  A malformed file gives rows in
:func:`errors` and none elsewhere; it never fails a job, whatever is wrong
with it.  Integers beyond 38 digits are text in the node table.  Files are
independent, so partitions follow the source, and a table reads only the
columns that it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel import cosjson, editor, filters, pagetree, survey
from ..kernel import files as kernel
from ..kernel.lexer import Cursor, TokenReader
from ..kernel.values import Name, PdfError, PdfString, Ref, Stream, get, kind_of, references
from .arrow import map_rows

HEADER = "file_id string, origin long, header_version string, version string, startxref long, n_sections int, size long, stop_kind string, stop_offset long, stop_reason string"
SECTION = "file_id string, section_ord int, offset long, form string, n_entries int, own_number long, trailer string"
ENTRY = "file_id string, section_ord int, object_number long, kind string, a long, b long"
OBJECT = "file_id string, object_number long, generation int, kind string, cos string, error string"
NODE = (
    "file_id string, object_number long, generation int, node_id int, parent_id int, depth int, path string, key string, ordinal int, kind string, "
    "bool_v boolean, int_v decimal(38,0), int_text string, real_v double, name_v string, bytes_v binary, str_form string, ref_num long, ref_gen int"
)
PAGE = "file_id string, page_index int, object_number long, generation int, depth int, dict string, inherited map<string,string>"
PAGE_NODE = "file_id string, node_ord int, object_number long, generation int, dict string, count int, declared long"
PAGE_ANCESTOR = "file_id string, page_index int, distance int, dict string"
VIOLATION = "file_id string, ord int, clause string, message string, object_number long"
REFERENCE = "file_id string, object_number long, ref_num long, ref_gen int"
PAGE_LIST = "file_id string, object_number long, kids array<long>, clause string"
TOKEN = "file_id string, seq int, kind string, value string, offset long"
#: Levels of nesting that a path spells out.
PATH_DEPTH = 256
PAYLOAD = "file_id string, object_number long, generation int, kind string, data binary, error string"
SLOT = "file_id string, container long, idx int, object_number long, offset long"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every *.pdf below a path, whatever the case of its suffix, as (file_id, length, content); Spark's source skips empty files."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    )
    return found.select(F.col("path").alias("file_id"), "length", "content")


def _scan(files: DataFrame, schema: str, rows: Callable[[str, kernel.Document], Iterable[tuple]]) -> DataFrame:
    def work(file_id, content):
        try:
            yield from rows(file_id, kernel.parse(bytes(content or b"")))
        except Exception:  # noqa: BLE001 - whatever a file does to its reader is a row of errors()
            return

    return map_rows(files.select("file_id", "content"), schema, work)


def errors(files: DataFrame) -> DataFrame:
    """(file_id, layer, message, normalised, offset): the first error of every file that has one.

    What isn't an error of a layer (nesting that exhausts the stack, say) is
    of the layer ``internal``.
    """

    def work(file_id, content):
        try:
            document = kernel.parse(bytes(content or b""))
            for number, generation, _ in document.live():
                cosjson.dumps(document.get(number, generation))
            if not isinstance(document.catalog(), dict):
                raise PdfError("the catalog is no dictionary")
        except PdfError as error:
            yield file_id, error.layer, str(error), survey.normalise(str(error)), error.offset
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {error}"
            yield file_id, "internal", message, survey.normalise(message), None

    return map_rows(files.select("file_id", "content"), "file_id string, layer string, message string, normalised string, offset long", work)


def headers(files: DataFrame) -> DataFrame:
    def rows(file_id, d):
        yield file_id, d.origin, d.header_version, d.version, d.chain.startxref, len(d.chain.sections), d.size, *d.stop

    return _scan(files, HEADER, rows)


def sections(files: DataFrame) -> DataFrame:
    """Sections, newest first."""

    def rows(file_id, d):
        for k, s in enumerate(d.chain.sections):
            yield file_id, k, s.offset, s.form, len(s.entries), s.own_number, cosjson.dumps(s.trailer)

    return _scan(files, SECTION, rows)


def entries(files: DataFrame) -> DataFrame:
    """Entries of every section as they stand, unmerged; see ``operators.relational.newest_wins``."""

    def rows(file_id, d):
        for k, s in enumerate(d.chain.sections):
            for number, e in s.entries.items():
                yield file_id, k, number, e.kind, e.a, e.b

    return _scan(files, ENTRY, rows)


def slots(files: DataFrame) -> DataFrame:
    """Slots of every object stream that an entry names."""

    def rows(file_id, d):
        for container in sorted({e.a for e in d.entries.values() if e.kind == "compressed"}):
            for k, (number, offset) in enumerate(d._container(container).pairs):
                yield file_id, container, k, number, offset

    return _scan(files, SLOT, rows)


def objects(files: DataFrame) -> DataFrame:
    """Live objects; one that can't be parsed has its error instead of a value."""

    def rows(file_id, d):
        for number, generation, _ in d.live():
            try:
                value = d.get(number, generation)
            except PdfError as error:
                yield file_id, number, generation, None, None, str(error)
            else:
                yield file_id, number, generation, kind_of(value), cosjson.dumps(value), None

    return _scan(files, OBJECT, rows)


def payloads(files: DataFrame) -> DataFrame:
    """Bytes of strings, and decoded data of streams up to the /DL that they declare; what can't be decoded has its error."""

    def rows(file_id, d):
        for number, generation, _ in d.live():
            try:
                value = d.get(number, generation)
                data = filters.decode_stream(value, d.resolve) if isinstance(value, Stream) else value.data if isinstance(value, PdfString) else None
            except PdfError as error:
                yield file_id, number, generation, None, None, str(error)
                continue
            if data is not None:
                most = get(value.dict, "DL") if isinstance(value, Stream) else None
                yield file_id, number, generation, kind_of(value), data if most is None else data[: max(0, d.resolve(most))], None

    return _scan(files, PAYLOAD, rows)


def page_values(files: DataFrame, key: str) -> DataFrame:
    """(file_id, page_index, value): an attribute of every page, inherited or own, as the editor resolves it."""

    def rows(file_id, d):
        made = editor.Editor.of(d)
        for k in range(len(made.pages())):
            yield file_id, k, cosjson.dumps(made.page_attribute(k, key))

    return _scan(files, "file_id string, page_index int, value string", rows)


def count_corrections(files: DataFrame) -> DataFrame:
    """Page-tree nodes whose /Count is wrong: (file_id, object_number, generation, before, after), dictionaries before and after."""

    def rows(file_id, d):
        for ref, (entries_of, count) in pagetree.count_corrections(d).items():
            yield file_id, *ref, cosjson.dumps(entries_of), cosjson.dumps(pagetree.with_count(entries_of, count))

    return _scan(files, "file_id string, object_number long, generation int, before string, after string", rows)


def flat_nodes(file_id, number, generation, value, keys=None) -> Iterable[tuple]:
    """A value and all inside it in pre-order, as rows of the node table; with ``keys`` only what is at or below those of its entries.

    A path goes back to the object, or to the nearest value above at a depth
    that ``PATH_DEPTH`` divides, which it names by node; so paths stay short
    however deep the nesting.
    """
    waiting = [(value, None, 0, "", None, None)]
    node_id = 0
    while waiting:
        item, parent, depth, path, key, ordinal = waiting.pop()
        kind = kind_of(item)
        own, node_id = node_id, node_id + 1
        if depth or keys is None:
            yield (
                file_id, number, generation, own, parent, depth, path, key, ordinal, kind, item if kind == "boolean" else None,
                item if kind == "integer" and abs(item) < 10**38 else None, str(item) if kind == "integer" and abs(item) >= 10**38 else None,
                item if kind == "real" else None, str(item) if kind == "name" else None,
                item.data if kind == "string" else item.raw if kind == "stream" else None, item.form if kind == "string" else None,
                item.number if kind == "ref" else None, item.generation if kind == "ref" else None,
            )
        inside = item.dict if isinstance(item, Stream) else item
        if depth and depth % PATH_DEPTH == 0:
            path = f"#{own}"
        if isinstance(inside, dict):
            below = [(v, own, depth + 1, f"{path}/{k}", str(k), i) for i, (k, v) in enumerate(inside.items()) if depth or keys is None or k in keys]
        elif isinstance(inside, list) and (depth or keys is None):
            below = [(v, own, depth + 1, f"{path}[{i}]", None, i) for i, v in enumerate(inside)]
        else:
            continue
        waiting.extend(reversed(below))


def nodes(files: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row for every value inside every live object, or only for those at or below the named entries of dictionaries."""

    def rows(file_id, d):
        for number, generation, _ in d.live():
            try:
                value = d.get(number, generation)
            except PdfError:
                continue
            yield from flat_nodes(file_id, number, generation, value, keys)

    return _scan(files, NODE, rows)


def reference_rows(files: DataFrame) -> DataFrame:
    """Every reference in live objects, and in the trailer as object 0."""

    def rows(file_id, d):
        live = d.collect()
        for r in references(d.trailer):
            yield file_id, 0, r.number, r.generation
        for number, _, value in live:
            for r in references(value):
                yield file_id, number, r.number, r.generation

    return _scan(files, REFERENCE, rows)


def pages(files: DataFrame) -> DataFrame:
    """Pages in order, each with what it owns or inherits of the inheritable attributes."""

    def rows(file_id, d):
        for p in pagetree.read_page_tree(d).pages:
            known = {k: pagetree.inherited(p, k) for k in pagetree.INHERITABLE}
            told = {k: cosjson.dumps(d.resolve(v)) for k, v in known.items() if v is not None}
            ref = p.ref or Ref(None, None)
            yield file_id, p.index, ref.number, ref.generation, len(p.ancestors), cosjson.dumps(p.dict), told

    return _scan(files, PAGE, rows)


def page_ancestors(files: DataFrame) -> DataFrame:
    """The page's own dictionary at distance 0 and its ancestors', nearest first."""

    def rows(file_id, d):
        for p in pagetree.read_page_tree(d).pages:
            for distance, entries_of in enumerate([p.dict, *p.ancestors]):
                yield file_id, p.index, distance, cosjson.dumps(entries_of)

    return _scan(files, PAGE_ANCESTOR, rows)


def page_nodes(files: DataFrame) -> DataFrame:
    """Page-tree nodes, children before parents, with the pages counted below and the /Count declared."""

    def rows(file_id, d):
        for k, n in enumerate(pagetree.read_page_tree(d).nodes):
            declared = d.resolve(get(n.dict, "Count"))
            declared = declared if isinstance(declared, int) and not isinstance(declared, bool) and abs(declared) < 2**63 else None
            ref = n.ref or Ref(None, None)
            yield file_id, k, ref.number, ref.generation, cosjson.dumps(n.dict), n.count, declared

    return _scan(files, PAGE_NODE, rows)


def violations(files: DataFrame) -> DataFrame:
    def rows(file_id, d):
        for k, (clause, message, number) in enumerate(pagetree.check_page_tree(d)):
            yield file_id, k, clause, message, number

    return _scan(files, VIOLATION, rows)


def page_lists(files: DataFrame) -> DataFrame:
    """What object lists which others as /Kids, and the violations of the page tree, from one reading of every file.

    A row of a list has the objects that the items of a direct array refer
    to, null for other items; a row of a violation has its clause.
    """

    def rows(file_id, d):
        for number, generation, _ in d.live():
            try:
                value = d.get(number, generation)
            except PdfError:
                continue
            kids = (value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}).get("Kids")
            if isinstance(kids, list):
                yield file_id, number, [kid.number if isinstance(kid, Ref) else None for kid in kids], None
        for clause, _, number in pagetree.check_page_tree(d):
            yield file_id, number, None, clause

    return _scan(files, PAGE_LIST, rows)


def tokens(texts: DataFrame) -> DataFrame:
    """Tokens of (file_id, content) taken as bare syntax; a lexical error is a last row of kind error."""

    def work(file_id, content):
        reader = TokenReader(Cursor(bytes(content or b"")))
        seq = 0
        while True:
            try:
                token = reader.take()
            except PdfError as error:
                yield file_id, seq, "error", str(error), error.offset
                return
            if token.kind == "eof":
                return
            value = token.value
            text = value.data.hex() if isinstance(value, PdfString) else str(value) if isinstance(value, Name) else None if value is None else repr(value) if isinstance(value, float) else str(value)
            yield file_id, seq, token.kind, text, token.offset
            seq += 1

    return map_rows(texts.select("file_id", "content"), TOKEN, work)


def round_trips(files: DataFrame) -> DataFrame:
    """(file_id, mode, outcome, detail) of writing every file anew in the three forms."""

    def work(file_id, content):
        def guarded(step, *args):
            try:
                return step(*args)
            except Exception as error:  # noqa: BLE001
                return None, f"{type(error).__name__}: {error}"

        document, problem = guarded(survey.try_parse, bytes(content or b""))
        for mode, xref, packed in survey.MODES:
            outcome, detail = guarded(survey.rewrite_outcome, document, problem, xref, packed)
            yield file_id, mode, outcome or "unreadable", detail

    return map_rows(files.select("file_id", "content"), "file_id string, mode string, outcome string, detail string", work)


def rewritten(files: DataFrame, mode: str) -> DataFrame:
    """(file_id, content) of every file that can be written anew in one form."""
    from ..kernel import writer

    _, xref, packed = next(m for m in survey.MODES if m[0] == mode)

    def work(file_id, content):
        try:
            yield file_id, writer.rewrite(kernel.parse(bytes(content or b"")), xref=xref, object_streams=packed)
        except Exception:  # noqa: BLE001
            return

    return map_rows(files.select("file_id", "content"), "file_id string, content binary", work)
