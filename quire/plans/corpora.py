"""PDF corpora made from the driver's tables, with bounded files.

Files are keyed by a range of ids besides their business key, so that a file
never grows with the table.
"""

from __future__ import annotations

import zlib
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel import filters, writer
from ..kernel.content import ContentStream
from ..kernel.structure import StructureTree
from ..kernel.values import Name, PdfString, Ref, Stream
from ..runtime import Scratch, exists, shared_dir, spread
from ..sources.arrow import map_groups, map_rows

#: Pixels of a predicted row.
COLUMNS = 64
#: Ids that share a file.
PAGES_PER_FILE = 500
FILE = "file_id string, content binary"

_STORED: dict[tuple, DataFrame] = {}


def stored(build=None, *, file_rows: int = 0):
    """Write a corpus once for each application and set of tables, and read it wherever it is used; ``file_rows`` as in ``Scratch.keep``."""
    if build is None:
        return partial(stored, file_rows=file_rows)

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
        key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, build.__name__, *sorted(options.items()))
        held = _STORED.get(key)
        if held is None or not exists(spark, f"{held.quire_path}/_SUCCESS"):
            held = _STORED[key] = Scratch(spark, build.__name__).keep(build(spark, sf_dir, **options), "files", file_rows=file_rows)
        return held

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work in Python on every row."""
    return spread(table(spark, sf_dir, name).select(*columns))


@stored
def page_files(spark: SparkSession, sf_dir: str, *, defects: bool = False) -> DataFrame:
    """(file_id, region, content): a page tree of region, nations and customers.

    Rotations are set on regions, nations and customers by key.  With
    ``defects`` some customers' pages break a rule, by key.
    """
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.select("r_regionkey", "r_name", "n_nationkey", "n_name", "c_custkey", F.floor(F.col("c_custkey") / PAGES_PER_FILE).alias("bucket"))

    def work(key, found):
        return [(f"{key[0]}-{key[1]}", found[0]["r_name"], build_page_file(found, defects))]

    return map_groups(rows, ["r_regionkey", "bucket"], "file_id string, region string, content binary", work)


def rotation(key: int, modulus: int) -> int | None:
    return 90 * (key % 4) if key % modulus == 0 else None


def build_page_file(rows: list[dict], defects: bool = False) -> bytes:
    rows = sorted(rows, key=lambda r: (r["n_nationkey"], r["c_custkey"]))
    nations: dict[int, list[dict]] = {}
    for r in rows:
        nations.setdefault(r["n_nationkey"], []).append(r)
    root = Ref(2)
    numbers = {n: Ref(3 + k) for k, n in enumerate(nations)}
    objects = [(1, 0, {"Type": Name("Catalog"), "Pages": root})]
    at = 3 + len(nations)
    for n, own in nations.items():
        kids = []
        for r in own:
            kids.append(Ref(at))
            objects.append((at, 0, page_of(r, numbers[n], defects)))
            at += 1
        entries = {"Type": Name("Pages"), "Parent": root, "Kids": kids, "Count": len(own) + (defects and n % 5 == 0), "Label": PdfString(own[0]["n_name"].encode())}
        if rotation(n, 3) is not None:
            entries["Rotate"] = rotation(n, 3)
        objects.append((numbers[n].number, 0, entries))
    r = rows[0]
    top = {"Type": Name("Pages"), "Kids": list(numbers.values()), "Count": len(rows), "MediaBox": [0, 0, 612, 792], "Resources": {}}
    if rotation(r["r_regionkey"], 2) is not None:
        top["Rotate"] = rotation(r["r_regionkey"], 2)
    objects.append((2, 0, top))
    return writer.write_file(objects, {"Root": Ref(1)}, version="1.7")


def page_of(r: dict, parent: Ref, defects: bool) -> dict:
    key = r["c_custkey"]
    page = {"Type": Name("Page"), "Parent": parent, "Key": key}
    if rotation(key, 5) is not None:
        page["Rotate"] = rotation(key, 5)
    if defects:
        if key % 7 == 0:
            page["Rotate"] = 45
        if key % 11 == 0:
            page["Contents"] = []
        if key % 13 == 0:
            del page["Parent"]
        elif key % 17 == 0:
            page["Parent"] = {}
    return page


@stored
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document: its text as strings, and as Flate streams without and with predictors.

    Objects 2 and 5 are strings; 3 is plain, 4 has PNG rows of the tag Up, 6
    PNG rows of all five tags in turn, 7 TIFF rows of three components.  /DL
    tells the length without the last row's filling.
    """

    def work(doc_id, text):
        data = (text or "").encode()
        png = {"Predictor": 15, "Columns": COLUMNS}
        forms = {
            3: (data, None), 4: (filters.png_rows(data, COLUMNS), png), 6: (filters.png_rows(data, COLUMNS, (0, 1, 2, 3, 4)), png),
            7: (filters.tiff_rows(data, COLUMNS, 3), {"Predictor": 2, "Columns": COLUMNS, "Colors": 3}),
        }
        objects = [(1, 0, {"Type": Name("Catalog")}), (2, 0, PdfString(data)), (5, 0, PdfString(data, "hex"))]
        for number, (rows, parms) in forms.items():
            more = {} if parms is None else {"DecodeParms": [parms]}
            objects.append((number, 0, Stream({"Filter": [Name("FlateDecode")], "DL": len(data), **more}, zlib.compress(rows, 1))))
        yield str(doc_id), writer.write_file(objects, {"Root": Ref(1)})

    return map_rows(rows_of(spark, sf_dir, "documents", "doc_id", "text"), FILE, work)


#: Event ids that share a user's file, which bounds its revisions.
EVENTS_PER_FILE = 10_000


@stored
def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one object that every event of a user revises."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value", F.floor(F.col("event_id") / EVENTS_PER_FILE).alias("bucket")
    )

    def work(key, rows):
        rows = sorted(rows, key=lambda r: (r["ts"], r["event_id"]))
        value = lambda r: {"Ts": r["ts"], "Id": r["event_id"], "Value": float(r["value"])}
        out = bytearray(writer.write_file([(1, 0, {"Type": Name("Catalog")}), (2, 0, value(rows[0]))], {"Root": Ref(1)}))
        start = writer.find_last_startxref(out)
        for k, r in enumerate(rows[1:]):
            tail, start = writer.update_tail(
                len(out), [(2, 0, value(r))], [], previous=start, previous_size=3 + k, trailer={"Root": Ref(1)},
                xref="stream" if k % 3 == 2 else "table", stream_number=3 + k,
            )
            out += tail
        return [(f"{key[0]}-{key[1]}", bytes(out))]

    return map_groups(events, ["user_id", "bucket"], FILE, work)


@stored
def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dictionaries in object streams, 500 keys to a file."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.floor(F.col("o_orderkey") / 500).alias("bucket"))

    def work(key, rows):
        objects = [(1, 0, {"Type": Name("Catalog")})]
        for k, r in enumerate(sorted(rows, key=lambda r: r["o_orderkey"])):
            objects.append((2 + k, 0, {"Key": r["o_orderkey"], "Price": float(r["o_totalprice"]), "Status": Name(r["o_orderstatus"])}))
        return [(str(key[0]), writer.write_file(objects, {"Root": Ref(1)}, version="1.5", xref="stream", object_streams=True))]

    return map_groups(orders, ["bucket"], FILE, work)


class _Sink:
    def __init__(self, first: int):
        self.next, self.objects = first, []

    def reserve(self) -> Ref:
        self.next += 1
        return Ref(self.next - 1)

    def write(self, ref: Ref, value) -> None:
        self.objects.append((ref.number, ref.generation, value))


#: Turns of a conversation that share a file, and pages that they are drawn on.
TURNS, PAGES = 256, 3


@stored
def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged document for each conversation: an element for each role, an item with the whole text for each turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURNS).alias("bucket"))

    def work(key, found):
        found = sorted(found, key=lambda r: (r["turn"], r["role"] or "", r["text"] or ""))
        tree = StructureTree()
        top = tree.element("Document", title=str(key[0]))
        roles = {role: tree.element("P", top, title=role) for role in sorted({r["role"] or "" for r in found})}
        streams = [tree.stream(Ref(3 + k), ContentStream()) for k in range(PAGES)]
        for r in found:
            text = PdfString((r["text"] or "").encode())
            if r["turn"] < 2 * PAGES:  # a running head on every page, and a rule under it
                streams[r["turn"] % PAGES].artifact(lambda c: c.op("BT").op("ET"), "Header" if r["turn"] < PAGES else None)
            streams[r["turn"] % PAGES].item(roles[r["role"] or ""], lambda c: c.op("BT").op("Tj", text).op("ET"))  # noqa: B023
        sink = _Sink(3 + 2 * PAGES)
        built = tree.finish(sink)
        pages = []
        for k, s in enumerate(streams):
            own = {"StructParents": built.keys[s]} if s in built.keys else {}
            pages.append((3 + k, 0, {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 9, 9], "Resources": {}, "Contents": Ref(3 + PAGES + k), **own}))
            pages.append((3 + PAGES + k, 0, Stream({}, s.finish())))
        catalog = {"Type": Name("Catalog"), "Pages": Ref(2), "MarkInfo": built.mark_info, "StructTreeRoot": built.root}
        tree_root = {"Type": Name("Pages"), "Kids": [Ref(3 + k) for k in range(PAGES)], "Count": PAGES}
        objects = [(1, 0, catalog), (2, 0, tree_root), *pages, *sink.objects]
        return [(f"{key[0]}-{key[1]}", writer.write_file(objects, {"Root": Ref(1)}))]

    return map_groups(rows, ["conv_id", "bucket"], FILE, work)


#: How a file of a supplier's key modulo 6 is damaged.
DAMAGE = ("none", "header", "startxref", "offset", "entry", "catalog")


@stored
def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file for each supplier, damaged by key."""

    def work(key, name):
        kind = DAMAGE[key % len(DAMAGE)]
        catalog = PdfString(b"x") if kind == "catalog" else {"Type": Name("Catalog"), "Name": PdfString(name.encode())}
        data = writer.write_file([(1, 0, catalog)], {"Root": Ref(1)})
        if kind == "header":
            data = data.replace(b"%PDF-", b"%XXX-")
        elif kind == "startxref":
            data = data.replace(b"startxref\n", b"startxxxx\n")
        elif kind == "offset":
            data = data.replace(b"startxref\n%d" % writer.find_last_startxref(data), b"startxref\n9999999")
        elif kind == "entry":
            data = data.replace(b" 00000 n \n", b" 00000 n\n")
        yield f"{key:09d}", data

    return map_rows(rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_name"), FILE, work)
