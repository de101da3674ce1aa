"""Registered queries over file shapes, refusals, edits and functions that the queries of ``catalog`` don't reach.

As there, files are built from tables and read back, and the SQL asks the
tables directly.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..kernel import declare, fixture, fonts, pagetree, writer
from ..kernel.content import ContentError, ContentStream
from ..kernel.editor import Editor
from ..kernel.values import Name, PdfError, PdfString, Ref, Refusal, Stream
from ..operators import relational as rel
from ..runtime import Scratch
from ..sources import scan, sink
from ..sources.arrow import map_groups, map_rows, map_tables
from . import corpora
from .corpora import FILE, rows_of, stored, table

CATALOG = (1, 0, {"Type": Name("Catalog")})
ROOT = {"Root": Ref(1)}




def _key() -> Column:
    return F.col("file_id").cast("long")


# Corpora.


@stored
def hybrid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return map_rows(rows, FILE, lambda k, name: [(str(k), fixture.hybrid_file((name or "").encode(), k))])


@stored
def length_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "part", "p_partkey", "p_name")
    return map_rows(rows, FILE, lambda k, name: [(str(k), fixture.length_file((name or "").encode(), k % 3))])


@stored
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = fixture.HISTORIES
    return map_rows(rows_of(spark, sf_dir, "supplier", "s_suppkey"), FILE, lambda k: [(str(k), fixture.history_file(k, kinds[k % len(kinds)]))])


VERSIONS = (None, "1.3", "1.7", "2.0", "x")


@stored
def version_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header says 1.4; the catalog may name another version, and has an entry that is null."""

    def work(k):
        named = VERSIONS[k % len(VERSIONS)]
        catalog = {"Type": Name("Catalog"), "Empty": None} | ({} if named is None else {"Version": Name(named)})
        yield str(k), writer.write_file([(1, 0, catalog)], ROOT, version="1.4")

    return map_rows(rows_of(spark, sf_dir, "customer", "c_custkey"), FILE, work)


@stored
def created_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made from nothing by the editor, a page for each customer of a nation and key range.

    The catalog refers to object 4, which nothing defines, so no page gets
    that number.  The page tree's count is left wrong for the save to settle.
    """
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_custkey") / corpora.PAGES_PER_FILE).alias("bucket"))

    def work(key, found):
        made = Editor.create("1.6")
        made.set(made.catalog_ref.number, made.catalog() | {"Later": Ref(4)})
        page = lambda k: {"Type": Name("Page"), "Parent": made.pages_ref, "MediaBox": [0, 0, 9, 9], "Resources": {}, "Key": k}
        kids = [made.allocate(page(r["c_custkey"])) for r in sorted(found, key=lambda r: r["c_custkey"])]
        made.set(made.pages_ref.number, made.get(2) | {"Kids": kids})
        doomed, info = made.allocate(1), made.allocate({})
        made.delete(doomed.number)
        for name, value in (("Info", info), ("Extra", 1)):
            made.set_trailer_entry(name, value)
        made.remove_trailer_entry("Extra")
        numbers = [n for n, _, _ in made.changed()]
        told = {"Changed": len(numbers), "Ordered": numbers == sorted(numbers), "Gone": made.deleted()[0][0] == doomed.number, "Dirty": made.dirty}
        made.set(info.number, told | {"Null": made.resolve(doomed) is None})
        return [(f"{key[0]}-{key[1]}", made.save(xref="stream", object_streams=True))]

    return map_groups(rows, ["c_nationkey", "bucket"], FILE, work)


#: Orders that share a file.
ORDERS_PER_FILE = 256


@stored(file_rows=128)  # of about 140 kB each
def shared_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page-tree node for each order; its lines are kids, and lines of a part and of the even part below it are one page."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_orderkey") / ORDERS_PER_FILE).alias("bucket"))

    def work(key, found):
        found = found.sort_by([("l_orderkey", "ascending"), ("l_linenumber", "ascending")])
        orders: dict[int, list[int]] = {}
        for order, part in zip(found.column("l_orderkey").to_pylist(), found.column("l_partkey").to_pylist()):
            orders.setdefault(order, []).append(part)
        objects, tops, total = [], [], 0
        for lines in orders.values():
            node = Ref(3 + len(objects))
            parts = set(lines)
            shown = [even if (even := part // 2 * 2) in parts else part for part in lines]
            numbers = {part: Ref(node.number + 1 + k) for k, part in enumerate(sorted(set(shown)))}
            objects.append((node.number, 0, {"Type": Name("Pages"), "Parent": Ref(2), "Kids": [numbers[p] for p in shown], "Count": len(shown)}))
            page = {"Type": Name("Page"), "Parent": node, "MediaBox": [0, 0, 9, 9], "Resources": {}}
            objects += [(n.number, 0, page) for n in numbers.values()]
            tops.append(node)
            total += len(shown)
        root = {"Type": Name("Pages"), "Kids": tops, "Count": total}
        return [(str(key[0]), writer.write_file([(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2)}), (2, 0, root), *objects], ROOT))]

    return map_tables(rows, ["bucket"], FILE, work)


@stored
def font_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content, error): a composite font for each part, over a program that its key chooses."""
    kinds = list(fixture.PROGRAMS)

    def work(k, name):
        objects = [CATALOG]

        def allocate(value):
            objects.append((len(objects) + 1, 0, value))
            return Ref(len(objects))

        try:
            program = fonts.sniff(fixture.font_program(kinds[k % len(kinds)]) + (name or "").encode())
            _, notes = fonts.composite_font(allocate, program, "Face", {"Flags": 4}, subset=k % 2 == 0, default_width=500, to_unicode=Name("Identity-H"))
        except PdfError as error:
            yield str(k), None, str(error)
            return
        objects[0] = (1, 0, {"Type": Name("Catalog"), "Notes": PdfString(",".join(notes).encode())})
        yield str(k), writer.write_file(objects, ROOT), None

    return map_rows(rows_of(spark, sf_dir, "part", "p_partkey", "p_name"), f"{FILE}, error string", work)


@stored
def drawn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content, error): a content stream for each customer, whose operands the key chooses."""
    operands = ([1, [2, {"A": Name("b")}]], [[Ref(1)]], {"A": [Stream({}, b"")]}, 1)

    def work(k):
        drawn = ContentStream()
        seen = {}
        try:
            drawn.op("q").op("BT").op("MP", Name("Mark"))
            drawn.op("DP", Name("Mark"), operands[k % len(operands)])
            seen = {"Context": Name(drawn.context), "Open": [Name(b) for b in drawn.open_brackets]}
            drawn.op("ET")
            if k % 4 != 3:
                drawn.op("Q")
            body = drawn.finish()
        except ContentError as error:
            yield str(k), None, str(error)
            return
        yield str(k), writer.write_file([(1, 0, {"Type": Name("Catalog"), **seen}), (2, 0, Stream({}, body))], ROOT), None

    return map_rows(rows_of(spark, sf_dir, "customer", "c_custkey"), f"{FILE}, error string", work)


@stored
def declared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content, error): what declaring a level writes for each customer, or all rules that are unmet."""

    def work(k, name):
        level = declare.LEVELS[k % len(declare.LEVELS)]
        facts = declare.Facts(
            title=f'{name} <"&">' if k % 7 else None, lang="en" if k % 5 else None, viewer_preferences={"DisplayDocTitle": True}, mark_info={"Marked": True},
            struct_tree_root=Ref(9) if k % 3 else None, output_intents=({"S": "GTS_PDFA1", "DestOutputProfile": Ref(8)},) if k % 6 else (), has_file_identifier=True,
            encrypted=k % 11 == 0, embedded_files=({"AFRelationship": Name("Data")},) if k % 13 == 0 else (), create_date="2020-01-02" if k % 2 else None,
        )
        try:
            told = declare.declare(level, facts)
        except Refusal as refusal:
            yield str(k), None, ",".join(clause for clause, _, _ in refusal.violations)
            return
        catalog = {"Type": Name("Catalog"), "Metadata": Ref(2), "Checked": len(told.checked), "Unchecked": len(told.unchecked) > 0, **told.catalog_entries}
        yield str(k), writer.write_file([(1, 0, catalog), (2, 0, Stream({"Type": Name("Metadata")}, told.xmp))], ROOT), None

    return map_rows(rows_of(spark, sf_dir, "customer", "c_custkey", "c_name"), f"{FILE}, error string", work)


FILTERS = (["FlateDecode"], ["LZWDecode"], ["FlateDecode"], [])


@stored
def filter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams under the filters above; every third of four is cut off."""

    def work(k, name):
        data = (name or "").encode()
        packed = zlib.compress(data)
        body = (packed, data, packed[:-2], data)[k % len(FILTERS)]
        yield str(k), fixture.filter_file(body, FILTERS[k % len(FILTERS)])

    return map_rows(rows_of(spark, sf_dir, "part", "p_partkey", "p_name"), FILE, work)


EOLS = (b" \n", b"\r\n", b" \r")


@stored
def junk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together by hand: bytes before the header, the three ends of an entry, object 2 written before object 1."""

    def work(k, name):
        bodies = {2: b"2 0 obj\n%d\nendobj\n" % k, 1: fixture.CATALOG}
        yield str(k), fixture.table_file(bodies, junk=(name or "").encode() * (k % 2), eol=EOLS[k % 3], more=b"/Key %d" % k)

    return map_rows(rows_of(spark, sf_dir, "part", "p_partkey", "p_name"), FILE, work)


@stored
def updated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, with an update that has an object for every part that it delivers."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()

    def work(key, found):
        base = writer.write_file([CATALOG], ROOT)
        objects = [(r["l_partkey"] + 1, 0, r["l_partkey"]) for r in found]
        return [(str(key[0]), writer.append_update(base, objects, [], previous=writer.find_last_startxref(base), previous_size=2, trailer=ROOT))]

    return map_groups(rows, ["l_suppkey"], FILE, work)


#: Parts that share a file.
PARTS_PER_FILE = 100


@stored
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a hundred parts as the objects of a file, in the order of their keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / PARTS_PER_FILE).alias("bucket"))

    def work(key, found):
        objects = [CATALOG, *((2 + r["p_partkey"] % PARTS_PER_FILE, 0, PdfString((r["p_name"] or "").encode())) for r in found)]
        return [(str(key[0]), writer.write_file(objects, ROOT, version="1.7"))]

    return map_groups(rows, ["bucket"], FILE, work)


# Queries.


def junk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where headers begin, and what is read behind them."""
    files = junk_files(spark, sf_dir)
    numbers = scan.nodes(files).where("object_number = 2").select("file_id", F.col("int_v").cast("long").alias("number"))
    keys = scan.sections(files).select("file_id", udfs.cos_entries("trailer")["Key"].cast("long").alias("trailer_key"))
    return scan.headers(files).select("file_id", "origin", "size").join(numbers, "file_id").join(keys, "file_id").withColumn("p_partkey", _key()).drop("file_id")


def written_subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the object numbers in the newest section of every supplier's file."""
    found = scan.entries(updated_files(spark, sf_dir)).where("section_ord = 0 and kind = 'in-use'")
    runs = rel.runs(found, "file_id", "object_number")
    return runs.select(_key().alias("l_suppkey"), (F.col("first") - 1).alias("first"), "count")


def object_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the objects of a file begin."""
    found = scan.entries(named_files(spark, sf_dir)).where("kind = 'in-use' and object_number > 1")
    key = _key() * PARTS_PER_FILE + F.col("object_number") - 2
    return found.select(key.alias("p_partkey"), F.col("a").alias("offset"))


def hybrid_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid's table wins over its stream, which adds what the table lacks."""
    files = hybrid_files(spark, sf_dir)
    names = scan.payloads(files).where("object_number = 2").select("file_id", F.decode("data", "UTF-8").alias("name"))
    numbers = scan.nodes(files).where("object_number = 3").select("file_id", F.col("int_v").cast("long").alias("number"))
    forms = scan.sections(files).select("file_id", "form", F.col("n_entries").cast("long").alias("n_entries"))
    return names.join(numbers, "file_id").join(forms, "file_id").select(_key().alias("s_suppkey"), "name", "number", "form", "n_entries")


def indirect_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams by the way in which their length is told."""
    found = scan.payloads(length_files(spark, sf_dir)).where("object_number = 3")
    return found.select(_key().alias("p_partkey"), F.decode("data", "UTF-8").alias("text"), "error")


def truncated_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where older sections can't be read, a rewrite is refused and an update is not."""
    files = history_files(spark, sf_dir)
    stops = scan.headers(files).select("file_id", "stop_kind", F.col("n_sections").cast("long").alias("n_sections"))
    written = scan.round_trips(files).where("mode = 'stream'").select("file_id", F.col("outcome").alias("rewrite"))
    edits = files.select("file_id", F.expr("array(struct('set' AS action, 5L AS object_number, 0 AS generation, '7' AS cos))").alias("edits"))
    updated = sink.apply_edits(files, edits)
    appended = scan.headers(updated).select("file_id", F.col("stop_kind").alias("appended_stop"))
    saved = sink.apply_edits(files, edits, mode="save").select("file_id", F.col("error").isNull().alias("saved"))
    found = stops.join(written, "file_id").join(appended, "file_id").join(saved, "file_id")
    return found.select(_key().alias("s_suppkey"), "stop_kind", "n_sections", "rewrite", "appended_stop", "saved")


def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of header and catalog; a catalog version that is none fails the file.  Null entries stay in dictionaries."""
    files = version_files(spark, sf_dir)
    told = files.select("file_id").join(scan.headers(files).select("file_id", "version"), "file_id", "left")
    bad = scan.errors(files).select("file_id", "layer")
    empty = scan.nodes(files).where("path = '/Empty' and kind = 'null'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_null"))
    return told.join(bad, "file_id", "left").join(empty, "file_id", "left").select(_key().alias("c_custkey"), "version", "layer", F.coalesce("n_null", F.lit(0)).alias("n_null"))


def created_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, numbers and trailer of documents that the editor made and saved."""
    files = created_files(spark, sf_dir)
    tree = scan.page_nodes(files).select("file_id", F.col("count").cast("long").alias("pages"), "declared")
    nodes = scan.nodes(files)
    numbers = nodes.where("path = '/Key'").groupBy("file_id").agg(F.min("object_number").alias("lowest"), F.max("object_number").alias("highest"))
    told = nodes.where("path in ('/Changed', '/Ordered', '/Gone', '/Dirty', '/Null')").groupBy("file_id").agg(
        F.max("int_v").cast("long").alias("changed"), F.min("bool_v").alias("all_true")
    )
    trailers = scan.sections(files).select("file_id", F.map_keys(udfs.cos_entries("trailer")).alias("keys"))
    named = trailers.select("file_id", F.array_contains("keys", "Info").alias("info"), F.array_contains("keys", "Extra").alias("extra"))
    versions = scan.headers(files).select("file_id", "version")
    found = tree.join(numbers, "file_id").join(told, "file_id").join(named, "file_id").join(versions, "file_id")
    return found.select("file_id", "pages", "declared", "lowest", "highest", "changed", "all_true", "info", "extra", "version")


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the created documents by the kind of what they name; a missing object is null."""
    files = created_files(spark, sf_dir)
    found = rel.lookup(scan.reference_rows(files), scan.objects(files))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))


def page_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses in the refusals of saving files whose page tree breaks rules; each names all of them."""
    files = corpora.page_files(spark, sf_dir, defects=True)
    edits = files.select("file_id", F.expr("array(struct('allocate' AS action, 0L AS object_number, 0 AS generation, '7' AS cos))").alias("edits"))
    refused = sink.apply_edits(files, edits, mode="save").where("content is null")
    clauses = refused.select("file_id", F.explode(F.regexp_extract_all("error", F.lit(r"(R-7\.7\.3\.3-[0-9]+):"), 1)).alias("clause"))
    return clauses.groupBy("clause").agg(F.count(F.lit(1)).alias("n"))


def edited_page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rotation as the editor resolves it."""
    files = corpora.page_files(spark, sf_dir)
    keys = scan.page_values(files, "Key").withColumnRenamed("value", "key")
    found = keys.join(scan.page_values(files, "Rotate"), ["file_id", "page_index"])
    return found.select(F.col("key").cast("long").alias("c_custkey"), F.coalesce(F.expr("try_cast(value AS int)"), F.lit(0)).alias("rotation"))


def settled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The /Count that a save would write instead of a wrong one."""
    found = scan.count_corrections(corpora.page_files(spark, sf_dir, defects=True))
    count = lambda c: udfs.cos_entries(c)["Count"].cast("long")
    return found.select(udfs.cos_text(F.col("after"), F.lit("Label")).alias("nation"), count("before").alias("before"), count("after").alias("after")).groupBy("nation").agg(
        F.sum("before").alias("before"), F.sum("after").alias("after")
    )


def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kids that the page tree lists again, by a window over the lists and by the walk."""
    lists = Scratch(spark, "page_lists").keep(scan.page_lists(shared_page_files(spark, sf_dir)), "lists")
    kids = lists.where("clause is null").select("file_id", "object_number", F.posexplode("kids").alias("ordinal", "ref_num")).where("ref_num is not null")
    visits = kids.select("file_id", "ref_num", F.struct("object_number", "ordinal").alias("visit"))
    later = rel.later_visits(visits, ["file_id", "ref_num"], "visit").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_later"))
    walked = lists.where(F.col("clause") == pagetree.DUPLICATE).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_walked"))
    return later.join(walked, "file_id", "full_outer").select(_key().alias("bucket"), "n_later", "n_walked")


def composite_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four objects of every part's font, read back by number."""
    files = font_files(spark, sf_dir)
    nodes = scan.nodes(files.where("content is not null"))
    at = lambda number, path, column: F.max(F.when((F.col("object_number") == number) & (F.col("path") == path), F.col(column)))
    kind = F.max(F.when((F.col("object_number") == 3) & F.col("key").startswith("FontFile"), F.col("key")))
    found = nodes.groupBy("file_id").agg(
        at(5, "/BaseFont", "name_v").alias("base"), at(4, "/Subtype", "name_v").alias("subtype"), kind.alias("file_key"),
        at(2, "/Subtype", "name_v").alias("program"), at(2, "/Length1", "int_v").cast("long").alias("length1"), at(4, "/CIDToGIDMap", "name_v").alias("map"),
        at(5, "/Encoding", "name_v").alias("encoding"), F.decode(at(1, "/Notes", "bytes_v"), "UTF-8").alias("notes"),
    )
    return files.select("file_id", "error").join(found, "file_id", "left").withColumn("p_partkey", _key()).drop("file_id")


def operand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a content stream says of itself amid its operators, or why it was refused."""
    files = drawn_files(spark, sf_dir)
    nodes = scan.nodes(files.where("content is not null")).where("object_number = 1 and kind = 'name'")
    seen = nodes.groupBy("file_id").agg(
        F.max(F.when(F.col("path") == "/Context", F.col("name_v"))).alias("context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("path").startswith("/Open"), F.struct("ordinal", "name_v")))), lambda x: x["name_v"]), " ").alias("open"),
    )
    return files.select("file_id", "error").join(seen, "file_id", "left").withColumn("c_custkey", _key()).drop("file_id")


def declared_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata packet and catalog entries of every declaration, or the unmet rules."""
    files = declared_files(spark, sf_dir)
    written = files.where("content is not null")
    packets = scan.payloads(written).where("object_number = 2").select("file_id", F.md5("data").alias("xmp"))
    catalogs = scan.objects(written).where("object_number = 1").select("file_id", udfs.cos_entries("cos").alias("c"))
    told = catalogs.select("file_id", F.col("c")["Checked"].cast("long").alias("checked"), (F.col("c")["Unchecked"] == "True").alias("unchecked"), F.col("c")["Lang"].isNotNull().alias("lang"))
    return files.select("file_id", "error").join(packets, "file_id", "left").join(told, "file_id", "left").withColumn("c_custkey", _key()).drop("file_id")


def page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-content operators of every page of a conversation; artifacts have no id."""
    drawn = scan.payloads(corpora.conversation_files(spark, sf_dir)).where("kind = 'stream'")
    place = F.concat("file_id", F.lit("-"), (F.col("object_number") - 3 - corpora.PAGES).cast("string"))
    words = scan.tokens(drawn.select(place.alias("file_id"), F.col("data").alias("content"))).where("kind in ('keyword', 'name')")
    count = lambda kind, value: F.sum(F.when((F.col("kind") == kind) & (F.col("value") == value), 1).otherwise(0)).alias(value.lower())
    parts = F.split("file_id", "-")
    by_page = words.groupBy(parts[0].cast("long").alias("conv_id"), parts[2].cast("int").alias("page"))
    return by_page.agg(count("keyword", "BMC"), count("keyword", "BDC"), count("keyword", "EMC"), count("name", "Artifact"), count("name", "MCID"))


def refused_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams under known, unknown and no filters, and damaged data; new streams aren't compressed."""
    found = scan.payloads(filter_files(spark, sf_dir)).where("object_number = 2")
    return found.select(_key().alias("p_partkey"), F.decode("data", "UTF-8").alias("text"), "error", udfs.encoding_refusal(F.lit("FlateDecode")).alias("encoding"))


def inflate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second inflater reads the same from every compressed name, whole and cut off, as the library."""
    objects = scan.objects(filter_files(spark, sf_dir)).where("object_number = 2")
    raw = objects.select(_key().alias("p_partkey"), udfs.cos_raw(F.col("cos")).alias("raw"))
    return raw.select("p_partkey", udfs.inflate_differs("raw").alias("differs"), udfs.inflate("raw").isNotNull().alias("readable"))


def newest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest section of every user's files, read alone at its offset."""
    udfs.register(spark)
    files = corpora.event_files(spark, sf_dir)
    starts = scan.headers(files).select("file_id", "startxref", "origin")
    files.join(starts, "file_id").createOrReplaceTempView("quire_newest")
    found = spark.sql("SELECT file_id, x.object_number FROM quire_newest, LATERAL pdf_xref_section(content, startxref, origin) x WHERE x.object_number = 2")
    return found.groupBy(F.split("file_id", "-")[0].cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n_files"))


def files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files stored below folders and found again whatever the case of their suffix."""
    folder = Scratch(spark, "disk").root.removeprefix("file://").removeprefix("file:")
    suffix = F.when(_key() % 3 == 0, ".txt").when(_key() % 3 == 1, ".pdf").otherwise(".PDF")
    named = hybrid_files(spark, sf_dir).withColumn("name", F.concat((_key() % 7).cast("string"), F.lit("/"), F.col("file_id"), suffix))
    n = sink.write_files(named, folder).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found = scan.read_files(spark, f"file://{folder}")
    origin = found.groupBy(F.lower(F.substring("file_id", -4, 4)).alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"))
    return origin.withColumn("n_written", F.lit(n).cast("long"))


def complaints_of_a_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations that one version of the page files has and the other hasn't."""
    before, after = (scan.violations(corpora.page_files(spark, sf_dir, defects=d)) for d in (False, True))
    return rel.new_complaints(before, after, ["file_id", "clause", "object_number"]).groupBy("clause").agg(F.count(F.lit(1)).alias("n"))


def pinned_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a manifest in which some digests are wrong, some files lack and some are unknown."""
    files = hybrid_files(spark, sf_dir)
    digest = F.when(_key() % 5 == 0, F.lit("0")).otherwise(F.sha2("content", 256))
    manifest = files.select("file_id", F.octet_length("content").cast("long").alias("length"), digest.alias("sha256")).where(_key() % 7 > 0)
    found = rel.manifest_check(files.where(_key() % 11 > 0), manifest)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def axis_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the page files by axis."""
    files = corpora.page_files(spark, sf_dir)
    nations = scan.page_nodes(files).groupBy("file_id").agg((F.count(F.lit(1)) - 1).cast("string").alias("n"))
    axes = files.join(nations, "file_id").select(F.create_map(F.lit("region"), F.col("region"), F.lit("nations"), F.col("n")).alias("axes"))
    return rel.axis_coverage(axes)


def role_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans-pages decision as a plan over the turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", (F.col("turn") % corpora.PAGES).alias("page"))
    return rel.spans_pages(turns, ["conv_id", "role"], "page")


def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text by syntactic class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", udfs.byte_classes(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c"))
    return docs.select("doc_id", *[F.col("c")[k].alias(f"n_{k}") for k in udfs.CLASSES])


#: Syntax with one fault, the message, and the offset at which it is reported.
FAULTS = (
    ("1 (abc", "a literal string has no end", 2), ("<< <4", "a hexadecimal string has no end", 3), ("  )", "unexpected ')'", 2),
    ("/N <4G>", "'G' in a hexadecimal string", 5), ("[+.]", "a number without digits", 1), ("9" * 4001, "an integer of more than 4000 digits", 0),
)


def lexical_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that ends the tokens of broken syntax, with its place."""
    texts = F.array(*[F.lit(f) for f, _, _ in FAULTS])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_id"), F.encode(texts[(F.col("s_suppkey") % len(FAULTS)).cast("int")], "UTF-8").alias("content"))
    found = scan.tokens(rows).where("kind = 'error'")
    return found.select(_key().alias("s_suppkey"), F.col("value").alias("message"), "offset", F.col("seq").cast("long").alias("seq"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_sections, indirect_lengths, truncated_histories, catalog_versions, created_documents, dangling_references, page_refusals, edited_page_values,
        settled_counts, duplicate_pages, composite_fonts, operand_rules, declared_conformance, page_artifacts, refused_filters, inflate_agreement,
        junk_headers, written_subsections, object_offsets, newest_sections, files_on_disk, complaints_of_a_rewrite, pinned_manifest, axis_shapes, role_spans, byte_classes, lexical_errors,
    )
}


# SQL.

_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_BUCKETS = f"(SELECT c_nationkey || '-' || c_custkey // {corpora.PAGES_PER_FILE} AS file_id, count(*) AS n FROM customer GROUP BY ALL)"


def _cases(column: str, values) -> str:
    """CASE over a column's value, from 0."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {shown(v)}" for k, v in enumerate(values)) + " END"


def _tag_sql() -> str:
    """Six letters of the 32-bit FNV-1a hash of a program's head, which is known, and a name of ASCII characters."""
    heads = []
    for kind in fixture.PROGRAMS:
        value = 2166136261
        for byte in fixture.font_program(kind):
            value = (value ^ byte) * 16777619 % 2**32
        heads.append(value)
    state = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(heads)) + " END"
    codes = "list_transform(list_filter(string_split(p_name, ''), lambda x: x <> ''), lambda x: ord(x)::UBIGINT)"
    value = f"list_reduce([({state})::UBIGINT] || {codes}, lambda a, x: (xor(a, x) * 16777619) % 4294967296)"
    letters, left = [], "h"
    for k in range(6):
        letters.append(f"chr(65 + (({left}) % 26)::INTEGER)")
        left = f"(({left}) // 26 + {7 * k})"
    return f"(SELECT p_partkey, {' || '.join(letters)} || '+' AS tag FROM (SELECT p_partkey, {value} AS h FROM part))"


def _packet_sql() -> str:
    """The metadata packet of a level over the columns title, lang and made, which are null where they are absent."""
    nl = "chr(10)"
    begin = "'<?xpacket begin=\"' || chr(65279) || '\" id=\"W5M0MpCehiHzreSzNTczkc9d\"?>' || " + nl + " || '<x:xmpmeta xmlns:x=\"adobe:ns:meta/\">' || " + nl
    begin += " || '  <rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\">' || " + nl
    line = lambda depth, text: f"'{'  ' * depth}{text}' || {nl}"
    about = lambda ns, url: line(2, f'<rdf:Description rdf:about="" xmlns:{ns}="{url}">')
    close = line(2, "</rdf:Description>")
    tag = lambda name, value: line(3, f"<{name}>{value}</{name}>")
    pdfa = about("pdfaid", "http://www.aiim.org/pdfa/ns/id/")
    identity = " ".join(
        f"WHEN '{level}' THEN {' || '.join([head, *[tag(n, v) for n, v in tags], close])}"
        for level, head, tags in (
            ("pdfua-1", about("pdfuaid", "http://www.aiim.org/pdfua/ns/id/"), [("pdfuaid:part", "1")]), ("pdfa-3b", pdfa, [("pdfaid:part", "3"), ("pdfaid:conformance", "B")]),
            ("pdfa-4", pdfa, [("pdfaid:part", "4"), ("pdfaid:rev", "2020")]), ("pdfa-4f", pdfa, [("pdfaid:part", "4"), ("pdfaid:conformance", "F"), ("pdfaid:rev", "2020")]),
        )
    )
    escaped = "replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    title = line(3, "<dc:title>") + " || " + line(4, "<rdf:Alt>") + f" || '          <rdf:li xml:lang=\"x-default\">' || {escaped} || '</rdf:li>' || {nl} || " + line(4, "</rdf:Alt>") + " || " + line(3, "</dc:title>")
    lang = line(3, "<dc:language>") + " || " + line(4, "<rdf:Bag>") + f" || '          <rdf:li>' || lang || '</rdf:li>' || {nl} || " + line(4, "</rdf:Bag>") + " || " + line(3, "</dc:language>")
    dc = f"CASE WHEN title IS NULL AND lang IS NULL THEN '' ELSE {about('dc', 'http://purl.org/dc/elements/1.1/')} || coalesce({title}, '') || coalesce({lang}, '') || {close} END"
    xmp = f"CASE WHEN made IS NULL THEN '' ELSE {about('xmp', 'http://ns.adobe.com/xap/1.0/')} || '      <xmp:CreateDate>' || made || '</xmp:CreateDate>' || {nl} || {close} END"
    end = line(1, "</rdf:RDF>") + f" || '</x:xmpmeta>' || {nl} || '<?xpacket end=\"w\"?>' || {nl}"
    return f"{begin} || CASE level {identity} END || {dc} || {xmp} || {end}"


def _count(chars: str) -> str:
    return f"(length(t) - length(translate(t, '{chars}', '')))"


_WHITE = "(" + " + ".join(f"(length(t) - length(replace(t, chr({c}), '')))" for c in (0, 9, 10, 12, 13, 32)) + ")"
_LINES = "(" + " + ".join(f"(length(t) - length(replace(t, chr({c}), '')))" for c in (10, 13)) + ")"
_MARKS = _count("()<>[]{}/%")
_VALUES = " + ".join(f"{v} * {_count(d if d.isdigit() else d + d.upper())}" for v, d in enumerate("0123456789abcdef") if v)

ORACLES: dict[str, str] = {
    "junk_headers": """
SELECT p_partkey, CASE p_partkey % 2 WHEN 1 THEN strlen(p_name) ELSE 0 END AS origin, 3::BIGINT AS size, p_partkey AS number, p_partkey AS trailer_key FROM part""",
    "written_subsections": """
SELECT l_suppkey, min(l_partkey) AS first, count(*) AS count FROM (
  SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS island
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, island""",
    "object_offsets": f"""
SELECT p_partkey, (49 + coalesce(sum(strlen(p_name) + 17 + length((p_partkey % {PARTS_PER_FILE} + 2)::VARCHAR)) OVER (
  PARTITION BY p_partkey // {PARTS_PER_FILE} ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM part""",
    "hybrid_sections": "SELECT s_suppkey, s_name AS name, s_suppkey AS number, 'hybrid' AS form, 4::BIGINT AS n_entries FROM supplier",
    "indirect_lengths": """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS text,
  CASE WHEN p_partkey % 3 = 2 THEN 'the /Length 4 0 R is inside an object stream' END AS error FROM part""",
    "truncated_histories": f"""
SELECT s_suppkey, kind AS stop_kind, CASE kind WHEN 'complete' THEN 2 ELSE 1 END::BIGINT AS n_sections, CASE kind WHEN 'complete' THEN 'ok' ELSE 'not-measurable' END AS rewrite,
  kind AS appended_stop, kind = 'complete' AS saved FROM (SELECT s_suppkey, {_cases(f"s_suppkey % {len(fixture.HISTORIES)}", fixture.HISTORIES)} AS kind FROM supplier)""",
    "catalog_versions": """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1.4' WHEN 1 THEN '1.4' WHEN 2 THEN '1.7' WHEN 3 THEN '2.0' END AS version,
  CASE WHEN c_custkey % 5 = 4 THEN 'parse' END AS layer, CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE 1 END::BIGINT AS n_null FROM customer""",
    "created_documents": f"""
SELECT file_id, n AS pages, n AS declared, 3::BIGINT AS lowest, CASE WHEN n = 1 THEN 3 ELSE n + 3 END::BIGINT AS highest, n + 3 AS changed, true AS all_true,
  true AS info, false AS extra, '1.6' AS version FROM {_BUCKETS}""",
    "dangling_references": f"""
SELECT 'dict' AS kind, sum(2 * n + 3)::BIGINT AS n, count(*) AS n_files FROM {_BUCKETS} UNION ALL SELECT 'null', count(*), count(*) FROM {_BUCKETS}""",
    "page_refusals": """
SELECT * FROM (
  SELECT 'R-7.7.3.3-28' AS clause, count(*) AS n FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'R-7.7.3.3-26', count(*) FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT 'R-7.7.3.3-5', count(*) FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0) WHERE n > 0""",
    "edited_page_values": f"""
SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 5 = 0 THEN 90 * (c_custkey % 4) WHEN n_nationkey % 3 = 0 THEN 90 * (n_nationkey % 4)
  WHEN r_regionkey % 2 = 0 THEN 90 * (r_regionkey % 4) END, 0) AS INTEGER) AS rotation FROM {_CUSTOMERS}""",
    "settled_counts": f"""
SELECT nation, sum(n + 1)::BIGINT AS before, sum(n)::BIGINT AS after FROM (
  SELECT n_name AS nation, c_custkey // {corpora.PAGES_PER_FILE} AS bucket, count(*) AS n FROM {_CUSTOMERS} WHERE n_nationkey % 5 = 0 GROUP BY ALL) GROUP BY nation""",
    "duplicate_pages": f"""
WITH k AS (SELECT l_orderkey, CASE WHEN o.l_partkey IS NOT NULL THEN o.l_partkey ELSE l.l_partkey END AS kid
  FROM lineitem l LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) o USING (l_orderkey) WHERE o.l_partkey = l.l_partkey // 2 * 2
  UNION ALL SELECT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (
    SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_partkey = l.l_partkey // 2 * 2)),
d AS (SELECT l_orderkey, count(*) - count(DISTINCT kid) AS n FROM k GROUP BY l_orderkey)
SELECT l_orderkey // {ORDERS_PER_FILE} AS bucket, sum(n)::BIGINT AS n_later, sum(n)::BIGINT AS n_walked FROM d GROUP BY 1 HAVING sum(n) > 0""",
    "composite_fonts": f"""
SELECT p_partkey, CASE WHEN kind < 4 THEN CASE WHEN p_partkey % 2 = 0 THEN tag ELSE '' END || 'Face' END AS base,
  CASE kind WHEN 0 THEN 'CIDFontType2' WHEN 1 THEN 'CIDFontType2' WHEN 2 THEN 'CIDFontType0' WHEN 3 THEN 'CIDFontType0' END AS subtype,
  CASE kind WHEN 0 THEN 'FontFile2' WHEN 1 THEN 'FontFile2' WHEN 2 THEN 'FontFile3' WHEN 3 THEN 'FontFile3' END AS file_key,
  CASE kind WHEN 2 THEN 'OpenType' WHEN 3 THEN 'CIDFontType0C' END AS program,
  CASE kind WHEN 0 THEN {len(fixture.font_program("truetype"))} + strlen(p_name) WHEN 1 THEN {len(fixture.font_program("truetype-cmap"))} + strlen(p_name) END AS length1,
  CASE WHEN kind < 2 THEN 'Identity' END AS map, CASE WHEN kind < 4 THEN 'Identity-H' END AS encoding,
  CASE kind WHEN 4 THEN NULL WHEN 1 THEN 'R-9.9.1-21' ELSE '' END AS notes, CASE WHEN kind = 4 THEN 'the program lacks hhea, hmtx, loca (R-9.9.1-34)' END AS error
FROM (SELECT p_partkey, p_name, p_partkey % 5 AS kind, tag FROM part JOIN {_tag_sql()} USING (p_partkey))""",
    "operand_rules": """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'the stream ends with open brackets q (R-9.4.1-6 / R-14.6.1-12)'
    ELSE 'DP: indirect objects shall not be operands (R-7.8.2-8)' END AS error,
  CASE WHEN c_custkey % 4 = 0 THEN 'text' END AS context, CASE WHEN c_custkey % 4 = 0 THEN 'q text' END AS open FROM customer""",
    "declared_conformance": f"""
WITH f AS (SELECT c_custkey, {_cases("c_custkey % 4", declare.LEVELS)} AS level, CASE WHEN c_custkey % 7 > 0 THEN c_name || ' <"&">' END AS title,
    CASE WHEN c_custkey % 5 > 0 THEN 'en' END AS lang, CASE WHEN c_custkey % 2 = 1 THEN '2020-01-02' END AS made FROM customer),
g AS (SELECT *, CASE WHEN level = 'pdfua-1' THEN concat_ws(',', CASE WHEN title IS NULL THEN 'R-7.1-12' END, CASE WHEN c_custkey % 3 = 0 THEN 'R-7.1-1' END, CASE WHEN lang IS NULL THEN 'R-7.2-5' END)
    ELSE concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'PRE-OUTPUTINTENT' END, CASE WHEN c_custkey % 11 = 0 THEN 'PRE-NOENCRYPT' END,
      CASE WHEN level = 'pdfa-4' AND c_custkey % 13 = 0 THEN 'PRE-NOATTACHMENTS' END) END AS unmet FROM f)
SELECT c_custkey, nullif(unmet, '') AS error, CASE WHEN unmet = '' THEN md5({_packet_sql()}) END AS xmp,
  CASE WHEN unmet = '' THEN CASE level WHEN 'pdfa-3b' THEN 4 ELSE 5 END END::BIGINT AS checked, CASE WHEN unmet = '' THEN true END AS unchecked,
  CASE WHEN unmet = '' THEN level = 'pdfua-1' END AS lang FROM g""",
    "page_artifacts": f"""
WITH p AS (SELECT conv_id, (turn % {corpora.PAGES})::INTEGER AS page, count(*) AS items, count(*) FILTER (turn < {corpora.PAGES}) AS heads,
  count(*) FILTER (turn >= {corpora.PAGES} AND turn < {2 * corpora.PAGES}) AS rules FROM conversations GROUP BY ALL)
SELECT conv_id, page, rules AS bmc, items + heads AS bdc, items + heads + rules AS emc, heads + rules AS artifact, items AS mcid FROM p""",
    "refused_filters": """
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN p_name END AS text, CASE p_partkey % 4 WHEN 1 THEN 'the filter LZWDecode isn''t supported'
  WHEN 2 THEN 'FlateDecode: the data is cut off' END AS error, 'FlateDecode isn''t written; pass no filter' AS encoding FROM part""",
    "inflate_agreement": "SELECT p_partkey, false AS differs, p_partkey % 4 = 0 AS readable FROM part",
    "newest_sections": f"SELECT user_id, count(DISTINCT event_id // {corpora.EVENTS_PER_FILE}) AS n_files FROM events GROUP BY user_id",
    "files_on_disk": """
SELECT suffix, count(*) AS n_files, any_value(total) AS n_written FROM (
  SELECT CASE s_suppkey % 3 WHEN 0 THEN '.txt' ELSE '.pdf' END AS suffix, (SELECT count(*) FROM supplier) AS total FROM supplier) WHERE suffix = '.pdf' GROUP BY suffix""",
    "complaints_of_a_rewrite": """
SELECT * FROM (
  SELECT 'R-7.7.3.3-28' AS clause, count(*) AS n FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'R-7.7.3.3-26', count(*) FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT 'R-7.7.3.3-5', count(*) FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0) WHERE n > 0""",
    "pinned_manifest": """
SELECT status, count(*) AS n_files FROM (
  SELECT CASE WHEN s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 11 > 0 THEN 'extra' END WHEN s_suppkey % 11 = 0 THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE 'ok' END AS status
  FROM supplier) WHERE status IS NOT NULL GROUP BY status""",
    "axis_shapes": f"""
WITH f AS (SELECT r_name, r_regionkey, c_custkey // {corpora.PAGES_PER_FILE} AS bucket, count(DISTINCT n_nationkey) AS n FROM {_CUSTOMERS} GROUP BY ALL),
s AS (SELECT 'region' AS axis, r_name AS shape, count(*) AS n FROM f GROUP BY r_name UNION ALL SELECT 'nations', n::VARCHAR, count(*) FROM f GROUP BY n)
SELECT axis, shape, n, count(*) OVER (PARTITION BY axis) AS shapes FROM s""",
    "role_spans": f"SELECT conv_id, role, count(DISTINCT turn % {corpora.PAGES}) > 1 AS spans FROM conversations GROUP BY conv_id, role",
    "byte_classes": f"""
SELECT doc_id, {_WHITE} AS n_whitespace, {_LINES} AS n_newline, {_MARKS} AS n_delimiter, strlen(t) - {_WHITE} - {_MARKS} AS n_regular,
  {_count("0123456789")} AS n_digit, {_count("01234567")} AS n_octal, {_count("0123456789abcdefABCDEF")} AS n_hex, {_WHITE} + {_MARKS} AS n_boundary,
  {_VALUES} AS n_value FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "lexical_errors": f"""
SELECT s_suppkey, {_cases(f"s_suppkey % {len(FAULTS)}", [f"{m} (at byte {at})" for _, m, at in FAULTS])} AS message,
  CASE s_suppkey % {len(FAULTS)} {" ".join(f"WHEN {k} THEN {at}" for k, (_, _, at) in enumerate(FAULTS))} END::BIGINT AS "offset",
  CASE s_suppkey % {len(FAULTS)} WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE 1 END::BIGINT AS seq FROM supplier""",
}
