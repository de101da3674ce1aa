"""The registered queries over the reference operators, by name, with their SQL.

Every query builds PDF files from tables, reads them back through the scan and
answers with relational operators; the SQL asks the tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import relational as rel
from ..sources import scan, sink
from . import corpora, shapes
from .corpora import table

FLAGSHIP = "page_counts"


def _json(column, path: str):
    """An entry of a dictionary in a cos column; its value as JSON text."""
    return udfs.cos_entry(column, F.lit(path))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every nation's node, and whether /Count agrees."""
    files = corpora.page_files(spark, sf_dir)
    nodes = scan.page_nodes(files).withColumn("label", udfs.cos_text(F.col("dict"), F.lit("Label"))).where("label is not null")
    named = nodes.withColumn("region_key", F.split("file_id", "-")[0].cast("int"))
    counted = named.groupBy("region_key", "label").agg(
        F.sum("count").alias("pages"), F.min(F.col("count").eqNullSafe(F.col("declared"))).alias("agrees")
    )
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("region_key"), F.col("r_name").alias("region"))
    return counted.join(region, "region_key").select("region", F.col("label").alias("nation"), "pages", "agrees")


def descendant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by frontier joins over references instead of the walk in the kernel."""
    files = corpora.page_files(spark, sf_dir)
    nodes = scan.nodes(files, ("Kids", "Label")).select("file_id", "object_number", "path", "kind", "key", "ref_num", "bytes_v")
    kids = nodes.where("path like '/Kids[%' and kind = 'ref'").select("file_id", F.col("object_number").alias("parent"), F.col("ref_num").alias("child"))
    inner = kids.select("file_id", F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
    edges = kids.join(inner, ["file_id", "child"], "left").withColumn("is_page", F.col("inner").isNull()).drop("inner")
    roots = kids.select("file_id", F.col("parent").alias("node")).distinct()
    counts = rel.descendant_counts(edges, roots)
    labels = nodes.where("path = '/Label'").select("file_id", F.col("object_number").alias("ancestor"), F.decode("bytes_v", "UTF-8").alias("nation"))
    return counts.join(labels, ["file_id", "ancestor"]).groupBy("nation").agg(F.sum("pages").alias("pages"))


def inherited_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rotation: its own, else the nearest ancestor's, else the default 0."""
    pages = scan.pages(corpora.page_files(spark, sf_dir))
    return pages.select(
        udfs.cos_entry(F.col("dict"), F.lit("Key")).cast("long").alias("c_custkey"), F.coalesce(F.col("inherited")["Rotate"].cast("int"), F.lit(0)).alias("rotation")
    )


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inheritance as a minimum over ancestor rows."""
    files = corpora.page_files(spark, sf_dir)
    steps = scan.page_ancestors(files).select(
        "file_id", "page_index", "distance", udfs.cos_entry(F.col("dict"), F.lit("Rotate")).cast("int").alias("rotation"),
        F.when(F.col("distance") == 0, udfs.cos_entry(F.col("dict"), F.lit("Key")).cast("long")).alias("key"),
    )
    keys = steps.where("key is not null").select("file_id", "page_index", F.col("key").alias("c_custkey"))
    found = rel.nearest(steps, ["file_id", "page_index"], "distance", "rotation")
    return keys.join(found, ["file_id", "page_index"], "left").select("c_custkey", F.coalesce("rotation", F.lit(0)).alias("rotation"))


def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken page rules by clause."""
    found = scan.violations(corpora.page_files(spark, sf_dir, defects=True))
    return found.groupBy("clause").agg(F.count(F.lit(1)).alias("n"))


def count_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose node declares another count than its pages."""
    nodes = scan.page_nodes(corpora.page_files(spark, sf_dir, defects=True))
    wrong = nodes.where(~F.col("count").eqNullSafe(F.col("declared"))).withColumn("nation", udfs.cos_text(F.col("dict"), F.lit("Label")))
    return wrong.groupBy("nation").agg(F.sum("count").alias("pages"), F.sum("declared").alias("declared"))


def declared_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose /Parent isn't the node that lists them, by joins."""
    files = corpora.page_files(spark, sf_dir, defects=True)
    nodes = scan.nodes(files, ("Kids", "Key", "Parent")).select("file_id", "object_number", "path", "kind", "ref_num", "int_v")
    edges = nodes.where("path like '/Kids[%' and kind = 'ref'").select("file_id", F.col("object_number").alias("parent"), F.col("ref_num").alias("child"))
    keys = nodes.where("path = '/Key'").select("file_id", F.col("object_number").alias("child"), F.col("int_v").cast("long").alias("c_custkey"))
    own = nodes.where("path = '/Parent' and kind = 'ref'").select("file_id", F.col("object_number").alias("child"), F.col("ref_num").alias("declared"))
    declared = keys.join(own, ["file_id", "child"], "left")
    wrong = rel.wrong_parents(edges, declared)
    return wrong.join(keys, ["file_id", "child"]).select("c_custkey")


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through literal and hexadecimal strings, Flate, PNG rows of one tag and of all, and TIFF rows."""
    decoded = scan.payloads(corpora.text_files(spark, sf_dir))
    names = ((2, "literal"), (3, "flate"), (4, "png"), (5, "hex"), (6, "tags"), (7, "tiff"))
    hashed = decoded.select("file_id", "object_number", F.octet_length("data").cast("long").alias("n"), F.md5("data").alias("digest"))
    found = hashed.groupBy("file_id").agg(
        F.max("n").alias("n_bytes"), *[F.max(F.when(F.col("object_number") == k, F.col("digest"))).alias(f"md5_{name}") for k, name in names]
    )
    return found.withColumn("doc_id", F.col("file_id").cast("long")).drop("file_id")


def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user: newest cross-reference entry of a file, then newest file."""
    files = corpora.event_files(spark, sf_dir)
    found = scan.objects(files).where("object_number = 2").select("file_id", udfs.cos_entries("cos").alias("c"))
    entry = lambda k, kind: F.col("c")[k].cast(kind)
    last = found.groupBy(F.split("file_id", "-")[0].cast("long").alias("user_id")).agg(
        F.max(F.struct(entry("Ts", "long").alias("ts"), entry("Id", "long").alias("id"), entry("Value", "double").alias("value"))).alias("last")
    )
    return last.select("user_id", F.col("last.id").alias("event_id"), F.col("last.value").alias("value"))


def revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every user's files, and distinct objects after the merge by windows."""
    files = corpora.event_files(spark, sf_dir)
    entries = scan.entries(files)
    merged = rel.merged_entries(entries, scan.headers(files))
    user = F.split("file_id", "-")[0].cast("long").alias("user_id")
    own = merged.where("object_number = 2").select("file_id", "section_ord")
    newest = own.groupBy(user).agg(F.max("section_ord").alias("oldest_win"))
    sections = scan.sections(files).groupBy(user).agg(F.count(F.lit(1)).alias("revisions"))
    return sections.join(newest, "user_id")


def compressed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read back from object streams."""
    objects = scan.objects(corpora.order_files(spark, sf_dir)).where("kind = 'dict' and object_number > 1").select(udfs.cos_entries("cos").alias("c"))
    return objects.select(
        F.col("c")["Key"].cast("long").alias("o_orderkey"), F.col("c")["Price"].cast("double").alias("o_totalprice"), F.col("c")["Status"].alias("o_orderstatus")
    )


def compressed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed entries joined with their slots, by file."""
    files = corpora.order_files(spark, sf_dir)
    found = rel.compressed_lookup(scan.entries(files), scan.slots(files))
    return found.groupBy(F.col("file_id").cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("right").alias("all_right"), F.max("object_number").alias("highest")
    )


def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive part keys for each supplier."""
    return rel.runs(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


def free_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest unused line number of every order, and of every supplier's parts."""
    return rel.lowest_free(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def body_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents begin if a hundred of them stand behind a 15-byte header."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 100).alias("file"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")
    )
    return rel.offsets(docs, "file", "doc_id", "n", 15).select("doc_id", F.col("offset").cast("long").alias("offset"))


def marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every page of every conversation's file, from its parent tree."""
    nodes = scan.nodes(corpora.conversation_files(spark, sf_dir)).select("file_id", "object_number", "path", "kind", "key", "int_v", "name_v", "ref_num")
    pages = nodes.where("path = '/StructParents'").select("file_id", F.col("object_number").alias("page"), F.col("int_v").cast("long").alias("tree_key"))
    nums = nodes.where("path like '/Nums[%'").withColumn("i", F.regexp_extract("path", r"\[(\d+)\]", 1).cast("int"))
    keys = nums.where("kind = 'integer'").select("file_id", F.col("int_v").cast("long").alias("tree_key"), (F.col("i") + 1).alias("i"))
    lists = nums.where("kind = 'ref'").select("file_id", "i", F.col("ref_num").alias("object_number"))
    items = nodes.where(r"path rlike '^\\[[0-9]+\\]$'").select("file_id", "object_number")
    counted = items.groupBy("file_id", "object_number").agg(F.count(F.lit(1)).alias("items"))
    found = pages.join(keys, ["file_id", "tree_key"]).join(lists, ["file_id", "i"]).join(counted, ["file_id", "object_number"])
    conv = F.split("file_id", "-")[0].cast("long").alias("conv_id")
    return found.select(conv, (F.col("page") - 3).cast("int").alias("page"), F.col("items").alias("n_items"))


def marked_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that every turn gets in its page's stream."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("turn") % corpora.PAGES).alias("page"))
    found = rel.marked_content_ids(turns, ["conv_id", "page"], ["turn", "role", "text"])
    return found.select("conv_id", "turn", F.col("mcid").cast("int").alias("mcid"))


def spans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a role's items lie on several pages, by the form of its element's kids."""
    nodes = scan.nodes(corpora.conversation_files(spark, sf_dir)).select("file_id", "object_number", "path", "kind", "name_v", "bytes_v")
    titles = nodes.where("path = '/T'").select("file_id", "object_number", F.decode("bytes_v", "UTF-8").alias("role"))
    kinds = nodes.where("path = '/S' and name_v = 'P'").select("file_id", "object_number")
    forms = nodes.where("path like '/K%' and name_v = 'MCR'").select("file_id", "object_number").distinct().withColumn("mcr", F.lit(True))
    found = titles.join(kinds, ["file_id", "object_number"]).join(forms, ["file_id", "object_number"], "left")
    conv = F.split("file_id", "-")[0].cast("long")
    return found.groupBy(conv.alias("conv_id"), "role").agg(F.max(F.coalesce("mcr", F.lit(False))).alias("spans"))


def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects referred to, and the highest, in the page files of every region."""
    found = rel.reference_summary(scan.reference_rows(corpora.page_files(spark, sf_dir)))
    return found.select("file_id", "n_targets", "highest")


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of writing the page files anew in each form."""
    return rel.outcome_counts(scan.round_trips(corpora.page_files(spark, sf_dir)))


def rewrite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a rewrite changes, by a full outer join of the node tables."""
    files = corpora.page_files(spark, sf_dir)
    before = scan.nodes(files)
    after = scan.nodes(scan.rewritten(files, "objstm"))
    kept = after.join(before.select("file_id", "object_number").distinct(), ["file_id", "object_number"], "left_semi")
    return rel.differences(before, kept).agg(F.count(F.lit(1)).alias("n_differences"))


def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of damaged files by kind."""
    found = rel.failure_groups(scan.errors(corpora.damaged_files(spark, sf_dir)))
    return found.select("n_files", F.element_at("files", 1).alias("first_file"), F.size("files").alias("n_samples"))


def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = scan.round_trips(corpora.damaged_files(spark, sf_dir)).where("mode = 'table'")
    expected = table(spark, sf_dir, "supplier").where("s_suppkey % 6 = 0").count()
    return rel.gate(outcomes, expected)


def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the conversations' files by kind."""
    found = rel.kind_histogram(scan.objects(corpora.conversation_files(spark, sf_dir)))
    return found.groupBy("kind").agg(F.sum("n").alias("n"))


def cross_reference_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field widths and dense entries of the files of orders."""
    entries = scan.entries(corpora.order_files(spark, sf_dir)).where("kind = 'compressed'").select("file_id", "object_number", "kind", "a", "b")
    dense = rel.fill_gaps(entries).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "free", 1).otherwise(0)).alias("n_free"))
    widths = rel.field_widths(entries)
    return dense.join(widths, "file_id").select(F.col("file_id").cast("long").alias("bucket"), "n", "n_free", "w2", "w3")


def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an operator sequence that an order's status and priority choose."""
    sequences = {"F": "q cm BT Tf Td Tj ET Q", "O": "BT BT ET ET", "P": "re W n BMC Do"}
    chosen = F.create_map(*[x for k, v in sequences.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v.split()]))])
    orders = table(spark, sf_dir, "orders").withColumn("ops", F.coalesce(chosen[F.col("o_orderstatus")], F.array(F.lit("l"))))
    ops = F.when(F.col("o_orderkey") % 10 == 0, F.concat("ops", F.array(F.lit("BI")))).otherwise(F.col("ops"))
    return orders.select("o_orderkey", F.coalesce(rel.operator_problem(ops), F.lit("ok")).alias("verdict"))


def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmet rules of two levels for facts that a customer's columns give."""
    c = F.col
    facts = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(c("c_custkey") % 3 > 0, c("c_name")).alias("title"), F.when(c("c_custkey") % 2 > 0, F.lit("en")).alias("lang"),
        (c("c_custkey") % 5 > 0).alias("display_title"), (c("c_custkey") % 7 == 0).alias("suspects"), (c("c_acctbal") > 0).alias("marked"),
        (c("c_custkey") % 4 > 0).alias("has_tree"), (c("c_nationkey") % 2 == 0).alias("output_intent"), (c("c_custkey") % 11 == 0).alias("encrypted"),
        (c("c_custkey") % 13 > 0).alias("file_id_entry"), (c("c_custkey") % 6 == 0).alias("has_info"), (c("c_custkey") % 3).alias("n_attached"),
        (c("c_custkey") % 2).alias("n_related"),
    )
    return facts.select("c_custkey", *[F.array_join(rel.unmet_rules(level), ",").alias(level.replace("-", "_")) for level in ("pdfua-1", "pdfa-4", "pdfa-4f")])


def edited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after appended updates: every seventh repriced, every eleventh deleted, through the editor."""
    files = corpora.order_files(spark, sf_dir)
    base = scan.objects(files).where("kind = 'dict' and object_number > 1").withColumn("o_orderkey", udfs.cos_entry(F.col("cos"), F.lit("Key")).cast("long"))
    changed = base.where("o_orderkey % 7 = 0 or o_orderkey % 11 = 0").select(
        "file_id", F.struct(
            F.when(F.col("o_orderkey") % 11 == 0, "delete").otherwise("set").alias("action"), "object_number", "generation",
            F.concat(F.lit('{"d":[["Key",'), F.col("o_orderkey").cast("string"), F.lit('],["Price",{"r":"1.5"}]]}')).alias("cos"),
        ).alias("edit"),
    )
    edits = changed.groupBy("file_id").agg(F.array_sort(F.collect_list("edit")).alias("edits"))  # at most a file's objects
    updated = sink.apply_edits(files, edits)
    after = scan.objects(updated).where("kind = 'dict' and object_number > 1").select(udfs.cos_entries("cos").alias("c"))
    return after.where(F.col("c")["Key"].isNotNull()).select(F.col("c")["Key"].cast("long").alias("o_orderkey"), F.col("c")["Price"].cast("double").alias("o_totalprice"))


def overlay_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of merge as a plan: lines overlay orders, the last line of a number wins, some orders go."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    changes = lines.select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("price"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return rel.overlay(orders, changes, orders.where("key % 11 = 0"), ["key"], "seq")


def assembled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as object rows, assembled to files by the sink and read again."""
    part = table(spark, sf_dir, "part")
    bucket = F.floor(F.col("p_partkey") / 400).cast("string")
    rows = part.select(
        bucket.alias("file_id"), (F.col("p_partkey") % 400 + 2).alias("object_number"), F.lit(0).alias("generation"),
        F.concat(F.lit('{"d":[["Key",'), F.col("p_partkey").cast("string"), F.lit('],["Size",'), F.col("p_size").cast("string"), F.lit("]]}")).alias("cos"),
    )
    files = rows.select("file_id").distinct()
    catalog = files.select("file_id", F.lit(1).cast("long").alias("object_number"), F.lit(0).alias("generation"), F.lit('{"d":[["Type",{"n":"Catalog"}]]}').alias("cos"))
    written = sink.assemble(rows.unionByName(catalog), files.withColumn("trailer", F.lit('{"d":[["Root",{"R":[1,0]}]]}')), xref="stream", object_streams=True)
    back = scan.objects(written).where("object_number > 1 and kind = 'dict'").select(udfs.cos_entries("cos").alias("c"))
    return back.select(F.col("c")["Key"].cast("long").alias("p_partkey"), F.col("c")["Size"].cast("long").alias("p_size"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of supplier rows written as syntax, by kind."""
    supplier = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("<< /Key "), F.col("s_suppkey").cast("string"), F.lit(" /Name ("), F.col("s_name"), F.lit(") /Hex <41> >> [ 1.5 2 true ] % end\n"))
    found = scan.tokens(supplier.select(F.col("s_suppkey").cast("string").alias("file_id"), F.encode(text, "UTF-8").alias("content")))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of synthetic font programs that a part's size chooses."""
    marks = {0: b"\1\0\4\2", 1: b"ttcf", 2: b"abcd"}
    chosen = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), F.lit(v))])
    fonts = table(spark, sf_dir, "part").select("p_partkey", udfs.font_format(F.concat(chosen[(F.col("p_size") % 3).cast("int")], F.encode("p_name", "UTF-8"))).alias("format"))
    return fonts


QUERIES = {
    f.__name__: f
    for f in (
        page_counts, descendant_pages, inherited_rotation, nearest_ancestor, page_violations, count_corrections, declared_parents, text_round_trip,
        newest_revision, revision_counts, compressed_orders, compressed_slots, subsections, free_numbers, body_offsets, marked_content, marked_content_ids,
        spans_pages, reference_graph, round_trips, rewrite_differences, failure_groups, baseline_gate, kind_histogram, cross_reference_widths,
        content_operators, conformance, edited_orders, overlay_orders, assembled_files, token_kinds, font_programs,
    )
} | shapes.QUERIES

_PAGES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_ROTATION = (
    "CASE WHEN c_custkey % 5 = 0 THEN 90 * (c_custkey % 4) WHEN n_nationkey % 3 = 0 THEN 90 * (n_nationkey % 4) "
    "WHEN r_regionkey % 2 = 0 THEN 90 * (r_regionkey % 4) END"
)
_ROTATED = f"SELECT c_custkey, CAST(coalesce({_ROTATION}, 0) AS INTEGER) AS rotation FROM {_PAGES}"
_FILES = f"(SELECT r_regionkey, c_custkey // {corpora.PAGES_PER_FILE} AS bucket, n_nationkey, c_custkey FROM {_PAGES})"

ORACLES: dict[str, str] = {
    "page_counts": f"SELECT r_name AS region, n_name AS nation, count(*) AS pages, true AS agrees FROM {_PAGES} GROUP BY ALL",
    "descendant_pages": f"SELECT n_name AS nation, count(*) AS pages FROM {_PAGES} GROUP BY ALL",
    "inherited_rotation": _ROTATED,
    "nearest_ancestor": _ROTATED,
    "page_violations": """
SELECT * FROM (
  SELECT 'R-7.7.3.3-28' AS clause, count(*) AS n FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'R-7.7.3.3-26', count(*) FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT 'R-7.7.3.3-5', count(*) FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0) WHERE n > 0""",
    "count_corrections": f"""
SELECT nation, sum(pages)::BIGINT AS pages, sum(pages + 1)::BIGINT AS declared FROM (
  SELECT n_name AS nation, c_custkey // {corpora.PAGES_PER_FILE} AS bucket, count(*) AS pages FROM {_PAGES} WHERE n_nationkey % 5 = 0 GROUP BY ALL)
GROUP BY nation""",
    "declared_parents": "SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0",
    "text_round_trip": """
SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS md5_literal, md5(text) AS md5_flate, md5(text) AS md5_png, md5(text) AS md5_hex,
  md5(text) AS md5_tags, md5(text) AS md5_tiff FROM documents""",
    "newest_revision": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "revision_counts": "SELECT user_id, count(*) AS revisions, 0 AS oldest_win FROM events GROUP BY user_id",
    "compressed_orders": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "compressed_slots": """
SELECT o_orderkey // 500 AS bucket, count(*) + 1 AS n, true AS all_right, count(*) + 1 AS highest FROM orders GROUP BY ALL""",
    "subsections": """
SELECT l_suppkey, min(l_partkey) AS first, count(*) AS count FROM (
  SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS island
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, island""",
    "free_numbers": """
SELECT l_orderkey, min(n)::BIGINT AS free_number FROM (
  SELECT DISTINCT l_orderkey, l_linenumber + 1 AS n FROM lineitem UNION SELECT DISTINCT l_orderkey, 1 FROM lineitem) f
WHERE NOT EXISTS (SELECT 1 FROM lineitem u WHERE u.l_orderkey = f.l_orderkey AND u.l_linenumber = f.n) GROUP BY l_orderkey""",
    "body_offsets": """
SELECT doc_id, (15 + coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM documents""",
    "marked_content": f"SELECT conv_id, (turn % {corpora.PAGES})::INTEGER AS page, count(*) AS n_items FROM conversations GROUP BY ALL",
    "marked_content_ids": f"""
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn % {corpora.PAGES} ORDER BY turn, role, text) - 1)::INTEGER AS mcid FROM conversations""",
    "spans_pages": f"SELECT conv_id, role, count(DISTINCT turn % {corpora.PAGES}) > 1 AS spans FROM conversations GROUP BY conv_id, role",
    "reference_graph": f"""
SELECT r_regionkey || '-' || bucket AS file_id, 2 + count(DISTINCT n_nationkey) + count(*) AS n_targets, 2 + count(DISTINCT n_nationkey) + count(*) AS highest
FROM {_FILES} GROUP BY r_regionkey, bucket""",
    "round_trips": f"""
SELECT mode, 'ok' AS outcome, count(*) AS n_files FROM (SELECT DISTINCT r_regionkey, bucket FROM {_FILES}), (VALUES ('table'), ('stream'), ('objstm')) m(mode)
GROUP BY mode""",
    "rewrite_differences": "SELECT 0::BIGINT AS n_differences",
    "failure_groups": """
SELECT count(*) AS n_files, lpad(CAST(min(s_suppkey) AS VARCHAR), 9, '0') AS first_file, least(count(*), 5)::INTEGER AS n_samples
FROM supplier WHERE s_suppkey % 6 > 0 GROUP BY s_suppkey % 6""",
    "baseline_gate": "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 6 = 0) AS ok, true AS passed FROM supplier",
    "kind_histogram": f"""
WITH f AS (SELECT conv_id, count(DISTINCT role) AS roles, count(DISTINCT turn % {corpora.PAGES}) AS pages FROM conversations GROUP BY conv_id)
SELECT 'dict' AS kind, sum(2 + {corpora.PAGES} + 1 + 1 + roles + 1)::BIGINT AS n FROM f
UNION ALL SELECT 'stream', sum({corpora.PAGES})::BIGINT FROM f UNION ALL SELECT 'array', sum(pages)::BIGINT FROM f""",
    "cross_reference_widths": """
SELECT o_orderkey // 500 AS bucket, count(*) + 2 AS n, 1::BIGINT AS n_free, CASE WHEN count(*) + 2 > 255 THEN 2 ELSE 1 END AS w2,
  CASE WHEN count(*) > 255 THEN 2 ELSE 1 END AS w3 FROM orders GROUP BY ALL""",
    "content_operators": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'refused BI' ELSE 'ok' END WHEN 'O' THEN 'context BT'
  WHEN 'P' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'refused BI' ELSE 'unclosed' END ELSE 'context l' END AS verdict FROM orders""",
    "conformance": """
WITH f AS (SELECT *, c_custkey % 3 AS att, c_custkey % 2 AS rel FROM customer)
SELECT c_custkey,
  concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'R-7.1-12' END, CASE WHEN c_custkey % 5 = 0 THEN 'R-7.1-15' END, CASE WHEN c_custkey % 7 = 0 THEN 'R-7.1-18' END,
    CASE WHEN NOT (c_acctbal > 0 AND c_custkey % 4 > 0) THEN 'R-7.1-1' END, CASE WHEN c_custkey % 2 = 0 THEN 'R-7.2-5' END) AS pdfua_1,
  concat_ws(',', CASE WHEN c_nationkey % 2 > 0 THEN 'PRE-OUTPUTINTENT' END, CASE WHEN c_custkey % 11 = 0 THEN 'PRE-NOENCRYPT' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'PRE-FILEID' END, CASE WHEN c_custkey % 6 = 0 THEN 'PRE-NOINFO' END, CASE WHEN att > 0 THEN 'PRE-NOATTACHMENTS' END) AS pdfa_4,
  concat_ws(',', CASE WHEN c_nationkey % 2 > 0 THEN 'PRE-OUTPUTINTENT' END, CASE WHEN c_custkey % 11 = 0 THEN 'PRE-NOENCRYPT' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'PRE-FILEID' END, CASE WHEN c_custkey % 6 = 0 THEN 'PRE-NOINFO' END, CASE WHEN rel < att THEN 'PRE-AFRELATIONSHIP' END) AS pdfa_4f
FROM f""",
    "edited_orders": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 > 0""",
    "overlay_orders": """
WITH last AS (SELECT l_orderkey AS key, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS price
  FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey)
SELECT key, price FROM last WHERE key % 11 > 0 UNION ALL
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey NOT IN (SELECT key FROM last)""",
    "assembled_files": "SELECT p_partkey, p_size::BIGINT AS p_size FROM part",
    "token_kinds": """
SELECT kind, count(*) * any_value(each) AS n FROM supplier, (VALUES ('dict-open', 1), ('dict-close', 1), ('name', 3), ('integer', 2), ('string', 2),
  ('array-open', 1), ('array-close', 1), ('real', 1), ('keyword', 1)) k(kind, each) GROUP BY kind""",
    "font_programs": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'bare-cff' END AS format FROM part",
} | shapes.ORACLES
