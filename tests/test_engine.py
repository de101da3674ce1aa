"""Scans, sinks, relational operators and functions beyond the registered queries."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import udfs
from quire.kernel import cosjson, files, pagetree, survey
from quire.kernel.lexer import Cursor, TokenReader
from quire.kernel.values import Name, PdfString, Ref, Stream
from quire.operators import relational as rel
from quire.plans import corpora, shapes
from quire.runtime import Scratch
from quire.sources import scan, sink
from quire.streaming import watch
from tests.kernel.build import PAGE, build_pdf, tree

NODE = "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 5 /Rotate 90 >>"
GOOD = tree(NODE, PAGE.format(parent=2, more=""), PAGE.format(parent=2, more="/Rotate 45"))
BAD = build_pdf(["<< >>"], startxref=3)


@pytest.fixture(scope="module")
def found(spark):
    rows = [("good", GOOD), ("bad", BAD), ("none", None), ("empty", b"")]
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "file_id string, content binary, kind string")


def test_tables(found):
    assert [r.file_id for r in scan.headers(found).collect()] == ["good"]
    assert {r.file_id: r.layer for r in scan.errors(found).collect()} == {"bad": "parse", "none": "parse", "empty": "parse"}
    assert scan.objects(found).count() == 4
    nodes = {(r.object_number, r.path): r for r in scan.nodes(found).collect()}
    some = {(r.object_number, r.path) for r in scan.nodes(found, ("Kids", "Count")).collect()}
    assert some == {k for k in nodes if k[1].startswith(("/Kids", "/Count"))} and len(some) == 4
    assert nodes[2, "/Kids[1]"].ref_num == 4 and nodes[2, "/Count"].int_v == 5 and nodes[2, ""].kind == "dict"
    assert [(r.page_index, r.inherited["Rotate"]) for r in scan.pages(found).collect()] == [(0, "90"), (1, "45")]
    assert [(r["count"], r.declared) for r in scan.page_nodes(found).collect()] == [(2, 5)]
    assert [r.clause for r in scan.violations(found).collect()] == ["R-7.7.3.3-28"]
    merged = rel.merged_entries(scan.entries(found), scan.headers(found))
    assert {r.object_number: r.kind for r in merged.collect()} == {0: "free", 1: "in-use", 2: "in-use", 3: "in-use", 4: "in-use"}
    assert {r["mode"]: r.outcome for r in scan.round_trips(found).where("file_id = 'good'").collect()} == dict.fromkeys(("table", "stream", "objstm"), "ok")
    assert rel.differences(scan.nodes(found), scan.nodes(scan.rewritten(found, "table"))).count() == 0
    looked = rel.lookup(scan.reference_rows(found), scan.objects(found)).select("ref_num", "kind").distinct().collect()
    assert {tuple(r) for r in looked} == {(1, "dict"), (2, "dict"), (3, "dict"), (4, "dict")}


def test_page_lists(spark):
    """Lists and violations from one reading are those of the node table and of the violations."""
    page = PAGE.format(parent=2, more="")
    more = {
        "again": tree("<< /Type /Pages /Kids [3 0 R 4 0 R 3 0 R (x) [4 0 R]] /Count 2 >>", page, page),
        "own": build_pdf(["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [] /Count 0 >>", "<< /Kids 2 0 R >>", "7"]),
        "broken": build_pdf(["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 3 0 R] /Count 2 >>", "<< )"]),
    }
    files = spark.createDataFrame([("good", GOOD), ("bad", BAD), ("none", None), *more.items()], "file_id string, content binary")
    got = scan.page_lists(files).collect()
    assert sorted((r.file_id, r.object_number, r.kids) for r in got if r.clause is None) == [
        ("again", 2, [3, 4, 3, None, None]), ("broken", 2, [3, 3]), ("good", 2, [3, 4]), ("own", 2, []),
    ]
    told = [(r.file_id, r.clause, r.object_number) for r in scan.violations(files).collect()]
    assert [(r.file_id, r.clause, r.object_number) for r in got if r.clause] == told and ("again", pagetree.DUPLICATE, 3) in told


def test_parts_of_large_files_have_few_rows(spark, sf):
    """A reader's batch is up to 4096 rows of a part, which of large files would not fit."""
    path = Scratch(spark, "few").keep(spark.range(1000, numPartitions=1), "few", file_rows=128).quire_path
    rows = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == 1000 and max(rows) == 128
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_partkey", (F.col("l_orderkey") * 256).alias("l_orderkey"))
    few = Scratch(spark, "lines")
    lines.write.parquet(f"{few.root}/lineitem.parquet")
    files = shapes.shared_page_files(spark, few.root)
    rows = [r["count"] for r in files.groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == lines.select("l_orderkey").distinct().count() > 4 * 128 and max(rows) <= 128


DEEP = 20_000
ODD = {
    "digits": build_pdf(["<< /Type /Catalog >>", "9" * 5000]),
    "nested": build_pdf(["<< /Type /Catalog >>", "[" * DEEP + "]" * DEEP]),
    "long": build_pdf(["<< /Type /Catalog >>", "[%d -%d]" % (10**38, 10**39)]),
    "number": build_pdf(["<< /Type /Catalog >>", "%d 0 R" % 10**20]),
    "size": build_pdf(["<< /Type /Catalog >>"], trailer=lambda n: f"trailer\n<< /Size {10**20} /Root 1 0 R >>\n"),
    "prev": build_pdf(["<< /Type /Catalog >>"], trailer=lambda n: f"trailer\n<< /Size {n} /Root 1 0 R /Prev {10**20} >>\n"),
    "count": build_pdf(["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [] /Count {10**20} >>"]),
}


def test_malformed_files_are_error_rows(spark, found):
    files_of = spark.createDataFrame([(k, bytearray(v)) for k, v in ODD.items()], "file_id string, content binary").union(found.select("file_id", "content"))
    layers = {r.file_id: r.layer for r in scan.errors(files_of).collect()}
    assert layers == {"digits": "lex", "number": "parse", "size": "parse", "bad": "parse", "none": "parse", "empty": "parse"}
    objects = {(r.file_id, r.object_number): r for r in scan.objects(files_of).collect()}
    assert "4000 digits" in objects["digits", 2].error and "no reference" in objects["number", 2].error
    assert objects["nested", 2].cos == "[" * DEEP + "]" * DEEP and objects["long", 2].cos == f"[{10**38},-{10**39}]"
    nodes = scan.nodes(files_of).where("object_number = 2")
    deep = nodes.where("file_id = 'nested'").agg(F.count(F.lit(1)), F.max("depth"), F.max(F.length("path")), F.count_distinct("path")).first()
    assert (deep[0], deep[1]) == (DEEP, DEEP - 1) and deep[2] < 1000 and deep[3] == DEEP
    assert [(r.int_v, r.int_text) for r in nodes.where("file_id = 'long' and kind = 'integer'").orderBy("ordinal").collect()] == [(None, str(10**38)), (None, str(-(10**39)))]
    assert {r.file_id: r.stop_kind for r in scan.headers(files_of).collect()}["prev"] == "malformed"
    assert [r.declared for r in scan.page_nodes(files_of).where("file_id = 'count'").collect()] == [None]
    for table in (scan.reference_rows, scan.round_trips, scan.sections, scan.entries, scan.pages, scan.violations, scan.payloads, lambda f: scan.rewritten(f, "objstm")):
        assert table(files_of).count() > 0
    outcomes = {(r.file_id, r["mode"]): r.outcome for r in scan.round_trips(files_of).collect()}
    assert outcomes["nested", "table"] == "ok" and outcomes["digits", "table"] == "unreadable" and outcomes["prev", "table"] == "not-measurable"


def test_unedited_files_stay(spark, found):
    schema = "file_id string, edits array<struct<action:string,object_number:long,generation:int,cos:string>>"
    edits = spark.createDataFrame([("good", []), ("bad", [("set", 1, 0, "1")])], schema)
    got = {r.file_id: r for r in sink.apply_edits(found, edits).collect()}
    assert set(got) == {"good", "bad", "none", "empty"}
    assert bytes(got["empty"].content) == b"" and got["none"].content is None and got["none"].error is None
    assert got["bad"].content is None and got["bad"].error and bytes(got["good"].content) == GOOD


def test_stored_files_and_manifest(spark, found, tmp_path):
    named = found.withColumn("name", F.concat(F.lit("a/b/"), "file_id", F.lit(".Pdf")))
    for _ in range(2):  # a task that runs again leaves the same files
        assert sink.write_files(named, str(tmp_path)).agg(F.sum("n_bytes")).first()[0] == len(GOOD) + len(BAD)
    back = {r.file_id.rsplit("/", 1)[1]: bytes(r.content) for r in scan.read_files(spark, f"file://{tmp_path}").collect()}
    assert back == {"good.Pdf": GOOD, "bad.Pdf": BAD}
    pinned = [("good", len(GOOD), hashlib.sha256(GOOD).hexdigest()), ("bad", len(BAD), "0"), ("gone", 1, "0")]
    checked = rel.manifest_check(found.where("file_id <> 'none'"), spark.createDataFrame(pinned, "file_id string, length long, sha256 string"))
    assert {r.file_id: r.status for r in checked.collect()} == {"good": "ok", "bad": "changed", "gone": "missing", "empty": "extra"}


def test_empty_tables(found):
    none = found.limit(0)
    for table in (scan.headers, scan.objects, scan.nodes, scan.pages, scan.errors, scan.tokens, scan.round_trips):
        assert table(none).count() == 0


def test_files_on_disk_and_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(GOOD)
    (tmp_path / "in" / "deep" / "b.PDF").write_bytes(BAD)
    (tmp_path / "in" / "c.txt").write_bytes(GOOD)
    path = f"file://{tmp_path}/in"
    assert sorted(r.file_id.rsplit("/", 1)[1] for r in scan.read_files(spark, path).collect()) == ["a.pdf", "b.PDF"]
    query = watch.headers(watch.arriving(spark, path)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("arrived").count() == 1
    query = watch.outcomes(watch.arriving(spark, path)).writeStream.outputMode("complete").format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("outcomes").agg(F.sum("n_files"), F.sum("n_failed")).collect()[0][:] == (2, 1)


def test_edits(spark, found):
    value = cosjson.dumps({"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 1, 1], "Resources": {}})
    edits = [("good", [("set", 4, 0, value), ("allocate", None, None, cosjson.dumps(PdfString(b"new")))])]
    schema = "file_id string, edits array<struct<action:string,object_number:long,generation:int,cos:string>>"
    for mode in ("append", "save"):
        updated = sink.apply_edits(found, spark.createDataFrame(edits, schema), mode=mode).collect()
        document = files.parse(bytes(updated[0].content))
        assert document.get(5) == PdfString(b"new") and document.get(2)["Count"] == 2 and document.get(4)["MediaBox"] == [0, 0, 1, 1]
    refused = sink.apply_edits(found, spark.createDataFrame([("good", [("set", 9, 0, "1")])], schema)).collect()
    assert refused[0].content is None and "R-7.7.3.3-28" in refused[0].error


def test_sink_reports_what_it_cannot_write(spark):
    rows = spark.createDataFrame([("a", 1, 0, "1"), ("a", 1, 0, "2"), ("b", 1, 0, '{"d":[]}')], "file_id string, object_number long, generation int, cos string")
    trailers = spark.createDataFrame([("a", '{"d":[]}'), ("b", '{"d":[["Root",{"R":[1,0]}]]}')], "file_id string, trailer string")
    got = {r.file_id: r for r in sink.assemble(rows, trailers).collect()}
    assert got["a"].content is None and "twice" in got["a"].error
    assert files.parse(bytes(got["b"].content)).catalog() == {}


def test_cos_json_round_trip():
    value = {"A": [1, 1.0, True, None, Name("x\xff", b"x\xff"), PdfString(b"\xff"), PdfString(b"a", "hex"), Ref(1, 2)], "S": Stream({"d": 1}, b"\0")}
    assert survey.flatten(cosjson.loads(cosjson.dumps(value))) == survey.flatten(value)


def test_sql_functions(spark, found):
    udfs.register(spark)
    found.createOrReplaceTempView("pdfs")
    assert spark.sql("SELECT o.object_number FROM pdfs, LATERAL pdf_objects(content) o").count() == 4
    assert [r.kind for r in spark.sql("SELECT * FROM pdf_tokens(CAST('[1 /A' AS BINARY))").collect()] == ["array-open", "integer", "name"]
    at = scan.headers(found).collect()[0].startxref
    assert spark.sql(f"SELECT x.* FROM pdfs, LATERAL pdf_xref_section(content, {at}L, 0L) x WHERE file_id = 'good'").count() == 5
    assert spark.sql("SELECT pdf_real(1e-7D), pdf_subset_tag(X''), pdf_inflate(X'00')").collect()[0][0] == "0.0000001"


def test_relational_edges(spark):
    numbers = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 3), ("c", None)], "k string, n long")
    assert sorted(map(tuple, rel.lowest_free(numbers, "k", "n").collect())) == [("a", 3), ("b", 1), ("c", 1)]
    assert sorted(map(tuple, rel.runs(numbers.where("n is not null"), "k", "n").collect())) == [("a", 1, 2), ("a", 5, 1), ("b", 3, 1)]
    assert rel.new_complaints(numbers, numbers, ["k"]).count() == 0
    visits = rel.later_visits(numbers, ["k", "n"], "n")
    assert [tuple(r) for r in visits.collect()] == [("a", 2)]
    fields = spark.createDataFrame([(bytearray(b"\x00\x01\x2c"),)], "b binary")
    assert fields.select(rel.big_endian(F.col("b"), 1, 3)).collect()[0][0] == 300
    axes = spark.createDataFrame([({"depth": "1"},), ({"depth": "2"},)], "axes map<string,string>")
    assert {(r["shape"], r["shapes"]) for r in rel.axis_coverage(axes).collect()} == {("1", 2), ("2", 2)}
    assert rel.operator_table(spark).count() == 68


def test_conversation_files_hold_whole_texts(spark, sf, tmp_path):
    told = spark.read.parquet(f"{sf}/conversations.parquet")
    extra = [(-1, k, "user", t) for k, t in enumerate(["x" * 39 + "é tail", "(a\\b) \r\n" * 500, "", None, "z" * 100_000, "long " * 300])]
    told.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    digest = lambda texts: hashlib.sha256(b"".join(sorted(hashlib.sha256(t).digest() for t in texts))).hexdigest()
    want, got = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect():
        want[r.conv_id, r.turn % corpora.PAGES].append((r.text or "").encode())
    for r in corpora.conversation_files(spark, str(tmp_path)).collect():
        doc = files.parse(bytes(r.content))
        for page in range(corpora.PAGES):
            reader = TokenReader(Cursor(doc.get(3 + corpora.PAGES + page).raw))
            while (token := reader.take()).kind != "eof":
                if isinstance(token.value, PdfString):
                    got[int(r.file_id.rsplit("-", 1)[0]), page].append(token.value.data)
    assert max(map(len, want[-1, 1])) == 100_000
    assert {k: digest(v) for k, v in got.items()} == {k: digest(v) for k, v in want.items()}
