"""The relational work of a PDF engine as DataFrame plans, without Python on rows.

Windows are over one file's rows, which a file's size bounds; everything else
is joins and aggregates that combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel import content, declare, pagetree
from ..runtime import Scratch


def newest_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """For each key the row that comes first in ``order``: merged sections, last writes, hybrids' tables before streams."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def prioritised_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first``, and of ``second`` those whose key isn't there."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def drop_above_size(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Entries whose number isn't above the file's /Size; the number that equals it stays."""
    return entries.join(headers.select("file_id", "size"), "file_id").where(F.col("object_number") <= F.col("size")).drop("size")


def merged_entries(entries: DataFrame, headers: DataFrame) -> DataFrame:
    return newest_wins(drop_above_size(entries, headers), ["file_id", "object_number"], ["section_ord"])


def lookup(references: DataFrame, objects: DataFrame) -> DataFrame:
    """References with the object that they name; a missing one is the null object."""
    named = objects.select("file_id", F.col("object_number").alias("ref_num"), F.col("generation").alias("ref_gen"), "kind", "cos")
    found = references.join(named, ["file_id", "ref_num", "ref_gen"], "left")
    return found.withColumns({"kind": F.coalesce("kind", F.lit("null")), "cos": F.coalesce("cos", F.lit("null"))})


def compressed_lookup(entries: DataFrame, slots: DataFrame) -> DataFrame:
    """Compressed entries with their slot, and whether the slot holds their number."""
    held = slots.select("file_id", F.col("container").alias("a"), F.col("idx").cast("long").alias("b"), F.col("object_number").alias("held"), "offset")
    found = entries.where("kind = 'compressed'").join(held, ["file_id", "a", "b"], "left")
    return found.withColumn("right", F.coalesce(F.col("held") == F.col("object_number"), F.lit(False)))


def reference_summary(references: DataFrame) -> DataFrame:
    """For each file the number of distinct objects referred to, and the highest number."""
    return references.groupBy("file_id").agg(F.count_distinct("ref_num").alias("n_targets"), F.max("ref_num").alias("highest"))


def lowest_free(used: DataFrame, key: str, number: str) -> DataFrame:
    """For each key the lowest positive number that isn't used.

    It is 1, or follows a used number whose successor isn't used.
    """
    own = used.select(F.col(key).alias("_k"), F.col(number).cast("long").alias("_n")).where("_n > 0").distinct()
    keys = used.select(F.col(key).alias("_k")).distinct()
    after = own.select("_k", (F.col("_n") + 1).alias("_n")).unionByName(keys.withColumn("_n", F.lit(1).cast("long")))
    free = after.join(own, ["_k", "_n"], "left_anti")
    return free.groupBy("_k").agg(F.min("_n").alias("free_number")).withColumnRenamed("_k", key)


def overlay(base: DataFrame, changes: DataFrame, deletions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Base rows under their last change, without what is deleted."""
    last = newest_wins(changes, keys, [F.desc(order)]).drop(order)
    return prioritised_union(last, base, keys).join(deletions.select(*keys).distinct(), keys, "left_anti")


def runs(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """(key, first, count) of runs of consecutive numbers."""
    own = numbers.select(F.col(key), F.col(number).alias("_n")).distinct()
    island = F.col("_n") - F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    grouped = own.withColumn("_island", island).groupBy(key, "_island")
    return grouped.agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("count")).drop("_island")


def offsets(bodies: DataFrame, key: str, order: str, length: str, start: int) -> DataFrame:
    """Adds ``offset``: where each body begins if they stand one behind another."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return bodies.withColumn("offset", F.lit(start) + F.coalesce(F.sum(length).over(before), F.lit(0)))


def fill_gaps(entries: DataFrame) -> DataFrame:
    """Every number from 0 to the file's highest; those without entry are free with generation 65535."""
    highest = entries.groupBy("file_id").agg(F.max("object_number").alias("_h"))
    dense = highest.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), "_h")).alias("object_number"))
    found = dense.join(entries, ["file_id", "object_number"], "left")
    return found.withColumns({"kind": F.coalesce("kind", F.lit("free")), "a": F.coalesce("a", F.lit(0)), "b": F.coalesce("b", F.lit(65535))})


def field_widths(entries: DataFrame) -> DataFrame:
    """Bytes that the second and third field of a cross-reference stream need."""
    width = lambda c: F.greatest(F.lit(1), F.ceil(F.length(F.hex(F.max(c))) / 2)).cast("int")
    return entries.groupBy("file_id").agg(width("a").alias("w2"), width("b").alias("w3"))


def big_endian(binary: Column, start: int, width: int) -> Column:
    """An unsigned field of up to 8 bytes at a 1-based byte position."""
    return F.conv(F.hex(F.substring(binary, start, width)), 16, 10).cast("decimal(20,0)")


def descendant_counts(edges: DataFrame, roots: DataFrame, max_depth: int = pagetree.MAX_DEPTH) -> DataFrame:
    """Pages below every node, from edges (file_id, parent, child, is_page), level by level.

    The cross-check of the walk in the kernel: one join for each level of the
    deepest tree, which the depth limit bounds.  Edges and frontiers are
    written to the shared folder, so a lost executor costs one level at most.
    """
    scratch = Scratch(edges.sparkSession, "descendants")
    edges = scratch.keep(edges, "edges")
    reached = roots.select("file_id", F.col("node").alias("ancestor"), F.col("node").alias("parent"))
    found = None
    for _ in range(max_depth):
        step = scratch.keep(reached.join(edges, ["file_id", "parent"]).select("file_id", "ancestor", "child", "is_page"), "step")
        pages = step.where("is_page").groupBy("file_id", "ancestor").agg(F.count(F.lit(1)).alias("pages"))
        found = pages if found is None else found.unionByName(pages)
        reached = step.where("not is_page").select("file_id", "ancestor", F.col("child").alias("parent"))
        if reached.isEmpty():
            break
    return found.groupBy("file_id", "ancestor").agg(F.sum("pages").alias("pages"))


def later_visits(visits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later visits of a key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return visits.withColumn("_place", place).where("_place > 1").drop("_place")


def nearest(values: DataFrame, keys: list[str], distance: str, value: str) -> DataFrame:
    """For each key the non-null value at the smallest distance."""
    return values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, distance).alias(value))


def wrong_parents(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Children whose declared parent isn't the node that lists them."""
    both = edges.select("file_id", "child", "parent").join(declared.select("file_id", "child", "declared"), ["file_id", "child"])
    return both.where(~F.col("parent").eqNullSafe(F.col("declared")))


_NODE_VALUES = ("kind", "bool_v", "int_v", "int_text", "real_v", "name_v", "bytes_v", "str_form", "ref_num", "ref_gen")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths at which two node tables differ; a stream's /Length is left out."""
    keys = ["file_id", "object_number", "generation", "path"]
    side = lambda df, name: df.where("not (path = '/Length' and depth = 1)").select(*keys, F.struct(*_NODE_VALUES).alias(name))
    joined = side(before, "left_v").join(side(after, "right_v"), keys, "full_outer")
    return joined.where(~F.col("left_v").eqNullSafe(F.col("right_v")))


def failure_groups(errors: DataFrame, samples: int = 5) -> DataFrame:
    """Failures by normalised message: count, the first message, and the first files.

    Files come by a bounded top list within partial groups, not by gathering
    them all.
    """
    place = F.row_number().over(Window.partitionBy("normalised").orderBy("file_id"))
    first = errors.withColumn("_place", place).where(F.col("_place") <= samples)
    named = first.groupBy("normalised").agg(F.array_sort(F.collect_list("file_id")).alias("files"))
    counted = errors.groupBy("normalised").agg(F.count(F.lit(1)).alias("n_files"), F.min_by("message", "file_id").alias("sample"))
    return counted.join(named, "normalised")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("mode", "outcome").agg(F.count(F.lit(1)).alias("n_files"))


def gate(outcomes: DataFrame, expected: int) -> DataFrame:
    """One row: whether exactly the expected number of files is ok; more is a failure too."""
    ok = F.coalesce(F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)), F.lit(0)).cast("long")
    return outcomes.agg(F.count(F.lit(1)).alias("total"), ok.alias("ok")).withColumn("passed", F.col("ok") == F.lit(expected))


def new_complaints(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Complaints after a rewrite that weren't there before."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a pinned manifest (file_id, length, sha256): (file_id, status) with status ok, changed, missing or extra."""
    here = files.select("file_id", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("digest"))
    pinned = manifest.select(F.col("file_id").alias("pinned"), "length", "sha256")
    status = (
        F.when(F.col("pinned").isNull(), "extra")
        .when(F.col("file_id").isNull(), "missing")
        .when((F.col("n") == F.col("length")) & (F.col("digest") == F.col("sha256")), "ok")
        .otherwise("changed")
    )
    joined = here.join(pinned, F.col("file_id") == F.col("pinned"), "full_outer")
    return joined.select(F.coalesce("file_id", "pinned").alias("file_id"), status.alias("status"))


def kind_histogram(objects: DataFrame) -> DataFrame:
    return objects.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def operator_table(spark) -> DataFrame:
    """The 68 operators as a dimension."""
    rows = [(o.name, list(o.where), o.enters, o.opens, o.closes) for o in content.OPERATORS.values()]
    return spark.createDataFrame(rows, "operator string, where array<string>, enters string, opens string, closes string")


def operator_problem(operators: Column) -> Column:
    """The first clause that an array of operators breaks, or null, as a fold over the array."""
    literal_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    where = F.create_map(*[x for o in content.OPERATORS.values() for x in (F.lit(o.name), F.array(*[F.lit(w) for w in o.where]))])
    enters, opens, closes = (literal_map({n: getattr(o, f) for n, o in content.OPERATORS.items() if getattr(o, f)}) for f in ("enters", "opens", "closes"))
    refused = F.array(*[F.lit(n) for n in content.REFUSED])
    start = F.struct(F.lit("page").alias("context"), F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("problem"))

    def step(s, op):
        allowed, closing, opening = where[op], closes[op], opens[op]
        top = F.get(s["open"], F.size(s["open"]) - 1)
        problem = (
            F.when(F.array_contains(refused, op), F.concat(F.lit("refused "), op))
            .when(allowed.isNull(), F.concat(F.lit("unknown "), op))
            .when(~F.array_contains(allowed, s["context"]), F.concat(F.lit("context "), op))
            .when(closing.isNotNull() & ~closing.eqNullSafe(top), F.concat(F.lit("nesting "), op))
        )
        left = F.when(closing.isNotNull(), F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        grown = F.when(opening.isNotNull(), F.concat(left, F.array(opening))).otherwise(left)
        return F.struct(
            F.coalesce(enters[op], s["context"]).alias("context"), grown.alias("open"), F.coalesce(s["problem"], problem).alias("problem")
        )

    def finish(s):
        return F.coalesce(
            s["problem"],
            F.when(F.size(s["open"]) > 0, F.lit("unclosed")),
            F.when(s["context"] != "page", F.concat(F.lit("ends in "), s["context"])),
        )

    return F.aggregate(operators, start, step, finish)


def marked_content_ids(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds ``mcid``: the item's place in its stream, from 0."""
    return items.withColumn("mcid", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def spans_pages(items: DataFrame, keys: list[str], page: str) -> DataFrame:
    return items.groupBy(*keys).agg((F.count_distinct(page) > 1).alias("spans"))


FACTS = ("title", "lang", "display_title", "suspects", "marked", "has_tree", "output_intent", "encrypted", "file_id_entry", "has_info", "n_attached", "n_related")


def unmet_rules(level: str) -> Column:
    """The ids of a level's unmet rules, in order, over the columns of FACTS."""
    c = F.col
    told = lambda x: F.coalesce(x, F.lit(False))
    holds = {
        "R-7.1-12": told(F.length(F.trim(c("title"))) > 0), "R-7.1-15": told(c("display_title")), "R-7.1-18": ~told(c("suspects")),
        "R-7.1-1": told(c("marked")) & told(c("has_tree")), "R-7.2-5": told(F.length(c("lang")) > 0), "PRE-OUTPUTINTENT": told(c("output_intent")),
        "PRE-NOENCRYPT": ~told(c("encrypted")), "PRE-FILEID": told(c("file_id_entry")), "PRE-NOINFO": ~told(c("has_info")),
        "PRE-AFRELATIONSHIP": c("n_related") >= c("n_attached"), "PRE-NOATTACHMENTS": c("n_attached") == 0,
    }
    rules = [F.struct(F.lit(r.id).alias("id"), holds[r.id].alias("holds")) for r in declare.RULES if level in r.levels]
    return F.transform(F.filter(F.array(*rules), lambda r: ~r["holds"]), lambda r: r["id"])


def axis_coverage(fixtures: DataFrame) -> DataFrame:
    """(axis, shape, n) and the number of shapes of every axis, from a map column ``axes``."""
    shapes = fixtures.select(F.explode("axes").alias("axis", "shape")).groupBy("axis", "shape").agg(F.count(F.lit(1)).alias("n"))
    return shapes.join(shapes.groupBy("axis").agg(F.count(F.lit(1)).alias("shapes")), "axis")
