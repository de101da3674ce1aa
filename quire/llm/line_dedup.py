"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``ratio`` of the host's pages
contain it, and every such line goes.  Lines are counted by the page, not by
occurrence, and compared without the spaces round them; blank lines are layout
and always stay.  A line of one page only isn't repeated, so ``min_pages`` is 2.

A page that the site has many times would lose all its text in that way.  With
``spare_copies`` a page stays whole whose whole text is itself over the ratio
on its host, or of which nothing would be left, so that a later near-dedup can
keep one of the copies; any other page loses every line over the ratio.

The plan has no Python and never brings a host's pages together.  Lines are
counted under (host, line) with partial sums.  The boilerplate found is at
most (lines on a page / ratio) lines for each host; where that table has at
most ``broadcast_rows`` rows it is broadcast, and texts aren't shuffled at
all.  Beyond that, lines are joined with it by key and the marked lines are
gathered for each page.  Frequent hosts and lines never gather in one task
(``common.hot_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, hot_join


def dedup_lines(
    spark: SparkSession,
    docs: DataFrame,
    *,
    ratio_percent: int = 5,
    min_pages: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    keep_cols: tuple[str, ...] = (),
    spare_copies: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Return (id, text, n_lines, n_dropped, *keep_cols), one row for each input row.

    A line goes if pages * 100 > ratio_percent * the host's pages and at least
    ``min_pages`` pages of the host contain it.  Lines are what stands between
    newlines; the kept ones are joined by newlines again, in order.  A page
    that loses every line has an empty text.  A null text stays null with no
    lines, an empty text has one blank line.  A null host is a host of its
    own.  Repeated rows are pages of their own.
    """
    work = docs.select(
        F.col(f"`{id_col}`").alias("d_id"),
        F.col(f"`{text_col}`").alias("d_text"),
        F.col(f"`{host_col}`").alias("d_host"),
        *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep_cols)],
    )
    scratch = Scratch(spark, "line-dedup")
    totals = work.groupBy(F.col("d_host").alias("t_host")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.octet_length(F.coalesce("d_text", F.lit(""))) + F.lit(1)).alias("bytes")
    )
    totals = scratch.keep(totals, "totals")

    def over(counted: DataFrame) -> DataFrame:
        """Of (d_host, pages, ...) the rows over the ratio; a host's lines and pages are at most its bytes."""
        repeated = counted.where(F.col("pages") >= min_pages)
        joined = hot_join(scratch, repeated, totals, {"d_host": "t_host"}, "bytes", rows=broadcast_rows, null_safe=True)
        return joined.where(F.col("pages") * 100 > F.col("total") * ratio_percent).drop("t_host", "total", "bytes")

    if spare_copies:
        digests = work.withColumns({"p1": F.xxhash64("d_text"), "p2": F.xxhash64(F.lit(1), "d_text")})
        pages = digests.where("d_text is not null").groupBy("d_host", "p1", "p2").agg(F.count(F.lit(1)).alias("pages"))
        named = [F.col(a).alias(b) for a, b in (("d_host", "c_host"), ("p1", "c1"), ("p2", "c2"), ("pages", "c_pages"))]
        copies = scratch.keep(over(pages).select(*named), "copies")
        found = hot_join(scratch, digests, copies, {"d_host": "c_host", "p1": "c1", "p2": "c2"}, "c_pages", how="left", rows=broadcast_rows, null_safe=True)
        work = found.withColumn("spared", F.col("c1").isNotNull()).select(*work.columns, "spared")
    else:
        work = work.withColumn("spared", F.lit(False))

    boiler = over(line_counts(work)).select(F.col("d_host").alias("b_host"), F.col("h1").alias("b_h1"), F.col("pages").alias("b_pages"))
    boiler = scratch.keep(boiler, "boilerplate")
    if boiler.count() <= broadcast_rows:
        marks = boiler.groupBy("b_host").agg(F.collect_set("b_h1").alias("marks"))
        marked = work.join(F.broadcast(marks), F.col("d_host").eqNullSafe(F.col("b_host")), "left")
    else:
        numbered = scratch.keep(work.withColumn("row", F.monotonically_increasing_id()), "numbered")
        lines = numbered.where("not spared").select("row", "d_host", F.explode(_distinct_lines()).alias("line"))
        keyed = lines.select("row", "d_host", F.xxhash64("line").alias("h1"))
        hits = hot_join(scratch, keyed, boiler, {"d_host": "b_host", "h1": "b_h1"}, "b_pages", how="left_semi", rows=broadcast_rows, null_safe=True)
        marks = hits.groupBy("row").agg(F.collect_set("h1").alias("marks"))
        marked = numbered.join(marks, "row", "left")
    split = marked.withColumn("lines", F.split("d_text", "\n", -1))
    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("marks", F.xxhash64(F.trim(x))))
    whole = F.col("marks").isNull() | F.col("spared")
    if spare_copies:
        whole = whole | ~F.exists(kept, lambda x: F.trim(x) != "")
    split = split.withColumn("kept", F.when(whole, F.col("lines")).otherwise(kept))
    size = lambda c: F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return split.select(
        F.col("d_id").alias(id_col),
        F.when(F.col("d_text").isNotNull(), F.array_join("kept", "\n")).alias(text_col),
        size("lines").alias("n_lines"),
        (size("lines") - size("kept")).alias("n_dropped"),
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep_cols)],
    )


def _distinct_lines() -> Column:
    """The page's lines without surrounding spaces and blank ones, each once."""
    trimmed = F.transform(F.split("d_text", "\n", -1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def line_counts(work: DataFrame) -> DataFrame:
    """(d_host, h1, h2, pages) of every line.

    Lines are counted under 128 bits of hash, so their text isn't shuffled;
    within one host the first 64 bits then name a line.
    """
    lines = work.select("d_host", F.explode(_distinct_lines()).alias("line"))
    keyed = lines.select("d_host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return keyed.groupBy("d_host", "h1", "h2").agg(F.count(F.lit(1)).alias("pages"))
