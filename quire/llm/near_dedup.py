"""Near-duplicate components by circulant MinHash, banding and exact Jaccard.

Order of work:

1. Every document becomes its shingle set, a digest of the set and its band
   keys.  Documents of equal sets collapse into one node (the smallest id), so
   thousands of copies cost one node.
2. Nodes that share a band key share a bucket.  In each bucket a leader is
   compared with the others: the node that meets most others over all its
   buckets, which is the text that the others were copied from, if it is
   there.  So a bucket of n gives n - 1 pairs, not n squared.
3. Links are confirmed on the full sets, and components found.
4. A bucket whose nodes are in one component is done.  In any other, the nodes
   outside its largest component are compared with all nodes of the bucket,
   block against block, on signatures; first only each node's most alike
   partner goes on to the exact check, and where components remain apart,
   every pair whose signatures agree enough does.  This loses no link that
   banding has found, whatever the size of the bucket.

With 32 bands of 4 rows two sets of similarity 0.8 share no bucket with
probability 5e-8.  In step 4, signatures of 1024 coordinates must agree in 74 %
before the exact check; at similarity 0.8 fewer agree with probability 8e-7.
A pair is looked at in the first bucket that it shares only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import Scratch, arrow_rows, hot_join, partitions, pick, to_batch
from .components import components

BANDS, ROWS = 32, 4
#: Rows of a bucket that a task looks through for its leader, and pairs of a node that a task confirms.
PART_ROWS, PAIR_ROWS = 1024, 1024
#: Rows of one block in step 4.
BLOCK_ROWS = 512
#: Coordinates of the signatures in step 4, a byte each, and how far below the wanted similarity their agreement may be.
LONG, SLACK = 1024, 0.06


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (id, n_shingles, component_id, kept), one row for each input row.

    Documents are linked where 100 * intersection >= percent * union of their
    sets of ``width``-word shingles.  ``component_id`` is the smallest id that
    links reach; the document of that id is kept.  A null, empty or blank text
    has no shingles, is linked with nothing and kept.  Rows that repeat an id
    are one document, and each repeats its result.  A null id is never kept
    but takes part.  Other columns are not read.
    """
    scratch = Scratch(spark, "near-dedup")
    work = pick(docs, id=id_col, text=text_col)
    sets = scratch.keep(_describe(work, width), "sets")
    filled = sets.where("n > 0")
    nodes = scratch.keep(
        filled.groupBy("high", "low").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")
        ),
        "nodes",
    )
    buckets = scratch.keep(_buckets(scratch, nodes), "buckets")
    members = scratch.keep(_members(work, buckets, width), "members")

    pairs = scratch.keep(_leader_pairs(scratch, buckets), "pairs")
    links = scratch.keep(_confirm(scratch, pairs, members, percent), "links")
    scratch.drop(pairs)
    labels = components(scratch, links)
    for best in (True, False):
        apart = scratch.keep(_apart(scratch, buckets, labels), "apart")
        if apart.isEmpty():
            break
        pairs = scratch.keep(_block_pairs(apart, members, percent, best), "pairs")
        more = scratch.keep(_confirm(scratch, pairs, members, percent), "links")
        scratch.drop(apart, pairs)
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        labels = components(scratch, links)
    scratch.drop(buckets, members)

    named = nodes.select("high", "low", "node").join(labels, "node", "left")
    found = named.select(F.col("high").alias("h"), F.col("low").alias("l"), F.coalesce("label", "node").alias("component"))
    joined = sets.select("id", "n", "high", "low").join(
        found, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")), "left"
    )
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _describe(work: DataFrame, width: int) -> DataFrame:
    def rows():
        shingles = minhash.shingler(width)
        circulant = minhash.Circulant(BANDS, ROWS)

        def one(row):
            own = shingles(row["text"])
            if len(own):
                high, low = minhash.set_digest(own)
                yield row["id"], len(own), high, low, circulant.band_keys(circulant.signature(own)).tolist()
            else:
                yield row["id"], 0, None, None, None

        return one

    return arrow_rows(work, "id long, n long, high long, low long, keys array<long>", rows)


def _buckets(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, size) of every bucket with at least two nodes."""
    dealt = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    sizes = dealt.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = scratch.keep(sizes, "sizes")
    return hot_join(scratch, dealt, sizes, {"key": "s_key"}, "size", cheap=True).select("key", "band", "node", "n", "size")


def _members(work: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(node, n, sign, shingles) of every node that is in a bucket.

    ``sign`` has the first four bytes of every band key, then the long
    signature cut to a byte for each coordinate.
    """
    wanted = buckets.select(F.col("node").alias("id")).distinct()

    def rows():
        shingles = minhash.shingler(width)
        circulant = minhash.Circulant(BANDS, ROWS, LONG)

        def one(row):
            own = shingles(row["text"])
            if len(own):
                signature = circulant.signature(own)
                keys = circulant.band_keys(signature).astype(np.uint32)
                yield row["id"], len(own), keys.tobytes() + signature.astype(np.uint8).tobytes(), own.tobytes()

        return one

    texts = work.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    return arrow_rows(texts, "node long, n long, sign binary, shingles binary", rows)


def _leader_pairs(scratch: Scratch, buckets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every bucket's leader and its other nodes."""
    met = buckets.groupBy("node").agg(F.sum("size").alias("met")).withColumnRenamed("node", "m")
    scored = buckets.join(met, F.col("node") == F.col("m"))
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART_ROWS))  # a large bucket's rows meet in two steps
    best = F.max(F.struct("met", (-F.col("node")).alias("minus"), "n", "size")).alias("top")
    part = scratch.keep(scored.groupBy("key", spread.alias("salt")).agg(best), "parts")
    large = part.where(F.col("top.size") > PART_ROWS).groupBy("key").agg(F.max("top").alias("top"))
    leaders = part.where(F.col("top.size") <= PART_ROWS).select("key", "top").unionByName(large)
    leaders = leaders.select(F.col("key").alias("l_key"), "top", F.col("top.size").alias("l_size"))
    pairs = hot_join(scratch, buckets, leaders, {"key": "l_key"}, "l_size", cheap=True).select(
        (-F.col("top.minus")).alias("a"), F.col("node").alias("b"), F.col("top.n").alias("n_a"), F.col("n").alias("n_b")
    )
    return pairs.where("a <> b").distinct()


def _confirm(scratch: Scratch, pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b), a written table, that hold on the full sets, as (a, b).

    A node in very many pairs is dealt with its set to a task for every
    ``PAIR_ROWS`` of them.
    """
    fair = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.where(fair).select("a", "b")
    parts = F.coalesce(F.ceil(F.col("met") / PAIR_ROWS), F.lit(1))
    most = {}
    for own, other in (("b", "a"), ("a", "b")):
        met = pairs.where(fair).groupBy(F.col(own).alias("o")).agg(F.count(F.lit(1)).alias("met"))
        most[own] = scratch.keep(met.where(F.col("met") > PAIR_ROWS), f"most-{own}")
        salted = hot_join(scratch, both, most[own], {own: "o"}, "met", how="left")
        both = salted.withColumn(f"salt_{own}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("o", "met")
    for own in ("b", "a"):
        sets = hot_join(scratch, members.select(F.col("node").alias("m"), "shingles"), most[own], {"m": "o"}, "met", how="left", cheap=True)
        sets = sets.select("m", F.col("shingles").alias(f"set_{own}"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
        both = both.join(sets, (F.col(own) == F.col("m")) & (F.col(f"salt_{own}") == F.col("part"))).drop("m", "part", f"salt_{own}")

    def rows():
        def one(row):
            sets = (np.frombuffer(row[k], np.uint64) for k in ("set_a", "set_b"))
            if minhash.linked(*sets, percent):
                yield row["a"], row["b"]

        return one

    return arrow_rows(both.select("a", "b", "set_a", "set_b"), "a long, b long", rows)


def _apart(scratch: Scratch, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets whose nodes aren't in one component, with what step 4 needs.

    Buckets of two are left out: their only pair was the leader's.
    """
    named = (
        buckets.where("size > 2")
        .join(labels.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
        .select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    )
    each = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
    per_key = (
        each.groupBy("key")
        .agg(
            F.sum("rows").alias("size"),
            F.count(F.lit(1)).alias("labels"),
            F.max(F.struct("rows", (-F.col("label")).alias("minus"))).alias("top"),
        )
        .where("labels > 1")
        .select(F.col("key").alias("p_key"), "size", (F.col("size") - F.col("top.rows")).alias("minor"), (-F.col("top.minus")).alias("main"))
    )
    per_key = scratch.keep(per_key, "mixed")
    joined = hot_join(scratch, named, per_key, {"key": "p_key"}, "size")
    return joined.withColumn("is_minor", F.col("label") != F.col("main")).drop("main", "p_key")


def _block_pairs(apart: DataFrame, members: DataFrame, percent: int, best: bool) -> DataFrame:
    """Cross-component pairs (a, b, n_a, n_b) whose signatures agree enough.

    A bucket's rows are dealt to blocks by hash; the minor rows are the
    queries.  A group is one block of queries and one block of rows, so it is
    bounded, however large the bucket.
    """
    blocks = lambda column: F.ceil(F.col(column) / BLOCK_ROWS).cast("int")
    slot = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), count).cast("int")
    rows = apart.withColumns({"q_blocks": blocks("minor"), "r_blocks": blocks("size")})
    rows = rows.withColumns({"q": slot(F.col("q_blocks"), 1), "r": slot(F.col("r_blocks"), 2)})
    as_row = rows.select(
        "key", "band", "is_minor", "node", "n", "label", F.lit(False).alias("query"), "r", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q")
    )
    as_query = rows.where("is_minor").select(
        "key", "band", "is_minor", "node", "n", "label", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)).alias("r"), "q"
    )
    signs = members.select(F.col("node").alias("m"), "sign")
    signed = as_row.unionByName(as_query).join(signs, F.col("node") == F.col("m"))
    dealt = (
        signed.select("key", "q", "r", "query", "node", "n", "label", "sign", "band", "is_minor")
        .repartition(partitions(apart.sparkSession), "key", "q", "r")
        .sortWithinPartitions("key", "q", "r")
    )
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "n_a", "n_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        at = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[:3] != at:
                    out += _alike(held, percent, best)
                    held, at = [], row[:3]
                    if len(out) > 100_000:
                        yield to_batch(out, schema)
                        out = []
                held.append(row[3:])
        yield to_batch(out + list(_alike(held, percent, best)), schema)

    return dealt.mapInArrow(run, "a long, b long, n_a long, n_b long").distinct()


def _alike(held: list[tuple], percent: int, best: bool) -> Iterator[tuple]:
    """Pairs of a query and a row of another component; only the best of each query if asked.

    A pair of two queries is met twice and given once.
    """
    queries = [r for r in held if r[0]]
    rows = [r for r in held if not r[0]]
    if not queries or not rows:
        return
    band = rows[0][5]
    signs = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    keys = np.ascontiguousarray(signs[:, : 4 * BANDS]).view(np.uint32)[:, :band]
    signs = np.ascontiguousarray(signs[:, 4 * BANDS :])
    sizes = np.array([r[2] for r in rows], np.int64)
    labels = np.array([r[3] for r in rows], np.int64)
    nodes = np.array([r[1] for r in rows], np.int64)
    minor = np.array([r[6] for r in rows], bool)
    least = (percent / 100 - SLACK) * LONG
    for _, node, n, label, sign, _, _ in queries:
        wanted = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (labels != label)
        wanted &= ~(keys == np.frombuffer(sign, np.uint32, BANDS)[:band]).any(axis=1)  # met in an earlier bucket
        if not best:
            wanted &= ~(minor & (nodes < node))
        at = np.flatnonzero(wanted)
        if not len(at):
            continue
        agree = (signs[at] == np.frombuffer(sign, np.uint8, offset=4 * BANDS)).sum(axis=1)
        if best:
            chosen = [int(at[agree.argmax()])] if agree.max() >= least else []
        else:
            chosen = at[agree >= least].tolist()
        for i in chosen:
            other, m = rows[i][1], rows[i][2]
            yield (node, other, n, m) if node < other else (other, node, m, n)
