"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample; every vector is indexed.  Largest
inner product becomes least distance by one extra coordinate,
sqrt(M - |x|^2) with M the largest squared norm.  A vector near the border of
clusters is replicated to several lists.  Centroids are searched by a graph in
memory, and a query reads every list whose centroid is within a ratio of the
nearest one's distance; there is no cap on lists read.  The ratio is measured,
unless given: it is the least one that finds ``RECALL`` of the true neighbours
among the sampled vectors.  In the whole table neighbours are nearer than in
the sample, so recall there is at least about that.

Equal vectors are one entry: the index holds each distinct vector once with
its k + 1 smallest ids, which is all that k results can need, since ties go to
the smaller id.  So a vector that a third of all rows repeat is one entry, and
equal queries are searched once.  Lists are dealt to shards of bounded size,
and a list larger than a shard is split, so a task reads one shard and one
block of the queries that read it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import centroids, minhash
from .common import Scratch, hash_sample, hot_join, pick

LIST_ROWS = 400
MAX_LISTS = 4096
SAMPLE_ROWS = 20_000
SHARD_ROWS = 16_384
QUERY_ROWS = 4096
#: Border vectors go to lists up to this much farther than their nearest, if no chosen centroid is nearer to that list's.
BORDER = 1.03
REPLICAS = 4
#: Share of true neighbours that the measured ratio finds in the sample, and sampled queries that it is measured on.
RECALL, MEASURED = 0.95, 512
#: Points searched at once in the graph.
BATCH = 512


def search(
    spark: SparkSession,
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    ratio: float | None = None,
) -> DataFrame:
    """Return (query_id, rank, id, score) for the rows whose id ``every`` divides.

    Scores are inner products in double precision of the vectors as stored.
    Candidates are all rows but the query's own id; ranks start at 1, nearest
    first, ties to the smaller id; fewer than k candidates give fewer rows.
    Null vectors, vectors with null or non-finite components, zero vectors and
    rows without id take no part; nor do pairs whose product isn't finite.
    Vectors of different length have no product: each length is searched on
    its own.  Rows repeating an id and its vector count once.
    """
    scratch = Scratch(spark, "ann")
    table = scratch.keep(_valid(pick(vectors, id=id_col, vector=vector_col)), "vectors")
    shapes = table.groupBy("dim").agg(F.max("norm").alias("norm")).orderBy("dim").collect()
    found = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    for shape in shapes:
        found = found.unionByName(_search(scratch, table, shape["dim"], shape["norm"], k, every, id_col, ratio))
    return found


def _search(scratch: Scratch, table: DataFrame, dim: int, top: float, k: int, every: int, id_col: str, ratio: float | None) -> DataFrame:
    """The search among vectors of one length, the longest of which has the norm ``top``."""
    spark = scratch.spark
    rows = table.where(F.col("dim") == dim).select("id", "high", "low", "vector")
    entries = scratch.keep(
        rows.groupBy("high", "low").agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")), "entries"
    )
    asked = rows.where(F.col("id") % every == 0).select("id", "high", "low").distinct()
    named = entries.select(F.col("high").alias("h"), F.col("low").alias("l"), "entry", "n", "vector")
    same = (F.col("high") == F.col("h")) & (F.col("low") == F.col("l"))
    members = scratch.keep(asked.join(named.drop("vector"), same).select(F.col("id").alias("query_id"), F.col("entry").alias("q")), "members")
    queries = named.select(F.col("entry").alias("q"), "vector").join(members.select("q").distinct(), "q")

    total = entries.count()
    lists = min(MAX_LISTS, max(1, math.ceil(total / LIST_ROWS)))
    sample = hash_sample(entries, "entry", SAMPLE_ROWS, total).select("vector").toPandas()["vector"]
    index = centroids.Graph(centroids.balanced_centroids(lifted(sample, dim, top), lists))
    if ratio is None:
        ratio = measured_ratio(index, sample, dim, top, k)
    graph = spark.sparkContext.broadcast(index)

    postings = scratch.keep(_assign(entries.select("entry", "vector"), graph, dim, top), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts = deal(sizes)
    found = _score(scratch, postings, queries, graph, first, parts, dim, top, k, ratio)
    best = found.groupBy("q", "entry").agg(F.max("score").alias("score"))
    best = _ranked(best, ["q"], [F.desc("score"), "entry"], k + 1)

    copies = rows.join(named.where("n > 1").drop("vector"), same).select("entry", "id").distinct()
    ids = smallest(copies, k + 1).withColumnRenamed("entry", "e")
    spread = best.join(ids, F.col("entry") == F.col("e"), "left").select("q", F.coalesce("id", "entry").alias("id"), "score")
    spread = _ranked(spread, ["q"], [F.desc("score"), "id"], k + 1)
    paired = members.join(spread, "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        paired.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _ranked(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= most).drop("place")


def smallest(copies: DataFrame, most: int) -> DataFrame:
    """The smallest ids of every entry, by a tree of salted groups.

    Each level keeps ``most`` ids of a salted group, and an eighth as many
    salts remain, so no task sees more than a share of a frequent vector.
    """
    for salts in (512, 64, 8, 1):
        salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        copies = _ranked(salted, ["entry", "salt"], ["id"], most).drop("salt")
    return copies


def _valid(work: DataFrame) -> DataFrame:
    """(id, dim, norm, high, low, vector): vectors that take part, as doubles in binary."""
    wide = work.where("id is not null and vector is not null").withColumn("vector", F.col("vector").cast("array<double>"))
    schema = "id long, dim int, norm double, high long, low long, vector binary"

    def run(batches):
        for batch in batches:
            out = []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                item = values.values
                x = item.to_numpy(zero_copy_only=False)
                if len(x) and not item.null_count and np.isfinite(x).all() and x.any():
                    x = x.astype(np.float64) + 0.0  # no negative zeros, so equal vectors have equal bytes
                    high, low = minhash.set_digest(x)
                    peak = np.abs(x).max()
                    out.append((key, len(x), float(np.sqrt(((x / peak) ** 2).sum()) * peak), high, low, x.tobytes()))
            names = ("id", "dim", "norm", "high", "low", "vector")
            types = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

    return wide.select("id", "vector").mapInArrow(run, schema)


def stacked(vectors, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, vectors)), np.float64).reshape(-1, dim)


def lifted(vectors, dim: int, top: float) -> np.ndarray:
    """Vectors over the largest norm, with the coordinate that turns inner products into distances."""
    x = stacked(vectors, dim) / top
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])


def asking(vectors, dim: int, top: float) -> np.ndarray:
    """Queries in the space of :func:`lifted`."""
    x = stacked(vectors, dim) / top
    return np.hstack([x, np.zeros((len(x), 1))])


def measured_ratio(index: centroids.Graph, sample, dim: int, top: float, k: int) -> float:
    """The ratio that reaches ``RECALL`` of the k nearest within the sample, measured on its first vectors."""
    asked = sample[:MEASURED]
    products = asking(asked, dim, top)[:, :-1] @ (stacked(sample, dim) / top).T
    products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    most = min(k, len(sample) - 1)
    if most < 1:
        return 1.0
    near = np.argpartition(-products, most - 1, axis=1)[:, :most]
    away = centroids.distances(asking(asked, dim, top), index.centers)
    away /= np.maximum(away.min(1, keepdims=True), 1e-300)
    lists = {}
    needed = []
    wanted = np.unique(near)
    for a in range(0, len(wanted), BATCH):
        part = wanted[a : a + BATCH]
        met = index.search(lifted([sample[i] for i in part], dim, top), BORDER)
        lists.update(zip(part.tolist(), lists_of(index, met)))
    for row, found in zip(away, near.tolist()):
        needed += [row[lists[i]].min() for i in found]
    return float(np.quantile(needed, RECALL)) * 1.0001


def lists_of(graph: centroids.Graph, point_distances: np.ndarray) -> list[list[int]]:
    """For each vector its nearest list, and others across a border.

    A list within the ratio joins if its centroid is farther from every chosen
    centroid than from the vector, so replicas go to different sides.
    """
    out = []
    for met in point_distances:
        near = np.flatnonzero(met <= met.min() * BORDER)
        near = near[np.argsort(met[near], kind="stable")]
        chosen = [int(near[0])]
        for j in near[1:].tolist():
            if len(chosen) == REPLICAS:
                break
            gap = np.sqrt(((graph.centers[chosen] - graph.centers[j]) ** 2).sum(1)).min()
            if gap > met[j]:
                chosen.append(j)
        out.append(chosen)
    return out


def _assign(entries: DataFrame, graph, dim: int, top: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                keys, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
                met = graph.value.search(lifted(vectors, dim, top), BORDER)
                flat = [(j, e, v) for e, v, js in zip(keys, vectors, lists_of(graph.value, met)) for j in js]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))],
                    names=["list", "entry", "vector"],
                )

    return entries.mapInArrow(run, "list int, entry long, vector binary")


def deal(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """First shard and number of parts of every list; a shard holds whole lists up to its size."""
    first, parts = {}, {}
    shard = room = 0
    for j in sorted(sizes):
        parts[j] = math.ceil(sizes[j] / SHARD_ROWS)
        if parts[j] > 1 or sizes[j] > room:
            shard += 1
            room = SHARD_ROWS
        first[j] = shard
        if parts[j] > 1:
            shard += parts[j] - 1
            room = 0
        else:
            room -= sizes[j]
    return first, parts


def _score(scratch, postings, queries, graph, first, parts, dim: int, top: float, k: int, ratio: float) -> DataFrame:
    """(q, entry, score): the k + 1 best of every query in every shard that it reads.

    A shard is copied once for every ``QUERY_ROWS`` queries that read it, and
    not at all if none does.
    """
    lookup = postings.sparkSession.createDataFrame([(j, first[j], parts[j]) for j in sorted(first)], "j int, first int, parts int")
    placed = postings.join(F.broadcast(lookup), F.col("list") == F.col("j"))  # at most MAX_LISTS rows
    data = placed.select(
        (F.col("first") + F.pmod(F.xxhash64("entry"), "parts")).cast("int").alias("shard"),
        F.lit(False).alias("asks"), F.col("entry").alias("key"), "vector", F.array("list").alias("lists"),
    )

    def route(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                keys, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
                met = graph.value.search(asking(vectors, dim, top), ratio)
                out = []
                for key, vector, row in zip(keys, vectors, met):
                    shards: dict[int, list[int]] = {}
                    for j in np.flatnonzero(row <= row.min() * ratio).tolist():
                        for s in range(first[j], first[j] + parts[j]) if j in first else ():
                            shards.setdefault(s, []).append(j)
                    out += [(s, True, key, vector, js) for s, js in shards.items()]
                types = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                names = ["shard", "asks", "key", "vector", "lists"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    routed = queries.select("q", "vector").mapInArrow(route, "shard int, asks boolean, key long, vector binary, lists array<int>")
    routed = scratch.keep(routed, "asked")
    asks = scratch.keep(routed.groupBy(F.col("shard").alias("s")).agg(F.count(F.lit(1)).alias("n_asks")), "asks")
    blocks = F.ceil(F.col("n_asks") / QUERY_ROWS).cast("int")
    columns = ["shard", "block", "asks", "key", "vector", "lists"]
    placed = hot_join(scratch, data, asks, {"shard": "s"}, "n_asks", cheap=True)
    data = placed.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(columns)
    asked = hot_join(scratch, routed, asks, {"shard": "s"}, "n_asks", cheap=True)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).select(columns)

    def score(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        keys = table["key"].to_numpy()
        vectors = stacked(table["vector"].to_pylist(), dim)
        lists = table["lists"].to_pylist()
        q_rows, d_rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        list_of = np.array([lists[i][0] for i in d_rows], np.int64)
        order = np.lexsort((keys[d_rows], list_of))
        d_rows, list_of = d_rows[order], list_of[order]
        starts = {int(j): (a, b) for j, a, b in zip(*_runs(list_of))}
        data, entries = vectors[d_rows], keys[d_rows]
        out_q, out_e, out_s = [], [], []
        for a in range(0, len(q_rows), 256):
            part = q_rows[a : a + 256]
            scores = np.full((len(part), len(data)), -np.inf)
            readers: dict[int, list[int]] = {}
            for i, row in enumerate(part):
                for j in lists[row]:
                    readers.setdefault(j, []).append(i)
            for j, who in readers.items():
                if j in starts:
                    b, e = starts[j]
                    scores[np.array(who), b:e] = vectors[part[who]] @ data[b:e].T
            for i, row in enumerate(part):
                line = scores[i]
                if len(line) > k + 1:
                    bar = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                    top = np.flatnonzero((line >= bar) & np.isfinite(line))
                else:
                    top = np.flatnonzero(np.isfinite(line))
                top = top[np.lexsort((entries[top], -line[top]))]
                _, once = np.unique(entries[top], return_index=True)
                top = top[np.sort(once)][: k + 1]
                out_q.append(np.full(len(top), keys[row]))
                out_e.append(entries[top])
                out_s.append(line[top])
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.empty(0), t)
        return pa.table({"q": join(out_q, pa.int64()), "entry": join(out_e, pa.int64()), "score": join(out_s, pa.float64())})

    return data.unionByName(asked).groupBy("shard", "block").applyInArrow(score, "q long, entry long, score double")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of every run of a sorted array."""
    if not len(values):
        return values, values, values
    edges = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], edges])
    return values[starts], starts, np.concatenate([edges, [len(values)]])
