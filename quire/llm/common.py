"""Shared pieces: Arrow maps, and joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, shared_dir

__all__ = ["Scratch", "arrow_rows", "hash_sample", "heavier", "hot_join", "partitions", "pick", "read_table", "shared_dir", "to_batch"]

#: Rows that may be broadcast: small tables whole, or the heaviest keys of a large one.
BROADCAST_ROWS = 50_000


def hot_join(
    scratch: Scratch, big: DataFrame, small: DataFrame, on: dict[str, str], weight: str, *, how: str = "inner", rows: int = BROADCAST_ROWS,
    cheap: bool = False, null_safe: bool = False,
) -> DataFrame:
    """Join ``big`` with ``small`` (a written table, one row for each key), however many rows of ``big`` share a key.

    ``on`` maps columns of ``big`` to those of ``small``; nulls are equal if
    ``null_safe``.  (A plain equality of one integer has the smallest table in
    memory: the null-safe one takes a whole memory page on every executor.)
    ``weight``, a column of ``small``, bounds the rows of ``big`` with that
    key.  Up to ``rows`` rows are broadcast whole.  Of a larger table the
    heaviest, ``rows`` at most, are broadcast, and only rows of ``big`` with
    other keys are shuffled; none has many more than (sum of weights / rows).
    ``how`` is inner, left or left_semi.  ``big`` is then read twice, and is
    written before unless it is ``cheap``.
    """
    same = F.lit(True)
    for left, right in on.items():
        same = same & (F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right))
    if small.count() <= rows:
        return big.join(F.broadcast(small), same, how)
    heaviest = heavier(small, weight, rows)
    heavy, light = small.where(heaviest), small.where(~heaviest)
    big = big if cheap else scratch.keep(big, "hot")
    other = big.join(F.broadcast(heavy.select(*on.values())), same, "left_anti").join(light, same, how)
    return big.join(F.broadcast(heavy), same, "inner" if how == "left" else how).unionByName(other)


def heavier(table: DataFrame, weight: str, rows: int) -> Column:
    """The condition that at most ``rows`` rows of a written table fulfil, those of the greatest weights (from 1).

    Weights are counted by eighths of their logarithm, so a few hundred counts
    come to the driver whatever the size of the table.  Any other weight is at
    most 1.1 * (sum of weights / rows).
    """
    level = F.floor(F.log2(F.col(weight).cast("double")) * 8)
    counts = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, 1 << 20
    for r in sorted(counts, key=lambda r: -r["level"]):
        held += r["n"]
        if held > rows:
            break
        least = r["level"]
    return level >= F.lit(least)


def hash_sample(table: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows of the smallest hashes, of a table of ``total`` rows; few others are sorted with them."""
    share = min(1.0, 2 * rows / max(1, total) + 1e-6)
    near = table.where(F.xxhash64(column) <= F.lit(int(-(2**63) + share * (2**64 - 2**12))))
    return near.orderBy(F.xxhash64(column), column).limit(rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that others can't clash."""
    return df.select([F.col(f"`{column}`").alias(name) for name, column in columns.items()])


def arrow_rows(
    df: DataFrame, schema: str, rows: Callable[[], Callable[[dict], Iterable[tuple]]], *, flush_bytes: int = 8 << 20
) -> DataFrame:
    """Map rows with Python in Arrow batches.

    ``rows()`` runs once in each task and returns a function from one row (as
    a dict) to output tuples.  Output goes out whenever about ``flush_bytes``
    of it have gathered, so memory follows single rows, not partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = rows()
        out: list[tuple] = []
        size = 0
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(i) for i in range(len(names))]
            for i in range(batch.num_rows):
                for row in work({n: c[i].as_py() for n, c in zip(names, columns)}):
                    out.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if size >= flush_bytes:
                        yield to_batch(out, target)
                        out, size = [], 0
        if out:
            yield to_batch(out, target)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
