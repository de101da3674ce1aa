"""Running kernels over files in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Output that gathers before a batch goes out.
FLUSH_BYTES = 8 << 20


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)], schema)


def map_rows(df: DataFrame, schema: str, work: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Call ``work`` with the columns of every row; its tuples become rows of ``schema``.

    One row's input and some megabytes of output are in memory at a time
    besides the Arrow batch.
    """
    target = arrow_schema(schema)

    def run(batches):
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in work(*(batch.column(c)[i].as_py() for c in range(batch.num_columns))):
                    out.append(row)
                    size += 64 + sum([len(x) * (8 if isinstance(x, list) else 1) for x in row if isinstance(x, (bytes, str, list))])
                    if size > FLUSH_BYTES:
                        yield batch_of(out, target)
                        out, size = [], 0
        if out:
            yield batch_of(out, target)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[tuple, list[dict]], Iterable[tuple]]) -> DataFrame:
    """Call ``work`` with the key and the rows of every group; groups must be bounded by their keys.

    Groups are dealt to the session's number of shuffle partitions, which
    stay apart however few bytes they have, since the work is what costs.
    """

    def rows_of(key: tuple, table: pa.Table) -> Iterable[tuple]:
        return work(key, table.to_pylist())

    return map_tables(df, keys, schema, rows_of)


def map_tables(df: DataFrame, keys: list[str], schema: str, work: Callable[[tuple, pa.Table], Iterable[tuple]]) -> DataFrame:
    """As ``map_groups``, with a group's rows as an Arrow table."""
    target = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        key = tuple(table.column(k)[0].as_py() for k in keys)
        return table_of(list(work(key, table)), target)

    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.groupBy(*keys).applyInArrow(run, schema)


