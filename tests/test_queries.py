import duckdb
import pytest

from quire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    answer = duck.sql(catalog.ORACLES[name])
    assert sorted(answer.columns) == columns
    assert plain(map(tuple, df.select(columns).collect())) == plain(answer.select(*[f'"{c}"' for c in columns]).fetchall())
