"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from contrail.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

registry.load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0 if value else 0.0)
    return str(value)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == sorted(tuple(text(row[i]) for i in order) for row in result.fetchall())
