"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from evalspark.plans.oracles import ORACLES
from evalspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
        return repr(v)

    return sorted(tuple(value(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    have = plain(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    result = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({entry.oracle_sql()[name]})")
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert have == plain(result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
