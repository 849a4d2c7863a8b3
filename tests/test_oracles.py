"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from querent.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows_equal_those_of_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == dict(zip(want.columns, map(str, want.types), strict=True))
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_without_the_optional_part():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
