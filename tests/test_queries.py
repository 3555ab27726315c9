"""Every registered query outside llm against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from evidra.jobs.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA

D = f"{DATA}/sf0.001"


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    got = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    c.execute(ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(x)] for x in columns) for r in c.fetchall()]
    assert rows(got) == rows(want)


def test_traced_schemas_of_suppliers_take_the_first_of_several_sources(spark, tmp_path):
    """P5 is reached in Brand#12, at once, and in Brand#1/shared, by four other parts; the SQL takes the latter."""
    c = duckdb.connect()
    parts = "(5, 'Brand#12', 5), (10, 'Brand#12', 1), (17, 'Brand#11', 1), (8, 'Brand#11', 1), (4, 'Brand#11', 1), (11, 'Brand#11', 1)"
    for name, values in (("part(p_partkey, p_brand, p_size)", parts), ("supplier(s_suppkey)", "(10)")):
        c.execute(f"CREATE VIEW {name} AS VALUES {values}")
        table = name.partition("(")[0]
        c.execute(f"COPY (FROM {table}) TO '{tmp_path}/{table}.parquet'")
    got = QUERIES["traced_schemas_of_suppliers"](spark, str(tmp_path))
    c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['traced_schemas_of_suppliers']})")
    want = c.fetchall()
    assert (10, "P5", "transitive:P10", "Brand#1/shared", True) in want
    assert rows(map(tuple, got.collect())) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
