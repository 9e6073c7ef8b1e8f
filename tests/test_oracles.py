"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from symgraph.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL reads a part of lineitem; test_whole_tables.py holds these two against plain Python.
PARTIAL = {"relationship_edges", "edge_order"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET lambda_syntax = 'ENABLE_SINGLE_ARROW'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v if isinstance(v, (int, str, type(None))) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, con, name):
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    if name not in PARTIAL:
        assert sorted(map(plain, df.select(*columns).collect()), key=repr) == sorted(map(plain, found.fetchall()), key=repr)
