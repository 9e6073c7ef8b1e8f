"""Queries that once cut their input: against plain Python over the whole tables."""

import duckdb
import pyarrow.parquet as pq
import pytest

from symgraph.plans import queries_model as qm

DIR = "/root/testdata/sf0.001"
FLAGS = {"reference": 1, "implementation": 2, "type_definition": 4, "definition": 8}


def expected_edges():
    items = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_linenumber"]).to_pylist()
    return {(r["l_orderkey"], r["l_partkey"], kind) for r in items for kind, bit in FLAGS.items() if r["l_linenumber"] & bit}


def test_relationship_edges_are_of_all_rows(spark):
    got = [tuple(r) for r in qm.relationship_edges(spark, DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == {(*e, "scip") for e in expected_edges()}


def test_edge_order_has_all_edges(spark):
    got = [tuple(r) for r in qm.edge_order(spark, DIR).collect()]
    assert got == sorted(expected_edges())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines without an order, a part or a number, and one that repeats."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(11, 5, 3), (11, None, 3), (11, 2, None), (None, 2, 7), (-9, 3, 5), (21, 4, -1), (1, 7, 8), (11, 5, 3), (1, None, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    return path


def whole_sql(path, sql):
    """Rows of the SQL without its two bounds."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return con.execute(sql.replace("l_orderkey % 10 = 1 AND ", "").replace(" WHERE src_symbol < 2000", "")).fetchall()


def test_edges_of_null_keys_are_kept(spark, odd):
    got = [tuple(r) for r in qm.relationship_edges(spark, odd).collect()]
    found = whole_sql(odd, qm.RELATIONSHIP_EDGES)
    assert (11, None, "reference", "scip") in got and sorted(got, key=repr) == sorted(found, key=repr)


def test_null_keys_are_last_in_order(spark, odd):
    got = [tuple(r) for r in qm.edge_order(spark, odd).collect()]
    assert got == whole_sql(odd, qm.EDGE_ORDER)
