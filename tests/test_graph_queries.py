"""Every graph query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphweave import graph_queries, testgraph

ORACLE = graph_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def shown(value):
    if value is None or value != value:
        return "-"
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([shown(r[k]) for k in order] for r in data)


@pytest.mark.parametrize("name", sorted(graph_queries.queries()))
def test_query(spark, sf_dir, duck, name):
    frame = graph_queries.queries()[name](spark, sf_dir)
    found = duck.sql(ORACLE[name])
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(found.columns, found.fetchall())


def test_pushdown_and_pruning(spark, sf_dir):
    gateway = testgraph.build(spark, sf_dir)
    plan = gateway.execute("{ customer(custKey: 5) { name orders { orderKey } } }")["customer"]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and "EqualTo(o_custkey,5)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_joins_are_spared(spark, sf_dir):
    gateway = testgraph.build(spark, sf_dir)
    joins = lambda q: gateway.execute(q, shape="flat").data
    for query in ("{ snapshots { orderKey customer { custKey name } } }", "{ customers { custKey nation { nationKey } } }"):
        text = next(iter(joins(query).values()))._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Join LeftOuter") == 0


def test_two_lists_side_by_side(spark, sf_dir):
    gateway = testgraph.build(spark, sf_dir)
    query = "{ customer(custKey: 5) { orders { orderKey } events { type } } }"
    flat = gateway.execute(query)
    assert flat.data is None and "multiply" in flat.error_rows[0].message
    both = gateway.execute(query, shape="nested").to_dict()["data"]["customer"]
    assert len(both["orders"]) == spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey = 5").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
