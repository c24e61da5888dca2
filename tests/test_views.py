"""The queries over the star tables against DuckDB, the contract of the views, and what reaches the scans."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from wirespan.operators import views
from wirespan.plans import queries as plans
from wirespan.sources import schema
from wirespan.sources.design import Design

SF = "/root/testdata/sf0.001"
LLM = re.compile(r"op\d+_|pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([r[k] for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df, want = plans.QUERIES[name](spark, SF), duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_cross_deps_of_references_with_one_id(spark, tmp_path):
    """Orders 1953125 apart: the ids of a reference that is resolved and of one that is not meet."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        more = {"orders": "o_orderkey + 1953125 AS o_orderkey", "lineitem": "l_orderkey + 1953125 AS l_orderkey, l_quantity + 13 AS l_quantity"}.get(t)
        con.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{f" UNION ALL SELECT * REPLACE ({more}) FROM '{SF}/{t}.parquet'" if more else ""}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df, want = plans.QUERIES["cross_deps"](spark, str(tmp_path)), con.sql(plans.SQL["cross_deps"])
    expected = want.fetchall()
    assert len({r[0] for r in expected if r[0]}) < len([r for r in expected if r[0]])
    assert rows(df.columns, df.collect()) == rows(want.columns, expected)


def test_columns_in_order(spark):
    design = Design.of_star(spark, SF)
    for name, view in views.VIEWS.items():
        assert view(design).columns == schema.VIEWS[name]


def test_every_query_has_an_entry():
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert {n for n in __spark_entry__.queries() if not LLM.match(n)} == {n for n in __spark_entry__.oracle_sql() if not LLM.match(n)}


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('design')}/d"
    Design.of_star(spark, SF).save(path)
    return path


def test_save_and_load(spark, saved):
    star, design = Design.of_star(spark, SF), Design.load(spark, saved)
    for name in schema.TABLES:
        assert design[name].schema.names == schema.TABLES[name].names
        assert design[name].exceptAll(star[name].select(*schema.TABLES[name].names)).isEmpty()
    assert os.listdir(f"{saved.removeprefix('file://')}/published") and len(os.listdir(f"{saved.removeprefix('file://')}/versions")) == 1


def test_filters_reach_every_branch(spark, saved):
    """A filter on a net is pushed into a scan in each branch of the composite views."""
    design = Design.load(spark, saved)
    for view, column, branches in ((views.driver, "signal_net_id", 5), (views.load, "signal_net_id", 8), (views.net_attachment, "net_id", 10), (views.net_dep, "tgt_net_id", 1), (views.net_conn, "outer_net_id", 1)):
        plan = view(design).where(f"{column} = 20000001")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(\w+,20000001\)", plan)) >= branches, view


def test_edges_join_no_names_statements_or_files(spark, saved):
    from wirespan.operators import closure

    design = Design.load(spark, saved)
    for edges in (closure.fan_in_edges, closure.fan_out_edges):
        plan = edges(design)._jdf.queryExecution().executedPlan().toString()
        read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        assert read and not [r for r in read if re.search(r"\b(name|path|stmt_kind|file_id|line):", r)]
        assert len(read) <= 8
