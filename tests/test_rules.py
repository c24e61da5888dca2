"""Every rule against a planted fault and a legal row that nearly is one, and against SQL written apart."""

from collections import Counter

import duckdb
import pytest

from tests.test_design import small, small_rows
from wirespan.operators import closure, verify
from wirespan.plans import planted
from wirespan.plans.rules import RULE_SQL
from wirespan.plans.oracle import VIEW_SQL
from wirespan.plans.queries import _NEAREST
from wirespan.sources import schema
from wirespan.sources.design import Design


@pytest.fixture(scope="module")
def broken(spark):
    """A small design and all planted rows; what breaks which rule."""
    good, more = small_rows(), planted.rows()
    design = Design.of(spark, {t: good.get(t, []) + more.get(t, []) for t in schema.TABLES})
    return design, Counter((r.rule, r.what) for r in verify.violations(spark, design).collect())


def test_every_rule_has_sql():
    assert set(verify.RULES) == set(RULE_SQL)
    assert {f"K{n}" for n in range(1, 88)} - set(verify.RULES) == {"K3", "K64", "K86"}  # tested on load, by columns, by rows read


def test_faults_are_found_and_legal_rows_are_not(broken):
    _, found = broken
    for rule, bad, rows in planted.CASES:
        assert ((rule, planted.what(*rows[-1])) in found) == bad, (rule, rows)
    of_rows = {r for r, _, _ in verify.ROW_RULES if r not in {f"K{n}" for n in range(70, 87)}}
    assert of_rows | {"K4", "K78"} == {rule for rule, bad, _ in planted.CASES if bad}
    assert ("K19", "duplicate_path_count") in found


def test_same_as_sql(broken, tmp_path):
    design, found = broken
    con = duckdb.connect()
    for t in schema.TABLES:
        design[t].coalesce(1).write.parquet(f"file://{tmp_path}/{t}")
        con.sql(f"CREATE TABLE {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    for v, sql in VIEW_SQL.items():
        con.sql(f"CREATE VIEW {v} AS {sql}")
    for rule in verify.RULES:
        want = Counter(w for (w,) in con.sql(f"WITH {_NEAREST} SELECT what FROM ({RULE_SQL[rule]})").fetchall())
        assert Counter({w: n for (r, w), n in found.items() if r == rule}) == want, rule


@pytest.fixture(scope="module")
def plain(spark):
    """The rows of the small design's views."""
    from wirespan.operators import views

    made = {name: views.VIEWS[name](small(spark)) for name in {name for name, _ in VIEW_FAULTS.values()}}
    return {name: (df.collect(), df.schema) for name, df in made.items()}


VIEW_FAULTS = {
    "K63": ("v_db_info", "error_count = 9"),
    "K65": ("v_net", lambda v: v.limit(1)), "K67": ("v_driver", lambda v: v.union(v)), "K68": ("v_load", lambda v: v.limit(0)), "K69": ("v_net_attachment", lambda v: v.union(v)),
    "K70": ("v_net_attachment", "attachment_kind = 'odd'"), "K71": ("v_net_attachment", "attachment_kind = 'release_target'"), "K72": ("v_net_attachment", "attachment_kind = 'alias_binding'"), "K73": ("v_net_attachment", "dep_id = 1"), "K74": ("v_net_attachment", "attachment_kind = 'event'"), "K75": ("v_net_attachment", "term_id = 99"),
    "K76": ("v_driver", "driver_kind = 'constant'"), "K77": ("v_driver", "driver_net_id = NULL"), "K79": ("v_driver", "driver_kind = 'external'"), "K80": ("v_driver", "driver_kind = 'system_task'"), "K81": ("v_load", "load_net_id = NULL"),
    "K82": ("v_driver", "driver_kind = 'terminal'"), "K83": ("v_load", "load_kind = 'wait'"), "K84": ("v_load", "load_kind = 'terminal'"), "K85": ("v_load", "load_kind = 'odd'"),
}


@pytest.mark.parametrize("rule", VIEW_FAULTS)
def test_faults_in_views_are_found(spark, monkeypatch, plain, rule):
    """Unchanged views break nothing: test_design."""
    from pyspark.sql import functions as F

    from wirespan.operators import views

    name, change = VIEW_FAULTS[rule]
    if isinstance(change, str):
        column, value = change.split(" = ")
        change = lambda v: v.withColumn(column, F.expr(value).cast(v.schema[column].dataType))
    for view, (rows, columns) in plain.items():
        df = spark.createDataFrame(rows, columns)
        monkeypatch.setitem(views.VIEWS, view, lambda t, df=df, own=view == name: change(df) if own else df)
    assert not verify.violations(spark, small(spark), [rule]).isEmpty()


def test_a_crossing_that_is_lost_is_told(spark, monkeypatch):
    from wirespan.operators import views

    whole = views.conn_arc
    assert verify.violations(spark, small(spark), ["K66"]).isEmpty()
    monkeypatch.setattr(views, "conn_arc", lambda t: whole(t).limit(1))
    assert [r.rule for r in verify.violations(spark, small(spark), ["K66"]).collect()] == ["K66"]


@pytest.mark.parametrize(("key", "value", "rules"), [("error_count", "3", ["K62"]), ("tool", None, ["K62"]), ("unresolved_count", "x", ["K62"]), ("analysis_status", "done", ["K62"]), ("schema_version", "13", ["K62"])])
def test_meta(spark, key, value, rules):
    bad = small(spark, meta=[(k, value if k == key else v) for k, v in small_rows()["meta"]])
    assert sorted({r.rule for r in verify.violations(spark, bad, ["K62", "K63"]).collect()}) == rules


def test_empty_tables_are_told(spark):
    found = {(r.rule, r.what) for r in verify.violations(spark, Design.of(spark, {}), ["K1", "K2"]).collect()}
    assert found == {("K1", t) for t in verify.FILLED} | {("K2", "none")}


def test_a_cycle_of_parents_ends(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5)], "id long, parent long")
    got = {r.node: r.ancestor for r in closure.nearest(tree, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}
