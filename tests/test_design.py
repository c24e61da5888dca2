"""Small designs written by hand, rules that fire on planted faults, and the operators on their own."""

import random

import pytest

from wirespan.functions import ranges
from wirespan.operators import closure, coverage, resolve, stamp, verify, views
from wirespan.plans import planted
from wirespan.sources.design import Design, VersionError


def row(table, **values):
    return planted.filled(table, values)


def small_rows():
    """Two instances of one module under a root: u1 drives bus, u2 reads half of it."""
    return {
        "meta": [("schema_version", "14"), ("analysis_status", "complete"), ("tool", "t"), ("tool_version", "1"), ("slang_version", "1"), ("producer_revision", "r"), ("top", "top"), ("error_count", "0"), ("unresolved_count", "0"), ("empty_procedure_count", "0"), ("config_digest", "d"), ("duplicate_path_count", "0")],
        "src_file": [(1, "/a.sv", "0" * 64)], "file": [(1, "a.sv", 1)], "data_type": [(1, "logic [7:0]")], "module": [row("module", id=1, name="top", def_kind="module"), row("module", id=2, name="m", def_kind="module")],
        "tree_node": [(1, None, "top", "root", 0), (2, 1, "u1", "instance", 0), (3, 1, "u2", "instance", 1)],
        "inst": [row("inst", id=1, module_id=1), row("inst", id=2, module_id=2, parent_inst_id=1), row("inst", id=3, module_id=2, parent_inst_id=1)],
        "net": [row("net", id=n, inst_id=i, scope_node_id=i, name=s, decl_kind="wire", width=8, data_type_id=1, is_implicit=0) for n, i, s in ((1, 1, "bus"), (2, 2, "q"), (3, 3, "d"), (4, 3, "r"))],
        "term": [row("term", id=1, inst_id=2, name="q", term_kind="signal", direction="output", width=8), row("term", id=2, inst_id=3, name="d", term_kind="signal", direction="input", width=8)],
        "term_map": [row("term_map", term_id=1, inner_net_id=2), row("term_map", term_id=2, inner_net_id=3)],
        "net_conn": [row("net_conn", id=1, term_id=1, outer_net_id=1, conn_kind="signal", outer_exact=1, term_exact=1, map_exact=1), row("net_conn", id=2, term_id=2, outer_net_id=1, conn_kind="signal", outer_lo=4, outer_hi=7, outer_exact=1, term_lo=0, term_hi=3, term_exact=1, map_exact=1)],
        "stmt": [row("stmt", id=1, inst_id=3, scope_node_id=3, stmt_kind="assignment", assign_kind="continuous")],
        "stmt_target": [row("stmt_target", id=1, stmt_id=1, net_id=4)], "assign_operand": [row("assign_operand", id=1, stmt_id=1, net_id=3)],
        "net_dep": [row("net_dep", id=1, src_net_id=3, tgt_net_id=4, stmt_id=1, assign_operand_id=1, stmt_target_id=1, dep_kind="data", src_exact=1, map_exact=1)],
    }


def small(spark, **more):
    return Design.of(spark, small_rows() | more)


def test_drivers_and_loads(spark):
    d = small(spark)
    got = {(r.signal_name, r.driver_name, r.driver_kind, r.signal_lo, r.signal_hi, r.driver_lo, r.driver_hi) for r in views.driver(d).collect()}
    assert got == {("r", "d", "data", None, None, None, None), ("bus", "q", "connection", None, None, None, None), ("d", "bus", "connection", 0, 3, 4, 7)}
    loads = {(r.signal_name, r.load_name, r.load_kind) for r in views.load(d).collect()}
    assert loads == {("d", "r", "dataflow"), ("bus", "d", "connection"), ("q", "bus", "connection")}
    assert views.db_info(d).first().unresolved_count == 0 and verify.top_is(d, "top") and not verify.top_is(d, "other")
    cone = closure.reached(closure.fan_in_edges(d), spark.createDataFrame([(4, 4)], "seed long, node long"))
    assert sorted((r.node, r.depth) for r in cone.collect()) == [(1, 2), (2, 3), (3, 1), (4, 0)]
    assert sorted(r.net_name for r in coverage.undriven(d).collect()) == ["q"]
    assert verify.violations(spark, d).collect() == []
    assert verify.view_columns(d) == {}


def test_version(spark, tmp_path):
    small(spark, meta=[("schema_version", "13")]).save(f"file://{tmp_path}/d")
    with pytest.raises(VersionError):
        Design.load(spark, f"file://{tmp_path}/d")


def test_windows_against_bits(spark):
    """overlap() and common() against sets of bits, null ends being open."""
    rng, rows = random.Random(1), []
    for _ in range(300):
        a, b = sorted((rng.randrange(12), rng.randrange(12))), sorted((rng.randrange(12), rng.randrange(12)))
        rows.append((*(a if rng.random() < 0.8 else (None, None)), *(b if rng.random() < 0.8 else (None, None))))
    df = spark.createDataFrame(rows, "al long, ah long, bl long, bh long")
    c = [df[x] for x in ("al", "ah", "bl", "bh")]
    lo, hi = ranges.common(*c)
    for r in df.select("*", ranges.overlap(*c).alias("o"), lo.alias("lo"), hi.alias("hi")).collect():
        bits = lambda x, y: set(range(12)) if x is None else set(range(x, y + 1))
        both = bits(r.al, r.ah) & bits(r.bl, r.bh)
        assert r.o == bool(both)
        if both and (r.lo is not None):
            assert set(range(r.lo, r.hi + 1)) == both


def test_cycles_and_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (4, None), (1, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1), (5, 5)], "seed long, node long")
    assert sorted((r.seed, r.node, r.depth) for r in closure.reached(edges, seeds).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (5, 6, 1)]
    assert closure.reached(edges, seeds, max_rounds=1).count() == 4
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert closure.reached(chain, spark.createDataFrame([(0, 0)], "seed long, node long")).count() == 41


def test_stamping(spark):
    tree = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0)], "id long, parent long, ordinal long")
    keys = stamp.path_keys(tree)
    assert [r.id for r in keys.orderBy("path_key").collect()] == [1, 3, 4, 2]
    occ = keys.selectExpr("id as occ", "path_key", "if(level = 0, 'top', 'm') as group_key", "if(level = 0, 1L, 2L) as n")
    template = spark.createDataFrame([("top", 0, None), ("m", 0, None), ("m", 1, 0)], "group_key string, idx long, prior long")
    got = stamp.replay(stamp.bases(occ, ["path_key"], ["n"]), template, "base_n", {"prior": "base_n"})
    assert sorted((r.id, r.occ, r.prior) for r in got.collect()) == [(1, 1, None), (2, 3, None), (3, 3, 2), (4, 4, None), (5, 4, 4), (6, 2, None), (7, 2, 6)]


def test_paths(spark):
    df = spark.createDataFrame([(r" top . u1 /* x */ .q[3][7:0]",), (r"\a.b .c",)], "path string")
    assert [r[0] for r in df.select(resolve.normal_path(df.path)).collect()][0] == "top.u1.q"
    assert df.select(resolve.segments(df.path)).collect()[1][0] == [r"\a.b", "c"]
    shapes = {"a.b[c[d[e[0]]]]": "a.b", "a[b[c[d[e[f[0]]]]]][1][2]": "a", "a[i].b": "a[i].b", "a[0]]": "a[0]]", "[3]": "[3]", "x]": "x]", "a[b": "a[b", "a /* never": "", "a // to the end\n.b[1]": "a.b", "a/*//*/[2]": "a", "": ""}
    made = spark.createDataFrame([(k,) for k in shapes], "path string")
    assert {r.path: r.normal for r in made.select("path", resolve.normal_path(made.path).alias("normal")).collect()} == shapes
    d = small(spark)
    refs = spark.createDataFrame([(1, 3, "top.u1.q"), (2, 3, "d"), (3, 3, "top.none.q"), (4, 1, "u2.r [1]"), (5, 1, "")], "id long, inst_id long, path string")
    got = {r.id: (r.resolved_inst_id, r.resolved_net_id) for r in resolve.references(refs, d).collect()}
    assert got == {1: (2, 2), 2: (3, 3), 3: (None, None), 4: (3, 4), 5: (None, None)}


def test_new_files_are_a_new_design(spark, tmp_path):
    import os
    import shutil

    sf = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", sf, ignore=lambda d, names: [n for n in names if n.split(".")[0] not in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")])
    os.chmod(sf, 0o755)
    of = lambda: Design.of_star(spark, f"file://{sf}", keep=True)["src_file"].count()
    assert of() == of() == 4
    spark.read.parquet(f"file://{sf}/region.parquet").where("r_regionkey < 2").toPandas().to_parquet(tmp_path / "new.parquet")
    os.replace(tmp_path / "new.parquet", sf / "region.parquet")
    assert of() == 2
