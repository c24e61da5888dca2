"""Template rows from hand-written references."""

from wirespan.operators import extract

REF = "stmt_id long, id long, net_id long, lo long, hi long, exact int, slot_lo long, slot_hi long"


def test_concatenation(spark):
    """{a, b} = {c[7:4], d[3:0]}, both sides a byte of two nibbles; e = constant."""
    t = spark.createDataFrame([(1, 1, 10, None, None, 1, 4, 7), (1, 2, 11, None, None, 1, 0, 3), (2, 3, 12, None, None, 1, 0, 7)], REF)
    s = spark.createDataFrame([(1, 5, 20, 4, 7, 1, 4, 7), (1, 6, 21, 0, 3, 0, 0, 3), (1, 7, 22, None, None, 1, None, None)], REF)
    got = {(r.tgt_net_id, r.src_net_id): (r.tgt_lo, r.tgt_hi, r.src_lo, r.src_hi, r.map_exact) for r in extract.assign_deps(t, s).collect()}
    assert got == {(10, 20): (0, 3, 4, 7, 1), (10, 22): (None, None, None, None, 0), (11, 21): (0, 3, 0, 3, 0), (11, 22): (None, None, None, None, 0), (12, None): (None, None, None, None, None)}


def test_alias_of_three(spark):
    refs = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 5), (2, 0, 6), (2, 1, 9), (3, 0, 4), (3, 1, 4)], "stmt_id long, side int, net_id long")
    rows = extract.alias_deps(refs).collect()
    assert sum(r.stmt_id == 1 and r.map_exact == 1 for r in rows) == 6
    assert {(r.src_net_id, r.tgt_net_id, r.map_exact) for r in rows if r.stmt_id == 2} == {(5, 9, 0), (9, 5, 0), (6, 9, 0), (9, 6, 0)}
    assert not [r for r in rows if r.stmt_id == 3]


def test_primitives(spark):
    pins = spark.createDataFrame([(1, 0, 5, "inout", 1), (1, 1, 6, "inout", 1), (2, 0, 7, "output", 1), (2, 1, 8, "input", 4), (3, 0, 9, "output", 1)], "prim_id long, terminal int, net_id long, direction string, width long")
    got = sorted((r.prim_id, r.src_net_id or 0, r.tgt_net_id, r.map_exact) for r in extract.prim_deps(pins).collect())
    assert got == [(1, 5, 6, 1), (1, 6, 5, 1), (2, 8, 7, 0), (3, 0, 9, None)]


def test_the_rest(spark):
    parts = spark.createDataFrame([(1, 0, 4), (1, 1, 8), (1, 2, 1)], "term_id long, ordinal int, width long")
    assert sorted((r.ordinal, r.lo, r.hi) for r in extract.windows_from_right(parts).collect()) == [(0, 9, 12), (1, 1, 8), (2, 0, 0)]
    seg = spark.createDataFrame([(1, 0, 4, 3)], "id long, lo long, width long, times int").selectExpr("*", "lo + width - 1 as hi")
    assert sorted((r.lo, r.hi) for r in extract.copies(seg).collect()) == [(0, 3), (4, 7), (8, 11)]
    calls = spark.createDataFrame([(1, 5, 6, "input"), (1, 7, 8, "inout"), (1, 9, 10, "output")], "call_site_id long, formal_net_id long, actual_net_id long, direction string")
    assert sorted((r.src_net_id, r.tgt_net_id) for r in extract.call_deps(calls).collect()) == [(6, 5), (7, 8), (8, 7), (9, 10)]
    inst = spark.createDataFrame([(1, "a", "bc", 1, 1, ""), (2, "ab", "c", 1, 1, ""), (3, "a", "bc", 1, 1, None)], "id long, def_name string, file string, line long, col long, params string")
    assert sorted((r.representative, r.occurrences) for r in extract.bodies(inst).collect()) == [(1, 2), (2, 1)]
    df = spark.createDataFrame([("  #  3\n ",), (" ",), (None,)], "d string")
    assert [r[0] for r in df.select(extract.delay(df.d)).collect()] == ["# 3", None, None]
    refs = spark.createDataFrame([(2, 1, "x", "read", None, "w", "h"), (1, 1, "x", "read", "c", "w", "h"), (3, 1, "x", "write", None, None, "h")], "id long, stmt_id long, expression string, access string, canonical string, written string, hierarchical string")
    assert sorted((r.id, r.path) for r in extract.outward(refs).collect()) == [(1, "c"), (3, "h")]
    self = spark.createDataFrame([(1, 1, 10, 0, 3, 1, True), (2, 2, 11, None, None, 1, False)], "stmt_id long, id long, net_id long, lo long, hi long, exact int, compound boolean")
    assert [r.net_id for r in extract.self_reads(self).collect()] == [10]
    kinds = spark.createDataFrame([(True, False, False, False, False), (True, False, False, False, True), (False, True, False, False, False), (False, False, False, True, False), (False,) * 5], "n boolean, r boolean, i boolean, c boolean, e boolean")
    assert [r[0] for r in kinds.select(extract.conn_kind(kinds.n, kinds.r, kinds.i, kinds.c, kinds.e)).collect()] == ["signal", "expression_operand", "external_reference", "constant", "unconnected"]
