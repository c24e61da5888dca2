"""Call expansion, gating, expression trees, connections and numbering, each against a naive recursive walk."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wirespan.functions import running
from wirespan.operators import calls, gating, stamp, trees


def test_before(spark):
    """Sums and last values, with one key that holds most rows and ranges that it spans."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.randrange(5), rng.choice([None, None, rng.randrange(100)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at int, n int, v int").repartition(7)
    got = {r["at"]: (r.total, r.latest) for r in running.before(df, ["key"], ["at"], {"total": F.col("n")}, {"latest": F.col("v")}).collect()}
    total, latest = defaultdict(int), defaultdict(lambda: None)
    for key, at, n, v in rows:
        assert got[at] == (total[key], latest[key])
        total[key] += n
        latest[key] = latest[key] if v is None else v
    assert running.before(df.where("false"), ["key"], ["at"], {"total": F.col("n")}).collect() == []


# --- calls -------------------------------------------------------------------------------------
def expanded_by_hand(roots, bodies, budget):
    out = []
    for module in sorted({r[0] for r in roots}):
        left, n = budget, 0

        def call(callee, stmt, bindable, parent, depth, active):
            nonlocal left, n
            idx, fate = n, "expanded"
            n += 1
            if callee in active:
                fate = "recursive"
            elif left <= 0:
                fate = "cut"
            out.append((module, idx, parent, callee, depth, stmt if bindable else None, fate))
            if fate == "expanded":
                left -= 1
                for _, inner, s, b in sorted(bodies.get(callee, [])):
                    call(inner, s, b, idx, depth + 1, active | {callee})

        for _, _, callee, stmt, bindable in sorted(r for r in roots if r[0] == module):
            call(callee, stmt, bindable, None, 1, frozenset())
    return sorted(out)


@pytest.mark.parametrize("budget", [1, 7, 60, 4000])
def test_calls(spark, budget):
    """Recursion, direct and in circles, branching and bodies without calls."""
    rng = random.Random(budget)
    names = [f"f{k}" for k in range(9)]
    bodies = {f: [(o, rng.choice(names), 100 + o, rng.random() < 0.8) for o in range(rng.randrange(0, 3))] for f in names}
    roots = [(m, o, rng.choice([*names, "nobody"]), o, rng.random() < 0.8) for m in range(4) for o in range(rng.randrange(1, 5))]
    r = spark.createDataFrame(roots, "module_id long, ordinal int, callee string, stmt long, bindable boolean")
    c = spark.createDataFrame([(f, *x) for f, xs in bodies.items() for x in xs], "caller string, ordinal int, callee string, stmt long, bindable boolean")
    expected = expanded_by_hand(roots, bodies, budget)
    sites = calls.expand(r, c, budget)
    assert sorted(map(tuple, sites.collect()), key=lambda x: (x[0], x[1])) == expected
    assert sorted(map(tuple, calls.expand(r.repartition(5), c.repartition(3), budget).collect()), key=lambda x: (x[0], x[1])) == expected
    counted = {x.module_id: (x.sites, x.walked, x.cut) for x in calls.truncated(sites).collect()}
    for m in counted:
        fates = [x[-1] for x in expected if x[0] == m]
        assert counted[m] == (len(fates), fates.count("expanded"), fates.count("cut"))


def test_calls_that_branch_twice_a_level(spark):
    """2 ** 14 paths; just as many bodies as the budget grants."""
    c = spark.createDataFrame([(f"l{k}", o, f"l{k + 1}", o, True) for k in range(14) for o in range(2)], "caller string, ordinal int, callee string, stmt long, bindable boolean")
    r = spark.createDataFrame([(1, 0, "l0", 7, True)], "module_id long, ordinal int, callee string, stmt long, bindable boolean")
    sites = calls.expand(r, c, 100)
    assert sorted(map(tuple, sites.collect()), key=lambda x: x[1]) == expanded_by_hand([(1, 0, "l0", 7, True)], {f"l{k}": [(o, f"l{k + 1}", o, True) for o in range(2)] for k in range(14)}, 100)
    statements = spark.createDataFrame([("l0", 0, "q <= v")], "subroutine string, ordinal int, text string")
    assert [(x.call_site_idx, x.text) for x in calls.body_rows(sites, statements).collect()] == [(0, "q <= v")]
    assert calls.expand(r.where("false"), c).collect() == []


# --- gating ------------------------------------------------------------------------------------
def code(rng, depth, out, state):
    """Writes random constructs and statements into out; state: [position, construct, gates so far, bindable]."""
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["stmt", "stmt", "if", "for", "case", "do"]) if depth < 4 else "stmt"
        if kind == "stmt":
            statement(rng, out, state)
            continue
        out["n"] += 1
        construct, gates, bindable = out["n"], list(state[1]), state[2]
        seen = list(gates)

        def part(role, ordinal, inner_gates, inner_bindable, fill):
            begin, pid = state[0], len(out["parts"]) + 1
            out["parts"].append(None)
            state[0] += 1
            inner = [state[0], inner_gates, inner_bindable]
            fill(inner, pid)
            state[0] = inner[0] + 1
            out["parts"][pid - 1] = (pid, construct, out["body"], role, ordinal, begin, state[0])
            state[0] += rng.randrange(2)

        def condition(ordinal):
            new = []

            def fill(inner, pid):
                for _ in range(rng.randrange(0, 3)):
                    ref = len(out["refs"]) + 1
                    out["refs"].append((ref, pid, 1000 + ref))
                    new.append(ref)
                if rng.random() < 0.3:
                    statement(rng, out, [inner[0], [*seen, *new], False], inner)

            part("condition", ordinal, None, False, fill)
            seen.extend(new)

        body = lambda inner, pid: code(rng, depth + 1, out, inner)
        if kind == "do":
            # The text has the body first; the walk has the condition first, so its reads are known before.
            at = len(out["refs"]) + 1
            count = rng.randrange(0, 3)
            refs = list(range(at, at + count))
            out["refs"] += [None] * count
            part("body", 0, [*gates, *refs], bindable, body)

            def late(inner, pid):
                for x in refs:
                    out["refs"][x - 1] = (x, pid, 1000 + x)

            part("condition", 0, None, False, late)
            continue
        if kind == "for":
            part("initialiser", 0, gates, False, lambda inner, pid: statement(rng, out, inner))
        for k in range(2 if kind == "case" else 1):
            condition(k)
        if kind == "for":
            part("step", 0, list(seen), False, lambda inner, pid: statement(rng, out, inner))
        for _ in range(1 if kind == "for" else 2):
            part("body", 0, list(seen), bindable, body)


def statement(rng, out, state, also=None):
    sid = len(out["stmts"]) + 1
    out["stmts"].append((sid, out["body"], state[0]))
    out["expected"].extend((sid, ref) for ref in state[1])
    out["bindable"][sid] = state[2]
    state[0] += 1
    if also is not None:
        also[0] = state[0]


def test_gating(spark):
    out = {"parts": [], "stmts": [], "refs": [], "expected": [], "bindable": {}, "n": 0, "body": 0}
    rng = random.Random(6)
    for body in range(12):
        out["body"] = body
        code(rng, 0, out, [0, [], True])
    parts = spark.createDataFrame(out["parts"], "part_id long, construct_id long, body_id long, role string, ordinal int, begin long, end long").repartition(4)
    stmts = spark.createDataFrame(out["stmts"], "stmt_id long, body_id long, pos long").repartition(3)
    refs = spark.createDataFrame(out["refs"], "ref_id long, part_id long, net_id long")
    got = gating.gated_by(parts, stmts, refs)
    assert sorted((r.stmt_id, r.expr_ref_id) for r in got.collect()) == sorted(out["expected"])
    assert {r.stmt_id: r.bindable for r in gating.bindable(parts, stmts).collect()} == out["bindable"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert gating.gated_by(parts.where("false"), stmts, refs).collect() == []


# --- expression trees --------------------------------------------------------------------------
class Node:
    def __init__(self, kind, width=None, times=None, below=(), refs=()):
        self.kind, self.given, self.times, self.below, self.refs = kind, width, times, list(below), list(refs)

    @property
    def width(self):
        if self.kind in ("concat", "pattern", "assign"):
            ws = [x.width for x in self.below]
            return sum(ws) if ws and all(ws) else None
        if self.kind == "replicate":
            w = self.below[0].width
            return w * self.times if w else None
        return self.given or None

    def all_refs(self):
        return self.refs + [r for x in self.below for r in x.all_refs()]


def tree(rng, depth, conn, ids):
    kinds = ["reference"] * 3 + (["concat", "concat", "convert", "expression", "pattern"] + (["replicate", "replicate", "constant"] if conn else ["replicate"]) if depth < 5 else [])
    kind = rng.choice(kinds)
    if kind == "reference":
        width = rng.choice([1, 2, 4, 8, None]) if rng.random() < 0.3 else rng.choice([1, 2, 4, 8])
        ids[0] += 1
        net_width = rng.choice([width or 4, 16])
        lo = None if net_width == width and rng.random() < 0.6 else rng.randrange(4)
        hi = None if lo is None else lo + rng.choice([(width or 1), 3]) - 1
        return Node("reference", width, refs=[(ids[0], ids[0] % 7 + 1, lo, hi, int(rng.random() < 0.8), net_width)])
    if kind == "constant":
        return Node("constant", rng.choice([1, 4]))
    if kind == "convert":
        inner = tree(rng, depth + 1, conn, ids)
        return Node("convert", rng.choice([inner.width, inner.width, 2, 16, None]), below=[inner])
    if kind == "expression":
        return Node("expression", rng.choice([1, 8, None]), below=[tree(rng, depth + 1, conn, ids) for _ in range(rng.randrange(0, 3))])
    if kind == "replicate":
        return Node("replicate", None, rng.randrange(1, 4), [tree(rng, depth + 1, conn, ids)])
    return Node(kind, None, below=[tree(rng, depth + 1, conn, ids) for _ in range(rng.randrange(1, 4))])


def flattened(roots):
    nodes, refs, tops, n = [], [], [], [0]

    def put(x, parent, ordinal):
        n[0] += 1
        own = n[0]
        nodes.append((own, parent, ordinal, x.kind, x.given, x.times))
        refs.extend((r[0], own, *r[1:]) for r in x.refs)
        for k, y in enumerate(x.below):
            put(y, own, k)
        return own

    for x in roots:
        tops.append(put(x, None, 0))
    return nodes, refs, tops


NODES = "id long, parent_id long, ordinal int, kind string, width long, times long"
REFS = "id long, node_id long, net_id long, lo long, hi long, exact int, net_width long"


def size(ref):
    return ref[3] - ref[2] + 1 if ref[2] is not None else ref[5]


def slots_by_hand(x, base, out):
    w = x.width
    if x.kind in ("concat", "pattern") and w:
        cursor = base + w
        for y in x.below:
            cursor -= y.width
            slots_by_hand(y, cursor, out)
        return
    if x.kind == "convert" and w and (x.below[0].width or 0) >= w:
        slots_by_hand(x.below[0], base, out)
        return
    refs = x.all_refs()
    exact = x.kind == "reference" and bool(w) and refs[0][4] == 1 and size(refs[0]) == w
    out.extend((r[0], base if w else None, base + w - 1 if w else None, exact) for r in refs)


def segments_by_hand(x, base, lost, out):
    w = x.width
    window = (base, base + w - 1) if w and not lost else (None, None)
    if x.kind in ("concat", "pattern"):
        cursor, bad = base + (w or 0), lost or not w
        for y in x.below:
            bad = bad or not y.width
            if not bad:
                cursor -= y.width
            segments_by_hand(y, 0 if bad else cursor, bad, out)
    elif x.kind == "replicate":
        if lost or not w:
            segments_by_hand(x.below[0], 0, True, out)
        else:
            for k in range(x.times):
                segments_by_hand(x.below[0], base + w - (k + 1) * x.below[0].width, False, out)
    elif x.kind == "convert":
        same = x.below[0].width == w and bool(w)
        segments_by_hand(x.below[0], base if same else 0, lost or not same, out)
    elif x.kind == "reference":
        r = x.refs[0]
        out.append((r[0], *window, False, window[0] is not None and r[4] == 1 and size(r) == w))
    elif x.kind == "expression" and x.all_refs():
        out.append(sorted((r[0], *window, True, False) for r in x.all_refs()))
    else:
        out.append((None, *window, False, False))


def test_slots(spark):
    rng, ids = random.Random(11), [0]
    roots = [tree(rng, 0, False, ids) for _ in range(150)]
    nodes, refs, tops = flattened(roots)
    expected = []
    for x in roots:
        slots_by_hand(x, 0, expected)
    got = trees.slots(spark.createDataFrame(nodes, NODES).repartition(5), spark.createDataFrame(refs, REFS).repartition(3)).collect()
    assert sorted((r.ref_id, r.slot_lo, r.slot_hi, r.positional) for r in got) == sorted(expected)
    assert {r.root_id for r in got} <= set(tops)
    assert any(e[3] for e in expected) and any(e[1] is None for e in expected)


def test_segments(spark):
    rng, ids = random.Random(12), [0]
    roots = [tree(rng, 0, True, ids) for _ in range(150)]
    roots.append(Node("assign", None, below=[Node("reference", 4, refs=[(9001, 3, None, None, 1, 4)]), Node("reference", 4, refs=[(9002, 3, None, None, 1, 4)])]))
    nodes, refs, tops = flattened(roots[:-1])
    more, own, top = flattened(roots[-1:])
    shift = len(nodes)
    nodes += [(a + shift, None if b is None else b + shift, *rest) for a, b, *rest in more]
    refs += [(a, b + shift, *rest) for a, b, *rest in own]
    tops += [top[0] + shift]
    pieces = trees.segments(spark.createDataFrame(nodes, NODES).repartition(5), spark.createDataFrame(refs, REFS).repartition(3)).collect()
    got = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.root_id, r.ordinal)):
        got[r.root_id].append((r.ref_id, r.win_lo, r.win_hi, r.expression, r.positional))
    for x, top in zip(roots, tops, strict=True):
        expected = []
        segments_by_hand(x.below[0] if x.kind == "assign" else x, 0, False, expected)
        mine = got[top]
        for e in expected:
            if isinstance(e, list):  # what computes: in any order
                assert sorted(mine[: len(e)]) == e
                mine = mine[len(e) :]
            else:
                assert mine.pop(0) == e
        assert not mine


def test_segments_of_trees_of_any_size(spark, monkeypatch):
    """Trees walked in a task, by levels for their rows, and by levels for their segments: the same rows. Nodes below a missing one, and circles, give none."""
    rng, ids = random.Random(13), [0]
    nodes, refs, tops = flattened([tree(rng, 0, True, ids) for _ in range(60)])
    n = len(nodes)
    nodes += [(n + 1, n + 9, 0, "reference", 4, None), (n + 2, n + 3, 0, "concat", None, None), (n + 3, n + 2, 0, "concat", None, None)]
    refs += [(9001, n + 1, 3, None, None, 1, 4), (9002, 1, 5, 0, 1, 1, 8), (9003, 1, 6, 0, 1, 1, 8)]
    df, named = spark.createDataFrame(nodes, NODES).repartition(5), spark.createDataFrame(refs, REFS).repartition(3)
    told, widths = [], []
    for largest, most in ((200_000, 1_000_000), (0, 1_000_000), (200_000, 0), (6, 6)):
        monkeypatch.setattr(trees, "LARGEST", largest)
        monkeypatch.setattr(trees, "MOST", most)
        pieces, wide = trees.sized_segments(df, named)
        told.append(sorted(repr(sorted(r.asDict().items())) for r in pieces.collect()))
        widths.append(sorted(map(repr, wide.select("root_id", "width").collect())))
    assert told[0] == told[1] == told[2] == told[3] and len(told[0]) > 100
    assert widths[0] == widths[1] == widths[2] == widths[3] and len(widths[0]) == len(tops)


def test_segments_write_few_tables(spark, monkeypatch):
    """Whole trees are walked in a task: a level is a table on the way down to find the roots, and no more."""
    from wirespan.functions import tables

    made = []
    for module in (trees, running):
        monkeypatch.setattr(module, "written", lambda df, **options: made.append(1) or tables.written(df, **options))
    rng, ids = random.Random(14), [0]
    nodes, refs, _ = flattened([tree(rng, 0, True, ids) for _ in range(60)])
    depth, up = 0, {n[0]: n[1] for n in nodes}
    for i in up:
        k = 0
        while (i := up[i]) is not None:
            k += 1
        depth = max(depth, k)
    assert trees.segments(spark.createDataFrame(nodes, NODES), spark.createDataFrame(refs, REFS)).count() > 100
    assert len(made) <= depth + 8


def test_connections(spark):
    """Kinds, windows and exactness of each shape of actual; arrays and unequal widths lose both."""
    actuals = spark.createDataFrame(
        [(1, 1, False, 10, 8, 0, 8, 8, False), (2, 2, False, 10, 8, 8, 8, 16, False), (3, 3, False, 10, 8, 0, 4, 4, False), (4, 4, False, 10, 8, 0, 8, 8, True), (5, 5, False, None, None, 0, 8, 8, False),
         (6, 6, True, None, None, 0, None, None, False), (7, 7, False, 20, 8, 0, 8, 8, False), (8, 8, False, 30, 4, 0, 4, 4, False), (9, 9, False, 40, 4, 0, 4, 4, False), (10, 10, False, 50, 2, 0, 2, 2, False)],
        "conn_id long, term_id long, interface boolean, root_id long, expr_width long, slot_lsb long, slot_width long, term_width long, in_array boolean")
    pieces = spark.createDataFrame(
        [(10, 0, 1, 5, None, None, 1, 0, 7, False, True), (20, 0, 2, 5, 4, 7, 1, 4, 7, False, True), (20, 1, 3, 6, None, None, 1, 0, 3, False, True), (30, 0, 4, 5, None, None, 1, 0, 3, True, False), (40, 0, None, None, None, None, None, 0, 3, False, False), (50, 0, 6, None, None, None, 1, 0, 1, False, True)],
        "root_id long, ordinal long, ref_id long, net_id long, lo long, hi long, exact int, win_lo long, win_hi long, expression boolean, positional boolean")
    got = [tuple(r)[2:] for r in trees.connections(actuals, pieces).orderBy("conn_id", "ordinal").collect()]
    assert got == [
        (0, "signal", 5, None, None, 1, None, None, 1, 1),
        (0, "signal", 5, None, None, 1, 8, 15, 1, 1),
        (0, "signal", 5, None, None, 1, None, None, 0, 0),
        (0, "signal", 5, None, None, 0, None, None, 0, 0),
        (0, "unconnected", None, None, None, None, None, None, None, None),
        (0, "interface", None, None, None, None, None, None, None, None),
        (0, "signal", 5, 4, 7, 1, 4, 7, 1, 1),
        (1, "signal", 6, None, None, 1, 0, 3, 1, 1),
        (0, "expression_operand", 5, None, None, 1, None, None, 1, 0),
        (0, "constant", None, None, None, None, None, None, 1, None),
        (0, "external_reference", None, None, None, None, None, None, 1, 1),
    ]


def test_elements(spark):
    rows = spark.createDataFrame([(1, 4, 4, 3), (2, 12, 4, 3), (3, 5, 4, 3), (4, 4, 4, 1)], "conn_id long, expr_width long, port_width long, elements long")
    assert sorted(tuple(r) for r in trees.elements(rows).collect() if r.element is not None) == [(1, 0, 0, 3, "shared"), (1, 1, 0, 3, "shared"), (1, 2, 0, 3, "shared"), (2, 0, 8, 11, "dealt"), (2, 1, 4, 7, "dealt"), (2, 2, 0, 3, "dealt"), (4, 0, 0, 3, "shared")]
    assert [tuple(r) for r in trees.elements(rows.where("conn_id = 3")).collect()] == [(3, None, None, None, "mismatch")]


# --- numbering ---------------------------------------------------------------------------------
def reserved_by_hand(rows):
    slot = lambda kind: {"generate": 0, "primitive": 1}.get(kind, 2)
    held = defaultdict(list)
    for i, owner, kind, ordinal in rows:
        held[owner].append((slot(kind), ordinal, i))
    out, n = {}, 0

    def enter(owner):
        nonlocal n
        for _, _, i in sorted(held[owner]):
            n += 1
            out[i] = n
        for s, _, i in sorted(held[owner]):
            if s == 2:
                enter(i)

    for _, _, i in sorted(held[None]):
        n += 1
        out[i] = n
        enter(i)
    return out


def test_reserved(spark):
    rng = random.Random(3)
    rows = [(1, None, "root", 0), (2, None, "root", 1), (3, None, "root", 2)]
    holders = [1, 2]
    for i in range(4, 1200):
        owner = rng.choice([1] * 4 + holders[-200:])  # one parent holds most
        kind = rng.choice(["generate", "primitive", "instance", "instance", "unresolved"])
        rows.append((i, owner, kind, rng.randrange(500)))
        if kind == "instance":
            holders.append(i)
    rng.shuffle(rows)
    got = {r.id: r.node_id for r in stamp.reserved(spark.createDataFrame(rows, "id long, owner long, kind string, ordinal int").repartition(6)).collect()}
    assert got == reserved_by_hand(rows)
    assert sorted(got.values()) == list(range(1, len(rows) + 1))


def test_reserved_under_one_parent(spark):
    """A hundred thousand children of one parent: no task has more than a share of them."""
    n = 100_000
    rows = spark.range(2, n + 2).select("id", F.lit(1).cast("long").alias("owner"), F.lit("unresolved").alias("kind"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("ordinal"))
    rows = rows.unionByName(spark.createDataFrame([(1, None, "root", 0)], "id long, owner long, kind string, ordinal int"))
    got = stamp.reserved(rows)
    assert got.agg(F.count("id"), F.countDistinct("node_id"), F.min("node_id"), F.max("node_id")).first() == (n + 1, n + 1, 1, n + 1)
    first = rows.where("id > 1").orderBy("ordinal", "id").first().id
    assert got.where(F.col("id") == first).first().node_id == 2
