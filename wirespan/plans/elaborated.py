"""Queries of the operators that take staging rows: calls, gating, expression trees, connections, numbering, closures of all call
sites, digests. The rows come from the star tables; each staging table is one SELECT that Spark and DuckDB read alike, {x} naming another. The SQL
of the results is written apart: recursion over whole trees and joins on ranges, where the operators go by levels and sweeps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions.tables import written
from wirespan.operators import calls, closure, gating, stamp, trees
from wirespan.plans.oracle import over_star
from wirespan.sources import integrity, schema, star
from wirespan.sources.design import Design

BUDGET = 50

STAGE = {
    # Suppliers are subroutines that call others, one in five itself, some in circles; each is called once by the module of its nation.
    "calls": """
SELECT concat('f', CAST(s_suppkey AS STRING)) AS caller, CAST(0 AS BIGINT) AS ordinal, concat('f', CAST(CAST((s_suppkey - s_suppkey % 2) / 2 AS BIGINT) AS STRING)) AS callee, s_suppkey * 10 AS stmt, s_suppkey % 4 > 0 AS bindable FROM {supplier} WHERE s_suppkey > 1
UNION ALL SELECT concat('f', CAST(s_suppkey AS STRING)), CAST(1 AS BIGINT), concat('f', CAST((s_suppkey * 7 + 3) % 13 AS STRING)), s_suppkey * 10 + 1, s_suppkey % 2 = 0 FROM {supplier} WHERE s_suppkey % 3 = 0
UNION ALL SELECT concat('f', CAST(s_suppkey AS STRING)), CAST(2 AS BIGINT), concat('f', CAST(s_suppkey AS STRING)), s_suppkey * 10 + 2, true FROM {supplier} WHERE s_suppkey % 5 = 0""",
    "call_roots": "SELECT CAST(1 + s_nationkey AS BIGINT) AS module_id, s_suppkey AS ordinal, concat('f', CAST(s_suppkey AS STRING)) AS callee, s_suppkey * 10 + 5 AS stmt, s_suppkey % 7 > 0 AS bindable FROM {supplier}",
    # A customer's orders, in their order, are statements; two, four and eight of them stand in constructs of four shapes.
    "spots": "SELECT o_custkey AS ck, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM {orders}",
    "widths3": "SELECT 1 AS lv, 2 AS w UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 8",
    "blocks": "SELECT DISTINCT ck, lv, w, CAST((k - k % w) / w AS BIGINT) AS b FROM {spots} x CROSS JOIN {widths3} y",
    "shapes": """
SELECT ck, (ck * 4 + lv) * 1000000 + b AS cid, (ck + lv + b) % 4 AS shape, 1000 * b * w + 100 * (4 - lv) AS b0, 1000 * (b + 1) * w - 100 * (4 - lv) AS e0, CAST(1000 * (b * w + w / 2) AS BIGINT) AS mid FROM {blocks} x""",
    "parts": """
SELECT cid * 10 + 1 AS part_id, cid AS construct_id, ck AS body_id, 'condition' AS role, 0 AS ordinal, b0 + 20 AS b0, b0 + 50 AS e0 FROM {shapes} x WHERE shape IN (0, 1, 3)
UNION ALL SELECT cid * 10 + 2, cid, ck, 'initialiser', 0, b0, b0 + 20 FROM {shapes} x WHERE shape = 1
UNION ALL SELECT cid * 10 + 3, cid, ck, 'step', 0, b0 + 50, b0 + 60 FROM {shapes} x WHERE shape = 1
UNION ALL SELECT cid * 10 + 4, cid, ck, 'body', 0, b0 + 60, e0 FROM {shapes} x WHERE shape IN (0, 1)
UNION ALL SELECT cid * 10 + 4, cid, ck, 'body', 0, b0 + 60, e0 - 60 FROM {shapes} x WHERE shape = 2
UNION ALL SELECT cid * 10 + 1, cid, ck, 'condition', 0, e0 - 50, e0 FROM {shapes} x WHERE shape = 2
UNION ALL SELECT cid * 10 + 4, cid, ck, 'body', 0, b0 + 60, mid + 5 FROM {shapes} x WHERE shape = 3
UNION ALL SELECT cid * 10 + 5, cid, ck, 'condition', 1, mid + 10, mid + 40 FROM {shapes} x WHERE shape = 3
UNION ALL SELECT cid * 10 + 6, cid, ck, 'body', 1, mid + 50, e0 FROM {shapes} x WHERE shape = 3""",
    "gate_stmts": """
SELECT ok * 10 AS stmt_id, ck AS body_id, 1000 * k + 500 AS pos FROM {spots} x
UNION ALL SELECT cid * 10 + 7, ck, b0 + 10 FROM {shapes} x WHERE shape = 1 UNION ALL SELECT cid * 10 + 8, ck, b0 + 55 FROM {shapes} x WHERE shape = 1
UNION ALL SELECT cid * 10 + 9, ck, mid + 20 FROM {shapes} x WHERE shape = 3 UNION ALL SELECT cid * 10 + 3, ck, e0 - 20 FROM {shapes} x WHERE shape = 2""",
    "gate_refs": "SELECT part_id + 100 AS ref_id, part_id, 30000000 + body_id AS net_id FROM {parts} x WHERE role = 'condition'",
    # An order is a concat of its lines, of six shapes, the deepest five levels below it.
    "exprs": """
SELECT -l_orderkey AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS ordinal, 'concat' AS kind, CAST(NULL AS BIGINT) AS width, CAST(NULL AS BIGINT) AS times FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) x
UNION ALL SELECT lid * 16, -ok, lid, CASE (ln + ok) % 6 WHEN 0 THEN 'reference' WHEN 1 THEN 'convert' WHEN 2 THEN 'concat' WHEN 3 THEN 'replicate' WHEN 4 THEN 'expression' ELSE 'pattern' END,
  CASE (ln + ok) % 6 WHEN 0 THEN CASE WHEN pk % 40 <> 0 THEN 1 + qty % 8 END WHEN 1 THEN CASE WHEN qty % 3 = 0 THEN 16 WHEN qty % 3 = 1 THEN 1 + qty % 8 ELSE 1 END WHEN 4 THEN 1 + pk % 2 * 7 END, CASE (ln + ok) % 6 WHEN 3 THEN 1 + qty % 3 END FROM {lines} x
UNION ALL SELECT lid * 16 + 1, lid * 16, CAST(0 AS BIGINT), 'reference', 1 + qty % 8, NULL FROM {lines} x WHERE (ln + ok) % 6 IN (1, 2, 3, 4)
UNION ALL SELECT lid * 16 + 2, lid * 16, CAST(1 AS BIGINT), 'reference', 1 + pk % 4, NULL FROM {lines} x WHERE (ln + ok) % 6 IN (2, 4)
UNION ALL SELECT lid * 16 + 3, lid * 16, CAST(0 AS BIGINT), 'convert', 4 + qty % 2 * 4, NULL FROM {lines} x WHERE (ln + ok) % 6 = 5
UNION ALL SELECT lid * 16 + 4, lid * 16, CAST(1 AS BIGINT), 'constant', 1 + qty % 5, NULL FROM {lines} x WHERE (ln + ok) % 6 = 5
UNION ALL SELECT lid * 16 + 5, lid * 16 + 3, CAST(0 AS BIGINT), 'concat', NULL, NULL FROM {lines} x WHERE (ln + ok) % 6 = 5
UNION ALL SELECT lid * 16 + 6, lid * 16 + 5, CAST(0 AS BIGINT), 'replicate', NULL, CAST(2 AS BIGINT) FROM {lines} x WHERE (ln + ok) % 6 = 5
UNION ALL SELECT lid * 16 + 7, lid * 16 + 5, CAST(1 AS BIGINT), 'reference', 2 + pk % 2 * 2, NULL FROM {lines} x WHERE (ln + ok) % 6 = 5
UNION ALL SELECT lid * 16 + 8, lid * 16 + 6, CAST(0 AS BIGINT), 'reference', CAST(2 AS BIGINT), NULL FROM {lines} x WHERE (ln + ok) % 6 = 5""",
    "expr_reads": """
SELECT e.id + 1000000 AS id, e.id AS node_id, CASE WHEN e.id % 7 > 0 THEN 10000000 + e.id % 1000 END AS net_id, CASE WHEN e.id % 3 = 1 THEN CAST(0 AS BIGINT) END AS lo, CASE WHEN e.id % 3 = 1 THEN coalesce(width, 3) - 1 END AS hi, CASE WHEN e.id % 11 = 3 THEN 0 ELSE 1 END AS exact, CASE WHEN e.id % 5 = 2 THEN 32 ELSE width END AS net_width
FROM {exprs} e WHERE kind = 'reference'""",
    # An order's expression is tied to a port of its customer.
    "ports": """
SELECT o_orderkey AS conn_id, o_custkey AS term_id, o_orderkey % 11 = 0 AS interface, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 9 <> 0 THEN -o_orderkey END AS root_id, o_orderkey % 4 = 3 AS off, CASE WHEN o_orderkey % 3 = 0 THEN CAST(8 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS slot_lsb, o_orderkey % 5 = 0 AS in_array FROM {orders}""",
    "array_actuals": "SELECT l_orderkey * 8 + l_linenumber AS conn_id, CAST(l_quantity AS BIGINT) AS expr_width, CAST(1 + l_linenumber % 5 AS BIGINT) AS port_width, CAST(1 + l_suppkey % 7 AS BIGINT) AS elements FROM {lineitem}",
    # The hierarchy by occurrence: what each instance holds, its generate scopes' contents included.
    "held": """
SELECT t.id, CASE WHEN t.node_kind = 'generate' THEN t.parent_node_id ELSE coalesce(i.parent_inst_id, p.inst_id) END AS owner, t.node_kind AS kind, t.ordinal
FROM {tree_node} t LEFT JOIN {inst} i ON i.id = t.id LEFT JOIN {prim} p ON p.id = t.id WHERE t.node_kind <> 'package'""",
}


def staged(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A staging table over the star tables of a folder. given: tables that are made already, by name."""
    if given and name in given:
        return given[name]
    if name in STAGE or name in star.SQL:
        if name in schema.TABLES:
            return Design.of_star(spark, sf_dir, keep=True)[name]
        sql = STAGE.get(name) or star.SQL[name]
        return spark.sql(sql, **{x: staged(spark, sf_dir, x, given) for x in set(re.findall(r"\{(\w+)\}", sql))})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_stage(select: str, *names: str, views: tuple[str, ...] = ()) -> str:
    """A query for DuckDB with the staging tables it names, and those below them, as CTEs before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in re.findall(r"\{(\w+)\}", STAGE[name]):
            if x in STAGE:
                add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', STAGE[n])})" for n in order]
    return over_star("+" + ",\n".join([*ctes, select.lstrip().removeprefix("+")]) if select.startswith("+") else "+" + ",\n".join(ctes) + "\n" + select, *views).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# --- calls -------------------------------------------------------------------------------------
def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.expand(staged(spark, sf_dir, "call_roots"), staged(spark, sf_dir, "calls"), BUDGET)


_WALK = f"""+walk AS (
  SELECT module_id, [ordinal] AS path, CAST([] AS VARCHAR[]) AS active, callee AS subroutine, if(bindable, stmt, NULL) AS stmt FROM call_roots
  UNION ALL SELECT w.module_id, list_append(w.path, c.ordinal), list_append(w.active, w.subroutine), c.callee, if(c.bindable, c.stmt, NULL) FROM walk w JOIN calls c ON c.caller = w.subroutine WHERE NOT list_contains(w.active, w.subroutine)),
granted AS (SELECT module_id, path FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY path) AS k FROM walk WHERE NOT list_contains(active, subroutine)) WHERE k <= {BUDGET}),
visited AS (SELECT w.*, g.path IS NOT NULL AS walked FROM walk w LEFT JOIN granted g ON g.module_id = w.module_id AND g.path = w.path WHERE len(w.path) = 1 OR (w.module_id, w.path[1 : len(w.path) - 1]) IN (SELECT (module_id, path) FROM granted)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY path) - 1 AS idx FROM visited),
sites AS (SELECT n.module_id, n.idx, p.idx AS parent_idx, n.subroutine, CAST(len(n.path) AS BIGINT) AS depth, n.stmt, CASE WHEN n.walked THEN 'expanded' WHEN list_contains(n.active, n.subroutine) THEN 'recursive' ELSE 'cut' END AS fate
  FROM numbered n LEFT JOIN numbered p ON len(n.path) > 1 AND p.module_id = n.module_id AND p.path = n.path[1 : len(n.path) - 1])
"""
QUERIES["call_expansion"] = _sites
SQL["call_expansion"] = over_stage(_WALK + "SELECT * FROM sites", "call_roots", "calls")
QUERIES["call_budget"] = lambda spark, sf_dir: calls.truncated(_sites(spark, sf_dir))
SQL["call_budget"] = over_stage(_WALK + "SELECT module_id, count(*) AS sites, count(*) FILTER (WHERE fate = 'expanded') AS walked, count(*) FILTER (WHERE fate = 'cut') AS cut FROM sites GROUP BY module_id", "call_roots", "calls")


# --- gating ------------------------------------------------------------------------------------
def _gating(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = staged(spark, sf_dir, "parts").withColumnsRenamed({"b0": "begin", "e0": "end"})
    return parts, staged(spark, sf_dir, "gate_stmts"), staged(spark, sf_dir, "gate_refs")


QUERIES["gated_by"] = lambda spark, sf_dir: gating.gated_by(*_gating(spark, sf_dir))
_AROUND = "+held_in AS (SELECT s.stmt_id, p.*, row_number() OVER (PARTITION BY s.stmt_id ORDER BY p.b0, p.e0 DESC) AS level FROM gate_stmts s JOIN parts p ON p.body_id = s.body_id AND p.b0 <= s.pos AND s.pos < p.e0) "
SQL["gated_by"] = over_stage(_AROUND + "SELECT h.stmt_id, r.ref_id AS expr_ref_id, r.net_id, h.construct_id, h.level FROM held_in h JOIN parts c ON c.construct_id = h.construct_id AND c.role = 'condition' JOIN gate_refs r ON r.part_id = c.part_id WHERE h.role IN ('body', 'step') OR (h.role = 'condition' AND c.ordinal <= h.ordinal)", "parts", "gate_stmts", "gate_refs")
QUERIES["call_bindable"] = lambda spark, sf_dir: gating.bindable(*_gating(spark, sf_dir)[:2])
SQL["call_bindable"] = over_stage(_AROUND + "SELECT s.stmt_id, count(h.stmt_id) = 0 AS bindable FROM gate_stmts s LEFT JOIN held_in h ON h.stmt_id = s.stmt_id AND h.role <> 'body' GROUP BY s.stmt_id", "parts", "gate_stmts")

# --- expression trees --------------------------------------------------------------------------
# A width as what the leaves below add up to, each as often as the replications on the way to it say.
_SIZED = """+below AS (
  SELECT id AS top, id, kind, width, times, 1 AS m FROM exprs
  UNION ALL SELECT b.top, c.id, c.kind, c.width, c.times, b.m * if(b.kind = 'replicate', b.times, 1) FROM below b JOIN exprs c ON c.parent_id = b.id WHERE b.kind IN ('concat', 'pattern', 'replicate')),
totals AS (SELECT top, CASE WHEN bool_and(width IS NOT NULL) THEN CAST(sum(m * width) AS BIGINT) END AS total FROM below WHERE kind NOT IN ('concat', 'pattern', 'replicate') GROUP BY top),
sized AS (SELECT e.id, e.parent_id, e.kind, t.total AS width, e.times, row_number() OVER w - 1 AS nth, coalesce(sum(t.total) OVER w2, 0) AS elder, coalesce(bool_and(t.total IS NOT NULL) OVER w, true) AS known
  FROM exprs e JOIN totals t ON t.top = e.id WINDOW w AS (PARTITION BY parent_id ORDER BY ordinal, id), w2 AS (PARTITION BY parent_id ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
"""
_SLOTS = _SIZED + """walk AS (
  SELECT id AS root_id, id, kind, width, CAST(0 AS BIGINT) AS base, true AS open, CAST(NULL AS BIGINT) AS in_lo, CAST(NULL AS BIGINT) AS in_hi FROM sized WHERE parent_id IS NULL
  UNION ALL SELECT root_id, id, kind, width, if(through, CAST(if(p_kind = 'convert', base, base + p_width - elder - width) AS BIGINT), NULL), through, if(through, NULL, if(open, if(p_width IS NULL, NULL, base), in_lo)), if(through, NULL, if(open, base + p_width - 1, in_hi))
  FROM (SELECT w.root_id, c.id, c.kind, c.width, c.elder, w.base, w.open, w.in_lo, w.in_hi, w.kind AS p_kind, w.width AS p_width,
               w.open AND coalesce((w.kind IN ('concat', 'pattern') AND w.width IS NOT NULL) OR (w.kind = 'convert' AND c.width >= w.width), false) AS through FROM walk w JOIN sized c ON c.parent_id = w.id))
SELECT root_id, r.id AS ref_id, net_id, lo, hi, exact, if(open AND width IS NOT NULL, base, in_lo) AS slot_lo, if(open AND width IS NOT NULL, base + width - 1, in_hi) AS slot_hi,
       coalesce(open AND exact = 1 AND coalesce(hi - lo + 1, net_width) = width, false) AS positional
FROM walk w JOIN expr_reads r ON r.node_id = w.id"""
QUERIES["expr_slots"] = lambda spark, sf_dir: trees.slots(staged(spark, sf_dir, "exprs"), staged(spark, sf_dir, "expr_reads"))
SQL["expr_slots"] = over_stage(_SLOTS, "exprs", "expr_reads")
_SEGMENTS = _SIZED + """times4 AS (SELECT unnest([0, 1, 2, 3]) AS copy),
walk AS (
  SELECT id AS root_id, id, kind, width, times, CAST(0 AS BIGINT) AS base, false AS lost, false AS frozen, CAST(NULL AS BIGINT) AS in_lo, CAST(NULL AS BIGINT) AS in_hi, CAST([] AS BIGINT[]) AS path FROM sized WHERE parent_id IS NULL
  UNION ALL SELECT root_id, id, kind, width, times, if(gone, 0, CAST(CASE WHEN p_kind IN ('concat', 'pattern') THEN base + p_width - elder - width WHEN p_kind = 'replicate' THEN base + p_width - copy * width ELSE base END AS BIGINT)), gone, stuck,
    if(stuck, if(frozen, in_lo, if(lost OR p_width IS NULL, NULL, base)), NULL), if(stuck, if(frozen, in_hi, if(lost OR p_width IS NULL, NULL, base + p_width - 1)), NULL), list_concat(path, [CAST(copy AS BIGINT), nth])
  FROM (SELECT w.root_id, c.id, c.kind, c.width, c.times, c.elder, c.nth, w.base, w.lost, w.frozen, w.in_lo, w.in_hi, w.path, w.kind AS p_kind, w.width AS p_width, x.copy, w.frozen OR w.kind IN ('expression', 'reference', 'constant') AS stuck,
          w.lost OR w.width IS NULL OR CASE WHEN w.kind IN ('concat', 'pattern') THEN NOT c.known WHEN w.kind = 'replicate' THEN c.width IS NULL WHEN w.kind = 'convert' THEN c.width IS DISTINCT FROM w.width ELSE false END AS gone
        FROM walk w JOIN sized c ON c.parent_id = w.id JOIN times4 x ON if(w.kind = 'replicate' AND NOT (w.lost OR w.width IS NULL) AND NOT w.frozen AND c.width IS NOT NULL, x.copy BETWEEN 1 AND w.times, x.copy = 0))),
spread AS (SELECT *, if(frozen, in_lo, if(width IS NULL OR lost, NULL, base)) AS win_lo, if(frozen, in_hi, if(width IS NULL OR lost, NULL, base + width - 1)) AS win_hi FROM walk),
pieces AS (
  SELECT root_id, path, r.id AS ref_id, net_id, lo, hi, exact, win_lo, win_hi, frozen AS expression, coalesce(NOT frozen AND exact = 1 AND win_lo IS NOT NULL AND coalesce(hi - lo + 1, net_width) = width, false) AS positional FROM spread p JOIN expr_reads r ON r.node_id = p.id
  UNION ALL SELECT root_id, path, NULL, NULL, NULL, NULL, NULL, win_lo, win_hi, false, false FROM spread WHERE NOT frozen AND kind = 'constant'),
segs AS (SELECT * EXCLUDE (path), row_number() OVER (PARTITION BY root_id ORDER BY path, ref_id) - 1 AS ordinal FROM pieces)
"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """exprs and expr_reads; the lines, which each shape of operand reads, are numbered once."""
    given = {"lines": written(staged(spark, sf_dir, "lines").select("lid", "ok", "ln", "pk", "qty"))}
    return staged(spark, sf_dir, "exprs", given), staged(spark, sf_dir, "expr_reads", given)


QUERIES["conn_segments"] = lambda spark, sf_dir: trees.segments(*_trees(spark, sf_dir))
SQL["conn_segments"] = over_stage(_SEGMENTS + "SELECT * FROM segs", "exprs", "expr_reads")


def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, wide = trees.sized_segments(*_trees(spark, sf_dir))
    at = staged(spark, sf_dir, "ports").join(wide.select(F.col("root_id").alias("__of"), F.col("width").alias("expr_width")), F.col("root_id") == F.col("__of"), "left").drop("__of")
    slot = F.col("expr_width") + F.col("off").cast("int")
    return trees.connections(at.withColumns({"slot_width": slot, "term_width": slot + F.col("slot_lsb")}), pieces)


QUERIES["array_conns"] = _connections
SQL["array_conns"] = over_stage(_SEGMENTS.rstrip() + """,
act AS (SELECT p.*, s.width AS ew, s.width + CAST(off AS INT) AS sw, s.width + CAST(off AS INT) + slot_lsb AS tw FROM ports p LEFT JOIN sized s ON s.id = p.root_id),
tied AS (SELECT a.*, s.* EXCLUDE (root_id), s.root_id IS NOT NULL AS there, NOT in_array AND ew > 0 AND NOT (sw > 0 AND sw <> ew) AND win_lo IS NOT NULL AS fits,
  CASE WHEN interface THEN 'interface' WHEN a.root_id IS NULL THEN 'unconnected' WHEN s.ref_id IS NULL THEN 'constant' WHEN s.expression THEN 'expression_operand' WHEN s.net_id IS NULL THEN 'external_reference' ELSE 'signal' END AS conn_kind
  FROM act a LEFT JOIN segs s ON s.root_id = a.root_id),
whole AS (SELECT *, win_lo = 0 AND win_hi + 1 >= ew AND slot_lsb = 0 AND sw = tw AS all_of FROM tied)
SELECT conn_id, term_id, coalesce(ordinal, 0) AS ordinal, conn_kind, net_id, CASE WHEN net_id IS NOT NULL AND NOT in_array THEN lo END AS outer_lo, CASE WHEN net_id IS NOT NULL AND NOT in_array THEN hi END AS outer_hi,
  CASE WHEN net_id IS NULL THEN NULL WHEN in_array THEN 0 ELSE exact END AS outer_exact, CASE WHEN fits AND NOT coalesce(all_of, false) AND conn_kind NOT IN ('interface', 'unconnected') THEN win_lo + slot_lsb END AS term_lo,
  CASE WHEN fits AND NOT coalesce(all_of, false) AND conn_kind NOT IN ('interface', 'unconnected') THEN win_hi + slot_lsb END AS term_hi, CASE WHEN conn_kind NOT IN ('interface', 'unconnected') THEN CAST(coalesce(fits, false) AS INT) END AS term_exact,
  CASE WHEN conn_kind IN ('signal', 'external_reference') THEN CAST("positional" AND NOT in_array AND NOT coalesce(ew > 0 AND sw > 0 AND sw <> ew, false) AS INT) WHEN conn_kind = 'expression_operand' AND net_id IS NOT NULL THEN 0 END AS map_exact
FROM whole""", "exprs", "expr_reads", "ports")
QUERIES["array_elements"] = lambda spark, sf_dir: trees.elements(staged(spark, sf_dir, "array_actuals"))
SQL["array_elements"] = over_stage("""+e AS (SELECT *, CASE WHEN expr_width = port_width THEN 'shared' WHEN expr_width = port_width * elements THEN 'dealt' ELSE 'mismatch' END AS way FROM array_actuals)
SELECT conn_id, k AS element, CASE way WHEN 'shared' THEN 0 WHEN 'dealt' THEN expr_width - (k + 1) * port_width END AS lo, CASE way WHEN 'shared' THEN port_width - 1 WHEN 'dealt' THEN expr_width - k * port_width - 1 END AS hi, way
FROM (SELECT *, unnest(CASE WHEN way = 'mismatch' THEN [NULL] ELSE range(elements) END) AS k FROM e)""", "array_actuals")

# --- numbering ---------------------------------------------------------------------------------
QUERIES["reserved_ids"] = lambda spark, sf_dir: stamp.reserved(staged(spark, sf_dir, "held"))
SQL["reserved_ids"] = over_stage("""+n AS (SELECT *, CASE kind WHEN 'generate' THEN 0 WHEN 'primitive' THEN 1 ELSE 2 END AS slot FROM held),
under AS (SELECT id AS top, id FROM n UNION ALL SELECT u.top, n.id FROM under u JOIN n ON n.owner = u.id),
sizes AS (SELECT top, count(*) - 1 AS below FROM under GROUP BY top),
ranked AS (SELECT n.id, n.owner, below, count(*) OVER w - 1 AS nth, CAST(coalesce(sum(below) OVER w2, 0) AS BIGINT) AS past, coalesce(k, 0) AS own
  FROM n JOIN sizes ON top = n.id LEFT JOIN (SELECT owner AS o, count(*) AS k FROM n GROUP BY owner) c ON c.o = n.id
  WINDOW w AS (PARTITION BY n.owner ORDER BY slot, ordinal, n.id), w2 AS (PARTITION BY n.owner ORDER BY slot, ordinal, n.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
down AS (SELECT id, nth + past + 1 AS node_id, nth + past + 1 AS start, own, CAST(0 AS INT) AS level FROM ranked WHERE owner IS NULL
  UNION ALL SELECT p.id, d.start + p.nth + 1, d.start + d.own + p.past, p.own, d.level + 1 FROM down d JOIN ranked p ON p.owner = d.id)
SELECT id, node_id, level FROM down""", "held")

# --- closures of all call sites ----------------------------------------------------------------
#: How far the cones of the registered query reach.
STEPS = 3


def _cones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Design.of_star(spark, sf_dir, keep=True)
    tagged = d["net_dep"].where("call_site_id is not null").select(F.col("tgt_net_id").alias("seed"), F.col("call_site_id").alias("site"), F.col("tgt_net_id").alias("node"))
    return closure.reached_by_site(closure.sited_edges(d), tagged, STEPS).select("seed", "site", "node", "depth")


QUERIES["cones_by_callsite"] = _cones
SQL["cones_by_callsite"] = over_star(f"""+edges AS (SELECT DISTINCT signal_net_id AS src, driver_net_id AS dst, call_site_id AS site FROM v_driver WHERE driver_net_id IS NOT NULL),
cone AS (SELECT DISTINCT tgt_net_id AS seed, call_site_id AS site, tgt_net_id AS node, 0 AS depth FROM net_dep WHERE call_site_id IS NOT NULL
  UNION SELECT c.seed, c.site, e.dst, c.depth + 1 FROM cone c JOIN edges e ON e.src = c.node AND (e.site IS NULL OR e.site = c.site) WHERE c.depth < {STEPS})
SELECT seed, site, node, min(depth) AS depth FROM cone GROUP BY seed, site, node""", "v_driver").replace("WITH ", "WITH RECURSIVE ", 1)

# --- integrity ---------------------------------------------------------------------------------
QUERIES["table_digests"] = lambda spark, sf_dir: integrity.digests(Design.of_star(spark, sf_dir, keep=True))


def _told(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE length(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


SQL["table_digests"] = over_star(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5({' || '.join(_told(c) for c in schema.TABLES[t].names)}), 1, 12) AS BIGINT)), 0) AS VARCHAR) AS digest FROM {t}" for t in schema.TABLES))
