"""The queries over the star tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions import encode, ranges
from wirespan.operators import closure, coverage, extract, lookup, resolve, stamp, verify, views
from wirespan.operators.verify import signatures
from wirespan.plans import elaborated, planted
from wirespan.plans.oracle import VIEW_SQL, over_star
from wirespan.plans.rules import RULE_SQL
from wirespan.sources import filelist, schema
from wirespan.sources.design import Design

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[Design], DataFrame], select: str | None = None, *names: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Design.of_star(spark, sf_dir, keep=True))
    if select:
        SQL[name] = over_star(select, *names)


for _view, _make in views.VIEWS.items():
    _add(_view.removeprefix("v_"), _make, f"SELECT * FROM {_view}", _view)
_add("conn_arc", views.conn_arc, "SELECT * FROM arcs", "arcs")


# --- questions ---------------------------------------------------------------------------------
NET = 20_000_001
for _name, _view, _column in (("driver_of_net", "v_driver", "signal_net_id"), ("load_of_net", "v_load", "signal_net_id"), ("attachments_of_net", "v_net_attachment", "net_id"), ("deps_of_net", "v_net_dep", "tgt_net_id"), ("conns_of_net", "v_net_conn", "outer_net_id")):
    _of = {"v_net_conn": 40_000_003, "v_load": 10_000_001}.get(_view, NET)
    _add(_name, lambda d, v=_view, c=_column, n=_of: lookup.of_nets(views.VIEWS[v](d), [n], c), f"SELECT * FROM {_view} WHERE {_column} = {_of}", _view)

_add("multi_driven", lookup.multi_driven, "SELECT signal_net_id, count(*) AS n_drivers, count(DISTINCT driver_net_id) AS n_nets FROM v_driver WHERE driver_kind IN ('data', 'control', 'primitive', 'procedure', 'connection', 'connection_expression') GROUP BY 1 HAVING count(*) > 1", "v_driver")
_add("undriven", coverage.undriven, "SELECT id AS net_id, inst_id, name AS net_name FROM net WHERE id NOT IN (SELECT signal_net_id FROM v_driver)", "v_driver")
_add("unused", coverage.unused, "SELECT id AS net_id, inst_id, name AS net_name FROM net WHERE id NOT IN (SELECT signal_net_id FROM v_load WHERE signal_net_id IS NOT NULL)", "v_load")
_add("param_seek", lambda d: lookup.by_parameter(d, "SEG", "BUILDING"), "SELECT inst_id FROM inst_param WHERE name = 'SEG' AND value = 'BUILDING'")
_add("param_roundtrip", lambda d: signatures(d["inst_param"]), "SELECT inst_id, string_agg(name || '=' || value, ',' ORDER BY ordinal) AS signature FROM inst_param GROUP BY inst_id")
_add("force_hunt", lookup.forced, "SELECT s.id AS stmt_id, s.inst_id, w.net_id FROM stmt s JOIN stmt_target w ON w.stmt_id = s.id WHERE s.construct = 'force'")
_TWO = "WITH a AS (SELECT DISTINCT {0}, driver_net_id AS a, signal_net_id AS b FROM v_driver WHERE {0} IS NOT NULL AND driver_net_id IS NOT NULL) SELECT x.* FROM a x JOIN a y ON x.{0} = y.{0} AND x.a = y.b AND x.b = y.a WHERE x.a < x.b"
for _by in ("stmt", "prim", "conn"):
    _add(f"{_by}_pairs", lambda d, b=f"{_by}_id": lookup.two_way(d, b), f"SELECT * FROM ({_TWO.format(f'{_by}_id')})", "v_driver")

# --- closures ----------------------------------------------------------------------------------
_UP = "/*recursive*/+up AS (SELECT id AS node, {0} AS pos FROM tree_node UNION ALL SELECT node, parent_node_id FROM up JOIN tree_node t ON t.id = up.pos WHERE up.pos NOT IN (SELECT id FROM inst)) SELECT node, max(if(pos IN (SELECT id FROM inst), pos, NULL)) AS ancestor FROM up GROUP BY node"


def _recursive(select: str, *names: str) -> str:
    return over_star(select.removeprefix("/*recursive*/"), *names).replace("WITH ", "WITH RECURSIVE ", 1)


_add("nearest_inst", lookup.nearest_inst)
SQL["nearest_inst"] = _recursive(_UP.format("parent_node_id"))
_add("scope_owner", lookup.scope_owner)
SQL["scope_owner"] = _recursive(_UP.format("id"))
_add("call_strings", lookup.call_strings)
SQL["call_strings"] = _recursive("+c AS (SELECT id AS call_site_id, parent_call_site_id AS caller_id, CAST(1 AS BIGINT) AS distance FROM call_site WHERE parent_call_site_id IS NOT NULL UNION ALL SELECT c.call_site_id, p.parent_call_site_id, distance + 1 FROM c JOIN call_site p ON p.id = c.caller_id WHERE p.parent_call_site_id IS NOT NULL) SELECT * FROM c")


def _cone(edges: Callable, site: bool = False) -> Callable[[Design], DataFrame]:
    def run(d: Design) -> DataFrame:
        if site:
            tagged = d["net_dep"].where("call_site_id is not null").agg(F.min("call_site_id").alias("call_site_id"))
            seeds = d["net_dep"].join(tagged, "call_site_id", "left_semi").select("tgt_net_id").distinct()
            return closure.reached(edges(d, tagged), seeds.select(F.col("tgt_net_id").alias("seed"), F.col("tgt_net_id").alias("node"))).select("seed", "node")
        seeds = d["net"].where((F.col("name") == "bus") | (F.col("id") == NET)).select(F.col("id").alias("seed"), F.col("id").alias("node"))
        return closure.reached(edges(d), seeds).select("seed", "node")

    return run


_CONE = "+cone AS (SELECT id AS seed, id AS node FROM net WHERE name = 'bus' OR id = 20000001 UNION SELECT c.seed, v.{0} FROM cone c JOIN {1} v ON v.signal_net_id = c.node WHERE v.{0} IS NOT NULL) SELECT seed, node FROM cone"
_add("cone_in", _cone(closure.fan_in_edges))
SQL["cone_in"] = _recursive(_CONE.format("driver_net_id", "v_driver"), "v_driver")
_add("cone_out", _cone(closure.fan_out_edges))
SQL["cone_out"] = _recursive(_CONE.format("load_net_id", "v_load"), "v_load")
_add("cone_callsite", _cone(closure.fan_in_edges, site=True))
SQL["cone_callsite"] = _recursive("+one AS (SELECT min(call_site_id) AS c FROM net_dep), cone AS (SELECT DISTINCT tgt_net_id AS seed, tgt_net_id AS node FROM net_dep, one WHERE call_site_id = c UNION SELECT k.seed, v.driver_net_id FROM cone k JOIN v_driver v ON v.signal_net_id = k.node, one WHERE v.driver_net_id IS NOT NULL AND (v.call_site_id IS NULL OR v.call_site_id = c)) SELECT seed, node FROM cone", "v_driver")


# --- paths and references ----------------------------------------------------------------------
def _paths(d: Design) -> DataFrame:
    """Every path of four names and more: asked for by its text, answered by its node."""
    n = d["tree_node"]
    up = lambda a, p: n.select(F.col("id").alias(f"{a}_id"), F.col("parent_node_id").alias(f"{a}_up"), F.col("name").alias(f"{a}_name"))
    asked = up("a", 0).join(up("b", 1), F.col("a_up") == F.col("b_id")).join(up("c", 2), F.col("b_up") == F.col("c_id")).join(up("e", 3), F.col("c_up") == F.col("e_id")).where("e_up is null")
    asked = asked.select(F.concat_ws(".", "e_name", "c_name", "b_name", "a_name").alias("path"))
    wanted = asked.select(F.col("path").alias("key"), F.lit(None).cast("long").alias("start"), resolve.segments(F.col("path")).alias("names"))
    return resolve.descend(n.select("id", F.col("parent_node_id").alias("parent"), "name"), wanted).select(F.col("key").alias("path"), F.col("node").alias("node_id"))


_add("path_lookup", _paths)
SQL["path_lookup"] = over_star("SELECT concat_ws('.', e.name, c.name, b.name, a.name) AS path, a.id AS node_id FROM tree_node a JOIN tree_node b ON a.parent_node_id = b.id JOIN tree_node c ON b.parent_node_id = c.id JOIN tree_node e ON c.parent_node_id = e.id WHERE e.parent_node_id IS NULL")


def _href(d: Design) -> DataFrame:
    """References from every customer to the bus of its nation (by the whole path) and to a pin of its own, one in seven of them to nothing."""
    c = d["tree_node"].where("id >= 1000000 and id < 2000000").select(F.col("id").alias("inst_id"), "name", "parent_node_id")
    g = d["tree_node"].select(F.col("id").alias("g"), F.col("parent_node_id").alias("n"))
    i = d["tree_node"].select(F.col("id").alias("i"), F.col("parent_node_id").alias("r"), F.col("name").alias("i_name"))
    r = d["tree_node"].select(F.col("id").alias("r_id"), F.col("name").alias("r_name"))
    at = c.join(g, F.col("parent_node_id") == F.col("g")).join(i, F.col("n") == F.col("i")).join(r, F.col("r") == F.col("r_id"))
    bus = at.select((F.col("inst_id") * 2).alias("id"), "inst_id", F.concat("r_name", F.lit(" . "), "i_name", F.lit(".gen.bus[7:0]")).alias("path"))
    pin = at.select((F.col("inst_id") * 2 + 1).alias("id"), "inst_id", F.when(F.col("inst_id") % 7 == 0, "no.such").otherwise("/* own */ pin").alias("path"))
    return resolve.references(bus.unionByName(pin), d)


_add("href_resolve", _href)
SQL["href_resolve"] = over_star("SELECT c.id * 2 AS id, 11 + g.id - 41 AS resolved_inst_id, 40000000 + g.id - 41 AS resolved_net_id FROM tree_node c JOIN tree_node g ON g.id = c.parent_node_id WHERE c.id >= 1000000 AND c.id < 2000000 UNION ALL SELECT c.id * 2 + 1, n.inst_id, n.id FROM tree_node c LEFT JOIN net n ON n.inst_id = c.id AND n.name = 'pin' AND c.id % 7 <> 0 WHERE c.id >= 1000000 AND c.id < 2000000")


def _through(d: Design) -> DataFrame:
    """From each interface terminal to the bus of the instance it is bound to, and to a name that is not there."""
    ports = d["term"].where("term_kind = 'interface'").select(F.col("id").alias("term_id"), "inst_id", "name")
    far = ports.select((F.col("term_id") * 2).alias("id"), "inst_id", F.concat("name", F.lit(".gen . bus[3:0]")).alias("path"))
    none = ports.select((F.col("term_id") * 2 + 1).alias("id"), "inst_id", F.concat("name", F.lit(".gen.none")).alias("path"))
    bound = d["net_conn"].where("conn_kind = 'interface'").select("term_id", F.col("outer_intf_inst_id").alias("bound_inst_id"))
    return resolve.through_interface(far.unionByName(none), bound, d)


_add("through_interface", _through, "SELECT t.id * 2 AS id, n.inst_id AS resolved_inst_id, n.id AS resolved_net_id FROM term t LEFT JOIN net_conn c ON c.term_id = t.id AND c.conn_kind = 'interface' LEFT JOIN tree_node g ON g.parent_node_id = c.outer_intf_inst_id AND g.name = 'gen' LEFT JOIN net n ON n.scope_node_id = g.id AND n.name = 'bus' WHERE t.term_kind = 'interface' UNION ALL SELECT id * 2 + 1, NULL, NULL FROM term WHERE term_kind = 'interface'")


def _cross(d: Design) -> DataFrame:
    """Each reference as the source of a dependency into its statement's target, and as the target of one from it."""
    refs, writes = d["hier_ref"].where("stmt_id is not null"), d["stmt_target"].select(F.col("stmt_id").alias("s"), "net_id")
    both = refs.join(writes, F.col("stmt_id") == F.col("s"))
    none = F.lit(None).cast("long")
    own, net = F.col("id"), F.col("resolved_net_id")
    into = both.select(own.alias("src_hier_ref_id"), none.alias("tgt_hier_ref_id"), none.alias("src_net_id"), F.col("net_id").alias("tgt_net_id"), net.alias("src_ref_net_id"), none.alias("tgt_ref_net_id"))
    out = both.select(none.alias("src_hier_ref_id"), own.alias("tgt_hier_ref_id"), F.col("net_id").alias("src_net_id"), none.alias("tgt_net_id"), none.alias("src_ref_net_id"), net.alias("tgt_ref_net_id"))
    return resolve.cross_deps(into.unionByName(out))


_add("cross_deps", _cross, "SELECT h.id AS src_hier_ref_id, CAST(NULL AS BIGINT) AS tgt_hier_ref_id, h.resolved_net_id AS src_net_id, w.net_id AS tgt_net_id FROM hier_ref h JOIN stmt_target w USING (stmt_id) UNION ALL SELECT NULL, h.id, w.net_id, h.resolved_net_id FROM hier_ref h JOIN stmt_target w USING (stmt_id) WHERE h.resolved_net_id IS NOT NULL")


# --- stamping ----------------------------------------------------------------------------------
def _occurrences(d: Design) -> DataFrame:
    real = d["inst"].where("module_id is not null").select(F.col("id").alias("inst_id"), F.col("module_id").alias("group_key"))
    return real.withColumns({"n_net": F.col("group_key") % 3 + 1, "n_stmt": F.col("group_key") % 2})


_OCC = "WITH o AS (SELECT id AS inst_id, module_id AS group_key, module_id % 3 + 1 AS n_net, module_id % 2 AS n_stmt FROM inst WHERE module_id IS NOT NULL), b AS (SELECT *, CAST(coalesce(sum(n_net) OVER w, 0) AS BIGINT) AS base_n_net, CAST(coalesce(sum(n_stmt) OVER w, 0) AS BIGINT) AS base_n_stmt FROM o WINDOW w AS (ORDER BY inst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
_add("stamp_prefix_sum", lambda d: stamp.bases(_occurrences(d), ["inst_id"], ["n_net", "n_stmt"]))
SQL["stamp_prefix_sum"] = over_star(f"SELECT * FROM ({_OCC} SELECT * FROM b)")


def _stamped(d: Design) -> DataFrame:
    """Nets of each occurrence of a module's template; net k of a template points to the one before it."""
    occ = stamp.bases(_occurrences(d), ["inst_id"], ["n_net", "n_stmt"])
    template = d["module"].select(F.col("id").alias("group_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3)).alias("idx")).withColumn("prior", F.when(F.col("idx") > 0, F.col("idx") - 1))
    return stamp.replay(occ, template, "base_n_net", {"prior": "base_n_net"}).select("inst_id", "id", F.col("prior").alias("prior_id"))


_add("stamp_replay", _stamped)
SQL["stamp_replay"] = over_star(f"SELECT * FROM ({_OCC} SELECT inst_id, base_n_net + k + 1 AS id, if(k > 0, base_n_net + k, NULL) AS prior_id FROM (SELECT *, unnest(range(n_net)) AS k FROM b))")
_add("slot_overlap", lambda d: stamp.slot_pairs(d["stmt_target"], d["assign_operand"]), "SELECT w.stmt_id, w.id AS tgt_id, o.id AS src_id, greatest(w.lo, o.lo) AS lo, least(w.hi, o.hi) AS hi FROM stmt_target w JOIN assign_operand o ON o.stmt_id = w.stmt_id AND NOT coalesce(w.lo > o.hi, false) AND NOT coalesce(o.lo > w.hi, false)")
_add("duplicate_siblings", lambda d: stamp.duplicate_siblings(d["tree_node"].select(F.col("parent_node_id").alias("parent"), "name")), "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM tree_node GROUP BY parent_node_id, name)")

# --- rules and metrics -------------------------------------------------------------------------
_NEAREST = "nearest AS (" + _UP.format("parent_node_id").removeprefix("/*recursive*/+").replace("up AS (", "WITH RECURSIVE up AS (", 1) + ")"


def _planted(spark: SparkSession, sf_dir: str, given: dict | None = None) -> Design:
    """The design of the folder, with rows that break the rules, or those given."""
    star, more = Design.of_star(spark, sf_dir, keep=True), given or planted.rows()
    added = Design.of(spark, more)
    return Design.of(spark, {t: star[t].select(*schema.TABLES[t].names).union(added[t]) if t in more else star[t] for t in schema.TABLES})


def _broken(rules: list[str], **more: bool) -> str:
    text = " UNION ALL ".join(f"SELECT '{r}' AS rule, what FROM ({RULE_SQL[r]})" for r in rules)
    return over_star(f"+{_NEAREST} {text}", *(v for v in VIEW_SQL if v in text), **more)


_RULE_SETS = {
    "fk_violations": ["K4"], "domain_violations": ["K5", "K6"], "range_violations": ["K7"], "width_violations": ["K55", "K56", "K57"], "window_overlap": ["K58"],
    "tree_violations": ["K8", "K9", "K10", "K11", "K12", "K13", "K14", "K15", "K16", "K17", "K19", "K20", "K21"],
    "stmt_violations": ["K24", "K25", "K26", "K27", "K28", "K29", "K30", "K31", "K32", "K33", "K34", "K35", "K36", "K37", "K38", "K39", "K40", "K41"],
    "dep_violations": ["K42", "K43", "K44", "K45", "K46", "K47", "K48", "K49", "K50", "K51", "K52", "K53", "K54"],
    "conn_violations": ["K22", "K23", "K59", "K60", "K61"], "meta_violations": ["K1", "K2", "K18", "K62", "K63", "K87"],
    "count_violations": ["K65", "K66", "K67", "K68", "K69"], "view_violations": ["K70", "K71", "K72", "K73", "K74", "K75", "K76", "K77", "K78", "K79", "K80", "K81", "K82", "K83", "K84", "K85"],
}
for _name, _rules in _RULE_SETS.items():
    QUERIES[_name] = lambda spark, sf_dir, r=_rules: verify.violations(spark, Design.of_star(spark, sf_dir, keep=True), r)
    SQL[_name] = _broken(_rules)
    # Counts of views and tables: rows given twice break them.
    _more = planted.rows(planted.DOUBLED) if _name == "count_violations" else planted.rows()
    QUERIES[f"planted_{_name}"] = lambda spark, sf_dir, r=_rules, m=_more: verify.violations(spark, _planted(spark, sf_dir, m), r)
    SQL[f"planted_{_name}"] = _broken(_rules, planted=_more)
_BOTH = planted.rows([*planted.LEGAL, *planted.TWO_WAY])
QUERIES["planted_prim_pairs"] = lambda spark, sf_dir: lookup.two_way(_planted(spark, sf_dir, _BOTH), "prim_id")
SQL["planted_prim_pairs"] = over_star(f"SELECT * FROM ({_TWO.format('prim_id')})", "v_driver", planted=_BOTH)
_add("view_contract", verify.view_contract, " UNION ALL ".join(f"SELECT '{v}' AS view_name, '{','.join(schema.VIEWS[v])}' AS columns, count(*) AS n_rows FROM {v}" for v in views.VIEWS), *views.VIEWS)
_add("top_check", verify.tops, "SELECT name, name IN (SELECT value FROM meta WHERE key = 'top') AS is_top FROM tree_node WHERE node_kind = 'root'")

_PCT = "CASE WHEN whole > 0 THEN round(100.0 * part / whole, 2) ELSE 0.0 END AS percent"
_METRICS = [(f"{t}.{e}", t, f"{e} = 0", f"{e} IS NOT NULL") for t, _, _, e in verify.WINDOWS] + [(f"{t}.map_exact", t, "map_exact = 0", "map_exact IS NOT NULL") for t in ("net_dep", "net_conn")]
_add("coverage_inexact", coverage.inexact, "SELECT metric, part, whole, " + _PCT + " FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (WHERE {p}) AS part, count(*) AS whole FROM {t} WHERE {w}" for m, t, p, w in _METRICS) + ")")
_add("coverage_dropped", coverage.dropped, "SELECT metric, part, whole, operands, " + _PCT + " FROM (SELECT 'stmt.dropped' AS metric, count(*) FILTER (WHERE dropped_operand_count > 0) AS part, count(*) AS whole, CAST(sum(dropped_operand_count) AS BIGINT) AS operands FROM stmt)")
_add("coverage_sourceless", coverage.sourceless, "SELECT metric, part, whole, " + _PCT + " FROM (SELECT 'net_dep.sourceless' AS metric, count(*) FILTER (WHERE src_net_id IS NULL) AS part, count(*) AS whole FROM net_dep)")
_add("coverage_resolution", coverage.resolution, "SELECT count(resolved_net_id) AS to_net, count(resolved_inst_id) FILTER (WHERE resolved_net_id IS NULL) AS to_instance_only, count(*) AS refs, round(100.0 * count(resolved_net_id) / count(*), 2) AS percent FROM hier_ref")
_add("coverage_undriven", coverage.undriven_split, "+pins AS (SELECT DISTINCT m.inner_net_id AS n FROM term_map m JOIN term e ON e.id = m.term_id JOIN tree_node r ON r.id = e.inst_id WHERE r.node_kind = 'root' AND e.direction IN ('input', 'inout')), u AS (SELECT id FROM net WHERE id NOT IN (SELECT signal_net_id FROM v_driver)) SELECT (SELECT count(*) FROM u) AS all_undriven, (SELECT count(*) FROM u WHERE id NOT IN (SELECT n FROM pins)) AS internal, (SELECT count(*) FROM pins) AS root_inputs, (SELECT count(*) FROM net) AS nets, round(100.0 * (SELECT count(*) FROM u WHERE id NOT IN (SELECT n FROM pins)) / (SELECT count(*) FROM net), 2) AS percent", "v_driver")
_add("coverage_meta", coverage.meta, "SELECT " + ", ".join(f"(SELECT max(value) FROM meta WHERE key = '{k}') AS {k}" for k in coverage.META))
_add("name_like", lambda d: lookup.by_name(d, "O1%5"), "SELECT id AS net_id, inst_id, name AS net_name FROM net WHERE name ILIKE 'O1%5'")
_add("expansion_ratio", coverage.expansion, "SELECT occurrences, variants, round(occurrences / variants, 2) AS ratio FROM (SELECT count(*) AS occurrences, count(DISTINCT (module_id, coalesce(param_signature, ''))) AS variants FROM inst WHERE module_id IS NOT NULL)")
_NAMES = list(schema.TABLES)
_add("row_counts", lambda d: coverage.row_counts(d, _NAMES), " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _NAMES))

# --- template rows -----------------------------------------------------------------------------



def _slots(d: Design) -> tuple[DataFrame, DataFrame]:
    """Targets fill the low or high half of a 32-bit value; one operand in five has no place, others a byte."""
    t = d["stmt_target"].select("stmt_id", "id", "net_id", "lo", "hi", F.col("is_exact").alias("exact"), (F.col("stmt_id") % 2 * 16).alias("slot_lo"), (F.col("stmt_id") % 2 * 16 + 15).alias("slot_hi"))
    free = F.col("net_id") % 5 == 0
    s = d["assign_operand"].select("stmt_id", "id", "net_id", "lo", "hi", F.col("is_exact").alias("exact"), F.when(~free, F.col("ordinal") % 4 * 8).alias("slot_lo"), F.when(~free, F.col("ordinal") % 4 * 8 + 7).alias("slot_hi"))
    return t, s


_add("assign_deps", lambda d: extract.assign_deps(*_slots(d)), """+t AS (SELECT *, stmt_id % 2 * 16 AS a, stmt_id % 2 * 16 + 15 AS b FROM stmt_target),
s AS (SELECT *, if(net_id % 5 = 0, NULL, ordinal % 4 * 8) AS a, if(net_id % 5 = 0, NULL, ordinal % 4 * 8 + 7) AS b FROM assign_operand),
m AS (SELECT t.stmt_id, t.id AS tid, s.id AS sid, t.net_id AS tn, t.lo AS tl, t.hi AS th, t.is_exact AS te, s.net_id AS sn, s.lo AS sl, s.hi AS sh, s.is_exact AS se, t.a AS ta, s.a AS sa, greatest(t.a, s.a) AS lo, least(t.b, s.b) AS hi
  FROM t LEFT JOIN s ON s.stmt_id = t.stmt_id AND (s.a IS NULL OR (s.a <= t.b AND t.a <= s.b)))
SELECT stmt_id, tid AS stmt_target_id, sid AS assign_operand_id, tn AS tgt_net_id, if(sa IS NOT NULL AND te = 1, coalesce(tl, 0) + lo - ta, tl) AS tgt_lo, if(sa IS NOT NULL AND te = 1, coalesce(tl, 0) + hi - ta, th) AS tgt_hi, te AS tgt_exact,
  sn AS src_net_id, if(sa IS NOT NULL AND se = 1, coalesce(sl, 0) + lo - sa, sl) AS src_lo, if(sa IS NOT NULL AND se = 1, coalesce(sl, 0) + hi - sa, sh) AS src_hi, se AS src_exact, if(sid IS NULL, NULL, CAST(sa IS NOT NULL AND te = 1 AND se = 1 AS INT)) AS map_exact, 'data' AS dep_kind FROM m""")
_add("control_deps", lambda d: extract.control_deps(d["stmt_target"], d["expr_ref"].where("role = 'control'")), "SELECT w.stmt_id, w.id AS stmt_target_id, w.net_id AS tgt_net_id, r.id AS expr_ref_id, r.net_id AS src_net_id, 0 AS map_exact, 'control' AS dep_kind FROM stmt_target w JOIN expr_ref r USING (stmt_id) WHERE r.role = 'control'")
_add("alias_deps", lambda d: extract.alias_deps(d["assign_operand"].select("stmt_id", (F.col("ordinal") % 3).alias("side"), "net_id")), "SELECT a.stmt_id, a.net_id AS src_net_id, b.net_id AS tgt_net_id, CAST((SELECT count(*) FROM assign_operand x WHERE x.stmt_id = a.stmt_id AND x.ordinal % 3 IN (a.ordinal % 3, b.ordinal % 3)) = 2 AS INT) AS map_exact, 'alias' AS dep_kind FROM assign_operand a JOIN assign_operand b ON a.stmt_id = b.stmt_id AND a.ordinal % 3 <> b.ordinal % 3 AND a.net_id <> b.net_id")


def _pins(d: Design) -> DataFrame:
    """Operands of a statement as terminals of a primitive, by ordinal an input, an output or an inout."""
    way = F.when(F.col("ordinal") % 3 == 0, "output").when(F.col("ordinal") % 3 == 1, "input").otherwise("inout")
    return d["assign_operand"].select(F.col("stmt_id").alias("prim_id"), F.col("id").alias("terminal"), "net_id", way.alias("direction"), (F.col("ordinal") % 2 + 1).alias("width"))


_add("prim_deps", lambda d: extract.prim_deps(_pins(d)), "+p AS (SELECT stmt_id AS prim_id, id, net_id, ordinal % 3 AS k, ordinal % 2 + 1 AS w FROM assign_operand) SELECT o.prim_id, i.net_id AS src_net_id, o.net_id AS tgt_net_id, if(i.id IS NULL, NULL, CAST(i.w = 1 AND o.w = 1 AS INT)) AS map_exact, 'primitive' AS dep_kind FROM (SELECT * FROM p WHERE k <> 1) o LEFT JOIN (SELECT * FROM p WHERE k <> 0) i ON i.prim_id = o.prim_id AND i.id <> o.id")
_add("call_deps", lambda d: extract.call_deps(d["call_site"].join(d["proc_event"].select("id", "net_id"), "id").select(F.col("id").alias("call_site_id"), F.col("net_id").alias("actual_net_id"), (F.col("id") + 7).alias("formal_net_id"), F.when(F.col("id") % 3 == 0, "input").when(F.col("id") % 3 == 1, "output").otherwise("inout").alias("direction"))), "+b AS (SELECT c.id, e.net_id AS actual, c.id + 7 AS formal FROM call_site c JOIN proc_event e USING (id)) SELECT id AS call_site_id, actual AS src_net_id, formal AS tgt_net_id, 'procedure' AS dep_kind FROM b WHERE id % 3 <> 1 UNION ALL SELECT id, formal, actual, 'procedure' FROM b WHERE id % 3 <> 0")
_add("port_windows", lambda d: extract.windows_from_right(d["assign_operand"].select(F.col("stmt_id").alias("term_id"), F.col("id").alias("ordinal"), (F.col("ordinal") + 1).alias("width"))), "SELECT stmt_id AS term_id, id AS ordinal, ordinal + 1 AS width, CAST(s - ordinal - 1 AS BIGINT) AS lo, CAST(s - 1 AS BIGINT) AS hi FROM (SELECT *, sum(ordinal + 1) OVER (PARTITION BY stmt_id ORDER BY id DESC) AS s FROM assign_operand)")
_add("conn_copies", lambda d: extract.copies(d["assign_operand"].select("id", "lo", (F.col("hi") - F.col("lo") + 1).alias("width"), (F.col("ordinal") % 3 + 1).alias("times")).where("lo is not null")), "SELECT id, lo + k * 8 AS lo, CAST(8 AS BIGINT) AS width, times, k AS copy, lo + k * 8 + 7 AS hi FROM (SELECT id, lo, ordinal % 3 + 1 AS times, unnest(range(ordinal % 3 + 1)) AS k FROM assign_operand WHERE lo IS NOT NULL)")
_add("body_groups", lambda d: extract.bodies(d["inst"].join(d["module"].select(F.col("id").alias("module_id"), F.col("name").alias("def_name"), F.col("file_id").alias("file"), F.col("line").alias("m_line"), F.col("col").alias("m_col")), "module_id").select("id", "def_name", "file", F.col("m_line").alias("line"), F.col("m_col").alias("col"), F.col("param_signature").alias("params"))).drop("group_key"), "SELECT min(i.id) AS representative, count(*) AS occurrences FROM inst i JOIN module m ON m.id = i.module_id GROUP BY m.name, m.file_id, m.line, m.col, coalesce(i.param_signature, '')")
_add("module_definitions", lambda d: extract.definitions(d["module"]), "SELECT name, file_id, line, min(id) AS id FROM module GROUP BY ALL")


# --- what a front end and a stamper leave to joins ---------------------------------------------------------
def _ports(d: Design) -> DataFrame:
    """Interface terminals: of every eighth customer bound to its nation, of the others passed on from the customer before."""
    c = d["inst"].where("id >= 1000000 and id < 2000000").select("id", "parent_inst_id")
    own = F.col("id") % 8 == 0
    return c.select(F.col("id").alias("term_id"), F.when(own, F.col("parent_inst_id")).alias("child_inst_id"), F.when(~own & (F.col("id") % 11 != 0), F.col("id") - 1).alias("via_term_id"))


_PORTS = "ports AS (SELECT id AS term_id, if(id % 8 = 0, parent_inst_id, NULL) AS child_inst_id, if(id % 8 <> 0 AND id % 11 <> 0, id - 1, NULL) AS via_term_id FROM inst WHERE id >= 1000000 AND id < 2000000)"
_add("interface_bindings", lambda d: stamp.interface_bindings(_ports(d)))
SQL["interface_bindings"] = _recursive(f"+{_PORTS}, up AS (SELECT term_id, child_inst_id AS bound, via_term_id AS via FROM ports UNION ALL SELECT u.term_id, p.child_inst_id, p.via_term_id FROM up u JOIN ports p ON p.term_id = u.via WHERE u.bound IS NULL) SELECT term_id, max(bound) AS bound_inst_id FROM up GROUP BY term_id")
_add("pass_through", lambda d: stamp.pass_through(_ports(d)), f"+{_PORTS} SELECT term_id, CASE WHEN child_inst_id > 0 THEN 'sibling' WHEN via_term_id > 0 THEN 'own port' ELSE 'external' END AS binding FROM ports")


def _boxes(d: Design) -> dict[str, DataFrame]:
    """The design's black boxes, each with up to three ports and a connection to the bus of its nation at each port written."""
    i = d["inst"].where("unresolved_def is not null").join(d["tree_node"].select("id", "parent_node_id", "name", "ordinal"), "id")
    children = i.select("id", "parent_node_id", "parent_inst_id", "name", F.col("unresolved_def").alias("def_name"), "ordinal", *stamp.AT)
    ports = children.select(F.col("id").alias("inst_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3)).alias("ordinal")).withColumn("name", F.concat(F.lit("p"), "ordinal"))
    conns = children.select(F.col("id").alias("inst_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("port_ordinal"), (F.col("parent_inst_id") + 39_999_989).alias("outer_net_id")).withColumns({"ordinal": F.col("port_ordinal"), "conn_kind": F.lit("signal")})
    return stamp.unresolved(children, ports, conns, 5_000_000, 6_000_000)


_BOXES = "+boxes AS (SELECT i.id, i.parent_inst_id, i.unresolved_def, i.file_id, i.line, i.col FROM inst i WHERE unresolved_def IS NOT NULL), t AS (SELECT id AS inst_id, k AS ordinal, 5000000 + row_number() OVER (ORDER BY id, k) AS id, file_id, line, col FROM (SELECT *, unnest(range(id % 3 + 1)) AS k FROM boxes))"
_add("unresolved_terms", lambda d: _boxes(d)["term"], _BOXES + " SELECT id, inst_id, 'p' || ordinal AS name, 'signal' AS term_kind, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS BIGINT) AS data_type_id, CAST(NULL AS BIGINT) AS width, ordinal, CAST(NULL AS INT) AS is_const, CAST(NULL AS VARCHAR) AS modport, file_id, line, col FROM t")
_add("unresolved_conns", lambda d: _boxes(d)["net_conn"], _BOXES + " SELECT 6000000 + row_number() OVER (ORDER BY t.inst_id, t.ordinal) AS id, t.id AS term_id, t.ordinal, 'signal' AS conn_kind, b.parent_inst_id + 39999989 AS outer_net_id FROM t JOIN boxes b ON b.id = t.inst_id WHERE t.ordinal <> 1")


def _packaged(d: Design) -> dict[str, DataFrame]:
    """Nations as packages (one of them named std), nets of the root as their members, every fifth a function and every seventh nameless."""
    m = d["module"].select(F.when(F.col("id") == 3, "std").otherwise(F.col("name")).alias("package"), F.col("id").alias("ordinal"), "file_id", "line", "col")
    n = d["net"].where("id >= 10000000 and id < 20000000")
    owner = (F.col("n_id") % 25 + 1).alias("o")
    members = n.select(F.col("id").alias("n_id"), F.when(F.col("id") % 7 == 0, "").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 5 == 0, "function").otherwise("variable").alias("kind"), "decl_kind", "data_type_id", "width", "is_implicit", "file_id", "line", "col")
    members = members.select("*", owner, F.col("n_id").alias("ordinal")).join(m.select("package", F.col("ordinal").alias("o")), "o").drop("o", "n_id")
    return stamp.packages(m, members, 100, 9_000, 7_000_000)


_PACKED = "+m AS (SELECT if(id = 3, 'std', name) AS package, id AS ordinal, file_id, line, col FROM module), p AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS k FROM m WHERE package <> 'std')"
_add("package_insts", lambda d: _packaged(d)["inst"], _PACKED + " SELECT 9000 + k AS id, 100 + k AS module_id, CAST(NULL AS BIGINT) AS parent_inst_id, CAST(NULL AS VARCHAR) AS param_signature, CAST(NULL AS VARCHAR) AS unresolved_def, file_id, line, col FROM p")
_add("package_nets", lambda d: _packaged(d)["net"], _PACKED + " SELECT 7000000 + row_number() OVER (ORDER BY p.k, n.id) AS id, 9000 + p.k AS inst_id, 9000 + p.k AS scope_node_id, n.name, n.decl_kind, n.data_type_id, n.width, n.is_implicit, n.file_id, n.line, n.col FROM net n JOIN p ON p.ordinal = n.id % 25 + 1 WHERE n.id >= 10000000 AND n.id < 20000000 AND n.id % 7 <> 0 AND n.id % 5 <> 0")


def _maps(d: Design) -> DataFrame:
    """Statements as ports: those with operands in places are made of parts, the others stand for their target or, every third, for nothing."""
    t = d["stmt_target"]
    ports = t.select(F.col("stmt_id").alias("term_id"), F.when(F.col("stmt_id") % 3 == 1, F.col("net_id")).alias("expr_net_id"), F.when(F.col("stmt_id") % 3 == 2, F.col("net_id") + 1).alias("symbol_net_id"))
    parts = d["assign_operand"].where("lo is not null").select(F.col("stmt_id").alias("term_id"), F.col("id").alias("ordinal"), "net_id", "lo", "hi", F.col("is_exact").alias("exact"), (F.col("hi") - F.col("lo") + 1).alias("width"))
    return extract.term_maps(ports, parts)


_add("term_maps", _maps, "+o AS (SELECT *, sum(hi - lo + 1) OVER (PARTITION BY stmt_id ORDER BY id DESC) AS s FROM assign_operand WHERE lo IS NOT NULL) SELECT stmt_id AS term_id, id AS ordinal, net_id AS inner_net_id, CAST(s - (hi - lo + 1) AS BIGINT) AS term_lo, CAST(s - 1 AS BIGINT) AS term_hi, 1 AS term_exact, lo AS inner_lo, hi AS inner_hi, is_exact AS inner_exact, is_exact AS map_exact FROM o UNION ALL SELECT stmt_id, 0, if(stmt_id % 3 = 1, net_id, net_id + 1), NULL, NULL, 1, NULL, NULL, 1, 1 FROM stmt_target WHERE stmt_id % 3 <> 0 AND stmt_id NOT IN (SELECT stmt_id FROM o)")


def _planned(d: Design) -> DataFrame:
    """From every customer a path of one of five shapes."""
    c = d["tree_node"].where("id >= 1000000 and id < 2000000").select("id", "name", "parent_node_id")
    k = F.col("id") % 5
    path = F.when(k == 0, "pkg::x").when(k == 1, "pin.sig").when(k == 2, F.concat(F.lit("ASIA . /* x */ "), "name")).when(k == 3, "$root.a.b[c[1]]").otherwise("up.there")
    return resolve.plan(c.select("id", F.col("id").alias("inst_id"), path.alias("path")), d).select("id", "resolve_kind", F.array_join("segs", ".").alias("segs"))


_add("resolution_plan", _planned, "SELECT c.id, CASE c.id % 5 WHEN 0 THEN 'package' WHEN 1 THEN CASE WHEN t.term_kind = 'interface' THEN 'iface_term' WHEN n.id IS NOT NULL THEN 'downward' ELSE 'none' END WHEN 4 THEN 'none' ELSE 'absolute' END AS resolve_kind, CASE c.id % 5 WHEN 0 THEN 'pkg.x' WHEN 1 THEN 'pin.sig' WHEN 2 THEN 'ASIA.' || c.name WHEN 3 THEN '$root.a.b' ELSE 'up.there' END AS segs FROM tree_node c LEFT JOIN term t ON t.inst_id = c.id LEFT JOIN net n ON n.scope_node_id = c.id AND n.name = 'pin' WHERE c.id >= 1000000 AND c.id < 2000000")


def _raw(d: Design) -> DataFrame:
    """Nets as a writer gets them, with values that stand for none."""
    n = d["net"]
    return n.select("id", "inst_id", "scope_node_id", "name", "decl_kind", F.coalesce("data_type_id", F.lit(0)).alias("data_type_id"), F.coalesce("width", F.lit(-1)).alias("width"), "is_implicit", F.coalesce("file_id", F.lit(0)).alias("file_id"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"))


_add("null_encoding", lambda d: encode.encoded(_raw(d), schema.TABLES["net"]), "SELECT * FROM net")
_add("whole_windows", lambda d: d["stmt_target"].join(d["net"].select(F.col("id").alias("n"), "width"), F.col("net_id") == F.col("n")).select("id", ranges.whole(F.col("lo"), F.col("hi"), F.col("width")).alias("whole")), "SELECT w.id, CASE WHEN lo IS NULL AND hi IS NULL THEN true WHEN lo IS NULL THEN false ELSE lo = 0 AND hi >= n.width - 1 END AS whole FROM stmt_target w JOIN net n ON n.id = w.net_id")
_add("self_reads", lambda d: extract.self_reads(_slots(d)[0].withColumn("compound", F.col("id") % 4 == 0)), "SELECT stmt_id, id, net_id, lo, hi, is_exact AS exact, CAST(NULL AS BIGINT) AS slot_lo, CAST(NULL AS BIGINT) AS slot_hi FROM stmt_target WHERE id % 4 = 0")
_add("delays", lambda d: d["stmt"].select("id", extract.delay(F.concat(F.lit(" \t"), F.coalesce("delay", F.lit("")), F.lit("\n  "), F.when(F.col("id") % 2 == 0, "ns").otherwise(""))).alias("delay")), "SELECT id, nullif(trim(coalesce(delay, '') || ' ' || if(id % 2 = 0, 'ns', '')), '') AS delay FROM stmt")
_add("conn_kinds", lambda d: d["net_conn"].select("id", extract.conn_kind(F.col("outer_net_id").isNotNull(), F.col("outer_hier_ref_id").isNotNull(), F.col("outer_intf_inst_id").isNotNull(), F.col("conn_kind") == "constant", F.col("conn_kind") == "expression_operand").alias("kind")), "SELECT id, CASE WHEN outer_intf_inst_id > 0 THEN 'interface' WHEN conn_kind = 'expression_operand' THEN conn_kind WHEN outer_hier_ref_id > 0 THEN 'external_reference' WHEN outer_net_id > 0 THEN 'signal' WHEN conn_kind = 'constant' THEN conn_kind ELSE 'unconnected' END AS kind FROM net_conn")
_add("outward_records", lambda d: extract.outward(d["hier_ref"].select("stmt_id", F.col("lo").alias("expression"), "access", "id", F.when(F.col("id") % 2 == 0, F.col("path")).alias("canonical"), F.lit(None).cast("string").alias("written"), F.concat(F.lit("h."), "path").alias("hierarchical"))), "SELECT stmt_id, lo AS expression, access, min(id) AS id, min_by(if(id % 2 = 0, path, 'h.' || path), id) AS path FROM hier_ref GROUP BY ALL")
_add("escaped_names", lambda d: d["module"].select("id", F.array_join(resolve.segments(F.concat(F.lit("a.\\"), "name", F.lit(".x [1] . b"))), "|").alias("names")), "SELECT id, 'a|\\' || name || '.x|[1]|b' AS names FROM module")
_add("occurrence_order", lambda d: stamp.path_keys(d["tree_node"].select("id", F.col("parent_node_id").alias("parent"), "ordinal")).select("id", "level", F.sha2("path_key", 256).alias("path_key")))
SQL["occurrence_order"] = _recursive("+k AS (SELECT id, 0 AS level, lpad(CAST(ordinal AS VARCHAR), 12, '0') || ':' || lpad(CAST(id AS VARCHAR), 19, '0') AS key FROM tree_node WHERE parent_node_id IS NULL UNION ALL SELECT t.id, level + 1, key || '/' || lpad(CAST(t.ordinal AS VARCHAR), 12, '0') || ':' || lpad(CAST(t.id AS VARCHAR), 19, '0') FROM k JOIN tree_node t ON t.parent_node_id = k.id) SELECT id, level, sha256(key) AS path_key FROM k")
_add("interned_types", lambda d: filelist.interned(d["prim"].select(F.when(F.col("id") % 9 == 0, "").otherwise(F.col("def_name")).alias("t")), "t"), "SELECT row_number() OVER (ORDER BY text) AS id, text FROM (SELECT DISTINCT def_name AS text FROM prim WHERE id % 9 <> 0)")
_add("linked_files", lambda d: filelist.linked(d["file"].withColumn("path", F.concat(F.lit("/src/"), F.substring_index("path", "/", -1))), d["src_file"]), "SELECT f.id, '/src/' || split_part(f.path, '/', -1) AS path, s.id AS src_file_id FROM file f LEFT JOIN src_file s ON s.path = '/src/' || split_part(f.path, '/', -1)")
_add("merged_meta", lambda d: filelist.merged_meta(d["meta"], d["meta"].where("key in ('top', 'error_count')").withColumn("value", F.lit("7")).unionByName(d["meta"].where("key = 'tool_version'").withColumn("key", F.lit("tool")))), "SELECT key, if(key IN ('top', 'error_count'), '7', value) AS value FROM meta UNION ALL SELECT 'tool', value FROM meta WHERE key = 'tool_version'")

# --- operators on staging rows, closures of all call sites, digests ------------------------------
QUERIES |= elaborated.QUERIES
SQL |= elaborated.SQL
