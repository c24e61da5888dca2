"""SQL for DuckDB of what breaks each rule, written apart from wirespan.operators.verify: rule by rule, mostly with EXISTS."""

from __future__ import annotations

from wirespan.sources import schema

_ROOTS = "('root', 'package')"
_INSTS = "('root', 'instance', 'unresolved', 'package')"
_OWNER = "(SELECT CASE WHEN EXISTS (FROM inst i WHERE i.id = x.scope_node_id) THEN x.scope_node_id ELSE (SELECT max(ancestor) FROM nearest a WHERE a.node = x.scope_node_id) END)"


def _listed(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _id(table: str, where: str, key: str = "id") -> str:
    return f"SELECT CAST(x.{key} AS VARCHAR) AS what FROM {table} x WHERE {where}"


def _each(parts) -> str:
    return " UNION ALL ".join(parts)


def _list(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _named_by(table: str) -> str:
    return {"inst_param": "inst_id", "term_map": "term_id"}.get(table, "id")


_FLAGS = {
    "net": "is_implicit", "term": "is_const", "term_map": "term_exact inner_exact map_exact", "net_conn": "outer_exact term_exact map_exact", "stmt_target": "is_exact", "assign_operand": "is_exact",
    "expr_ref": "is_exact", "net_dep": "src_exact tgt_exact map_exact", "hier_ref": "is_exact",
}
_SPANS = {"term_map": "term inner", "net_conn": "outer term", "net_dep": "src tgt"}


def _spans():
    for t, sides in _SPANS.items():
        for s in sides.split():
            yield t, f"{s}_lo", f"{s}_hi", f"{s}_exact"
    for t in ("stmt_target", "assign_operand", "expr_ref", "hier_ref"):
        yield t, "lo", "hi", "is_exact"


def _width(n: str, lo: str, hi: str, whole: str) -> str:
    return f"CASE WHEN {n}.{lo} IS NULL OR {n}.{hi} IS NULL THEN {whole} ELSE 1 + {n}.{hi} - {n}.{lo} END"


_FROM, _TO, _AT_STMT = "(SELECT n.inst_id FROM net n WHERE n.id = x.src_net_id)", "(SELECT n.inst_id FROM net n WHERE n.id = x.tgt_net_id)", "(SELECT s.inst_id FROM stmt s WHERE s.id = x.stmt_id)"
_SRC = "x.src_net_id IS NULL AND x.src_hier_ref_id IS NULL"
_LEGAL_DEP = """CASE x.dep_kind
 WHEN 'data' THEN x.stmt_id IS NOT NULL AND x.expr_ref_id IS NULL AND x.prim_id IS NULL AND (x.stmt_target_id IS NULL) <> (x.tgt_hier_ref_id IS NULL)
   AND CASE WHEN x.src_net_id IS NULL THEN x.assign_operand_id IS NULL ELSE (x.assign_operand_id IS NULL) <> (x.src_hier_ref_id IS NULL) END
 WHEN 'control' THEN x.stmt_id IS NOT NULL AND NOT (x.src_net_id IS NULL AND x.src_hier_ref_id IS NULL) AND x.assign_operand_id IS NULL AND x.prim_id IS NULL
   AND (x.expr_ref_id IS NULL) <> (x.src_hier_ref_id IS NULL) AND (x.stmt_target_id IS NULL) <> (x.tgt_hier_ref_id IS NULL) AND coalesce(x.map_exact, 9) = 0
 WHEN 'primitive' THEN x.prim_id IS NOT NULL AND coalesce(x.stmt_id, x.stmt_target_id, x.assign_operand_id, x.expr_ref_id, x.src_hier_ref_id, x.tgt_hier_ref_id) IS NULL
 WHEN 'alias' THEN coalesce(x.expr_ref_id, x.prim_id, x.src_hier_ref_id, x.tgt_hier_ref_id) IS NULL AND NOT (x.stmt_id IS NULL OR x.src_net_id IS NULL OR x.stmt_target_id IS NULL OR x.assign_operand_id IS NULL OR x.map_exact IS NULL)
 WHEN 'procedure' THEN coalesce(x.prim_id, x.stmt_target_id, x.assign_operand_id) IS NULL AND NOT (x.src_net_id IS NULL AND x.src_hier_ref_id IS NULL) AND (x.expr_ref_id IS NULL OR x.src_hier_ref_id IS NULL)
 ELSE false END"""
_BLACK_BOX = "EXISTS (FROM term t JOIN tree_node n ON n.id = t.inst_id WHERE t.id = x.term_id AND n.node_kind = 'unresolved')"
_LEGAL_CONN = f"""CASE x.conn_kind
 WHEN 'signal' THEN x.outer_net_id IS NOT NULL AND (x.map_exact IS NOT NULL OR {_BLACK_BOX})
 WHEN 'external_reference' THEN x.outer_net_id IS NULL AND x.outer_hier_ref_id IS NOT NULL AND (x.map_exact IS NOT NULL OR {_BLACK_BOX})
 WHEN 'expression_operand' THEN CASE WHEN x.outer_net_id IS NULL THEN x.outer_hier_ref_id IS NOT NULL ELSE x.outer_hier_ref_id IS NULL AND coalesce(x.map_exact, 0) = 0 END
 WHEN 'interface' THEN x.outer_net_id IS NULL WHEN 'constant' THEN x.outer_net_id IS NULL AND x.map_exact IS NULL WHEN 'unconnected' THEN x.outer_net_id IS NULL AND x.map_exact IS NULL ELSE false END"""
_ROLE = "SELECT CAST(x.id AS VARCHAR) AS what FROM expr_ref x JOIN stmt s ON s.id = x.stmt_id WHERE NOT CASE x.role WHEN 'control' THEN true WHEN 'wait' THEN s.stmt_kind IN ('wait', 'event_control') WHEN 'event' THEN s.stmt_kind = 'event_control' WHEN 'call_argument' THEN s.stmt_kind IN ('call', 'assignment', 'system_task') WHEN 'assertion' THEN s.stmt_kind = x.role WHEN 'system_task' THEN s.stmt_kind = x.role ELSE false END"

# what both sides of a crossing share, counted on the tables
_SHARED = """FROM net_conn c, term t, term_map m WHERE t.id = c.term_id AND m.term_id = c.term_id AND NOT coalesce(c.term_lo > m.term_hi, false) AND NOT coalesce(m.term_lo > c.term_hi, false)
 AND CASE c.conn_kind WHEN 'signal' THEN true WHEN 'constant' THEN true WHEN 'external_reference' THEN {ref} WHEN 'expression_operand' THEN c.outer_net_id IS NOT NULL OR {ref} ELSE false END""".replace("{ref}", "EXISTS (FROM hier_ref h WHERE h.id = c.outer_hier_ref_id AND h.resolved_net_id IS NOT NULL)")
_OUTER = "(c.outer_net_id IS NOT NULL OR EXISTS (FROM hier_ref h WHERE h.id = c.outer_hier_ref_id AND h.resolved_net_id IS NOT NULL))"
_N = "(SELECT count(*) {0})"
_INWARD, _OUTWARD = _N.format(_SHARED + " AND t.direction <> 'output'"), _N.format(_SHARED + f" AND t.direction <> 'input' AND c.conn_kind IN ('signal', 'external_reference') AND {_OUTER}")
_ROOT = "(SELECT count(*) FROM term_map m WHERE EXISTS (FROM term t JOIN tree_node r ON r.id = t.inst_id WHERE t.id = m.term_id AND r.node_kind = 'root' AND t.direction <> '{0}'))"
_TYPES = [("term_id", "term", "terminal_inside actual_outside"), ("stmt_target_id", "stmt_target", "written_by release_target alias_binding"), ("assign_operand_id", "assign_operand", "read_by"), ("expr_ref_id", "expr_ref", "condition statement_read"), ("proc_id", "proc", "event"), ("dep_id", "net_dep", "dep_in dep_out"), ("hier_ref_id", "hier_ref", "named_from_outside")]


def _totals(name: str, *counts: str) -> str:
    first, *rest = counts
    return f"SELECT '{name}' AS what WHERE {first} <> {' + '.join(rest)}"


def _count(of: str) -> str:
    return f"(SELECT count(*) FROM {of})"


_HUNG = "SELECT CAST(v.net_id AS VARCHAR) AS what FROM v_net_attachment v WHERE v.stmt_target_id IS NOT NULL AND (SELECT s.stmt_kind = '{0}' FROM stmt s WHERE s.id = v.stmt_id) <> (v.attachment_kind = '{1}')"
_META = "(SELECT max(value) FROM meta WHERE key = '{0}')"
_COUNTS = "error_count unresolved_count empty_procedure_count duplicate_path_count"

RULE_SQL: dict[str, str] = {
    "K1": _each(f"SELECT '{t}' AS what WHERE NOT EXISTS (FROM {t})" for t in "module tree_node inst net term term_map".split()),
    "K2": "SELECT 'none' AS what WHERE NOT EXISTS (FROM src_file) UNION ALL " + _id("src_file", "coalesce(length(x.digest), 0) <> 64"),
    "K4": _each(_id(t, f"x.{c} IS NOT NULL AND NOT EXISTS (FROM {r} y WHERE y.id = x.{c})", _named_by(t)) for t, c, r in schema.REFERENCES),
    "K5": _each(_id(t, f"NOT coalesce(x.{c} IN {_list(d)}, {str((t, c) in schema.NULLABLE).lower()})", _named_by(t)) for (t, c), d in schema.DOMAINS.items()),
    "K6": _each(_id(t, f"x.{c} <> 0 AND x.{c} <> 1", _named_by(t)) for t, cs in _FLAGS.items() for c in cs.split()),
    "K7": _each(_id(t, f"CASE WHEN x.{lo} IS NULL THEN x.{hi} IS NOT NULL ELSE x.{hi} IS NULL OR x.{hi} < x.{lo} OR x.{e} IS NULL END", _named_by(t)) for t, lo, hi, e in _spans()),
    "K8": _id("tree_node", f"CASE WHEN x.node_kind IN {_ROOTS} THEN x.parent_node_id IS NOT NULL ELSE x.parent_node_id IS NULL END"),
    "K9": _id("tree_node", f"(x.node_kind IN {_INSTS}) <> EXISTS (FROM inst i WHERE i.id = x.id)"),
    "K10": _id("tree_node", "(x.node_kind = 'primitive') <> EXISTS (FROM prim p WHERE p.id = x.id)"),
    "K11": _id("inst", "EXISTS (FROM tree_node n WHERE n.id = x.id AND (n.node_kind = 'unresolved') <> (x.module_id IS NULL))"),
    "K12": _id("inst", "(x.unresolved_def IS NULL OR x.param_signature IS NOT NULL) AND EXISTS (FROM tree_node n WHERE n.id = x.id AND n.node_kind = 'unresolved')"),
    "K13": _id("inst", f"(x.parent_inst_id IS NULL) <> (x.id IN (SELECT n.id FROM tree_node n WHERE n.node_kind IN {_ROOTS}))"),
    "K14": _id("inst", "EXISTS (FROM nearest a WHERE a.node = x.id AND coalesce(a.ancestor, 0) <> coalesce(x.parent_inst_id, 0))"),
    "K15": _id("prim", "EXISTS (FROM nearest a WHERE a.node = x.id AND coalesce(a.ancestor, 0) <> coalesce(x.inst_id, 0))"),
    "K16": _each(f"SELECT CAST(x.id AS VARCHAR) AS what FROM {t} x WHERE {_OWNER} <> x.inst_id" for t in ("net", "proc", "stmt")),
    "K17": _id("tree_node", "x.name LIKE '%.%' AND NOT (x.name[1] = chr(92) AND x.name[-1] = ' ')"),
    "K18": _each(_id(t, "x.file_id IS NOT NULL AND least(x.line, x.col) < 1") for t in "module inst prim net term proc stmt net_conn proc_event hier_ref".split()),
    "K19": f"SELECT 'duplicate_path_count' AS what WHERE (SELECT count(*) - count(DISTINCT (coalesce(parent_node_id, -1), name)) FROM tree_node) IS DISTINCT FROM CAST({_META.format('duplicate_path_count')} AS BIGINT)",
    "K20": _id("inst", "coalesce(x.param_signature, '') <> coalesce((SELECT string_agg(p.name || '=' || p.value, ',' ORDER BY p.ordinal) FROM inst_param p WHERE p.inst_id = x.id), '')"),
    "K21": _id("inst_param", "NOT EXISTS (FROM inst i WHERE i.id = x.inst_id)", "inst_id"),
    "K22": _id("term_map", "(SELECT t.inst_id FROM term t WHERE t.id = x.term_id) <> (SELECT n.inst_id FROM net n WHERE n.id = x.inner_net_id)", "term_id"),
    "K23": _id("net_conn", "(SELECT i.parent_inst_id FROM term t JOIN inst i ON i.id = t.inst_id WHERE t.id = x.term_id) <> (SELECT n.inst_id FROM net n WHERE n.id = x.outer_net_id)"),
    "K24": _each(_id(t, "(SELECT s.inst_id FROM stmt s WHERE s.id = x.stmt_id) <> (SELECT n.inst_id FROM net n WHERE n.id = x.net_id)") for t in ("stmt_target", "assign_operand", "expr_ref")),
    "K25": _id("proc_event", "EXISTS (FROM proc p WHERE p.id = x.proc_id AND (EXISTS (FROM net n WHERE n.id = x.net_id AND n.inst_id <> p.inst_id) OR EXISTS (FROM stmt s WHERE s.id = x.stmt_id AND coalesce(s.proc_id, 0) <> x.proc_id)))"),
    "K26": _id("proc_event", "CASE WHEN x.event_kind = 'sensitivity' THEN x.stmt_id IS NOT NULL ELSE x.stmt_id IS NULL END"),
    "K27": _id("stmt", "CASE WHEN x.stmt_kind = 'assignment' THEN x.assign_kind IS NULL ELSE x.assign_kind IS NOT NULL END"),
    "K28": _id("stmt", "x.stmt_kind = 'release' AND x.construct <> 'release' AND x.construct <> 'deassign'"),
    "K29": _id("stmt", "x.stmt_kind = 'release' AND NOT EXISTS (FROM stmt_target w WHERE w.stmt_id = x.id) AND NOT EXISTS (FROM hier_ref h WHERE h.stmt_id = x.id)"),
    "K30": _id("stmt", "x.stmt_kind = 'release' AND (EXISTS (FROM assign_operand o WHERE o.stmt_id = x.id) OR EXISTS (FROM net_dep d WHERE d.stmt_id = x.id))"),
    "K31": _id("net_dep", "EXISTS (FROM stmt_target w JOIN stmt s ON s.id = w.stmt_id WHERE w.id = x.stmt_target_id AND s.stmt_kind = 'release')"),
    "K32": _id("stmt", "EXISTS (FROM call_site c WHERE c.id = x.call_site_id AND c.inst_id <> x.inst_id)"),
    "K33": _id("net_dep", "(SELECT c.inst_id FROM call_site c WHERE c.id = x.call_site_id) <> (SELECT s.inst_id FROM stmt s WHERE s.id = x.stmt_id)"),
    "K34": _id("net_dep", "x.stmt_id IS NULL AND x.call_site_id IS NOT NULL"),
    "K35": _id("call_site", "CASE WHEN x.depth = 1 THEN x.parent_call_site_id IS NOT NULL ELSE x.parent_call_site_id IS NULL END"),
    "K36": _id("call_site", "EXISTS (FROM call_site p WHERE p.id = x.parent_call_site_id AND (x.depth - p.depth <> 1 OR x.inst_id <> p.inst_id))"),
    "K37": _id("call_site", "(SELECT s.inst_id FROM stmt s WHERE s.id = x.caller_stmt_id) <> x.inst_id"),
    "K38": _id("stmt", "x.proc_id IS NOT NULL AND x.assign_kind = 'continuous'"),
    "K39": _id("stmt", "x.sequence IS NOT NULL AND x.proc_id IS NULL"),
    "K40": _id("stmt", "x.stmt_kind <> 'event_control' AND x.sequence IS NULL AND x.proc_id IS NOT NULL"),
    "K41": _ROLE,
    "K42": _id("net_dep", f"NOT {_LEGAL_DEP}"),
    "K43": _id("net_dep", "EXISTS (FROM hier_ref h WHERE h.id = x.src_hier_ref_id AND coalesce(h.resolved_net_id, -1) <> coalesce(x.src_net_id, -1))"),
    "K44": "SELECT CAST(x.id AS VARCHAR) AS what FROM (SELECT DISTINCT id, stmt_id, unnest([src_hier_ref_id, tgt_hier_ref_id]) AS ref FROM net_dep) x JOIN hier_ref h ON h.id = x.ref WHERE h.stmt_id <> x.stmt_id",
    "K45": _id("net_dep", "EXISTS (FROM hier_ref h WHERE h.id = x.tgt_hier_ref_id AND coalesce(h.resolved_net_id, -1) <> x.tgt_net_id)"),
    "K46": _id("net_dep", f"{_SRC} AND NOT (x.src_lo IS NULL AND x.src_exact IS NULL AND x.map_exact IS NULL)"),
    "K47": _id("net_dep", "EXISTS (FROM assign_operand o WHERE o.id = x.assign_operand_id AND (o.net_id <> x.src_net_id OR o.stmt_id <> x.stmt_id))"),
    "K48": _id("net_dep", "EXISTS (FROM stmt_target w WHERE w.id = x.stmt_target_id AND (w.net_id <> x.tgt_net_id OR w.stmt_id <> x.stmt_id))"),
    "K49": _id("net_dep", "EXISTS (FROM expr_ref e WHERE e.id = x.expr_ref_id AND (e.net_id <> x.src_net_id OR e.stmt_id <> x.stmt_id OR e.role <> CASE x.dep_kind WHEN 'control' THEN 'control' WHEN 'procedure' THEN 'call_argument' ELSE e.role END))"),
    "K50": _id("net_dep", f"x.dep_kind IN ('data', 'control') AND x.src_hier_ref_id IS NULL AND x.tgt_hier_ref_id IS NULL AND {_FROM} + {_TO} + {_AT_STMT} IS NOT NULL AND least({_FROM}, {_TO}, {_AT_STMT}) <> greatest({_FROM}, {_TO}, {_AT_STMT})"),
    "K51": _id("net_dep", "x.dep_kind = 'alias' AND NOT EXISTS (FROM net_dep r WHERE r.dep_kind = 'alias' AND r.stmt_id = x.stmt_id AND r.src_net_id = x.tgt_net_id AND r.tgt_net_id = x.src_net_id)"),
    "K52": _id("net_dep", "x.dep_kind = 'alias' AND x.tgt_net_id = x.src_net_id"),
    "K53": _id("stmt", "x.stmt_kind = 'alias' AND NOT (x.proc_id IS NULL AND coalesce(x.construct, 'alias') = 'alias')"),
    "K54": _id("stmt_target", "EXISTS (FROM stmt s WHERE s.id = x.stmt_id AND s.stmt_kind <> 'release') AND NOT EXISTS (FROM net_dep d WHERE d.stmt_target_id = x.id) AND NOT EXISTS (FROM hier_ref h WHERE h.stmt_id = x.stmt_id AND h.access = 'read')"),
    "K55": f"SELECT CAST(x.term_id AS VARCHAR) AS what FROM term_map x JOIN term t ON t.id = x.term_id JOIN net n ON n.id = x.inner_net_id WHERE x.map_exact = 1 AND {_width('x', 'term_lo', 'term_hi', 't.width')} <> {_width('x', 'inner_lo', 'inner_hi', 'n.width')}",
    "K56": f"SELECT CAST(x.id AS VARCHAR) AS what FROM net_dep x JOIN net a ON a.id = x.src_net_id JOIN net b ON b.id = x.tgt_net_id WHERE x.map_exact * x.src_exact * x.tgt_exact = 1 AND {_width('x', 'src_lo', 'src_hi', 'a.width')} <> {_width('x', 'tgt_lo', 'tgt_hi', 'b.width')}",
    "K57": f"SELECT CAST(x.id AS VARCHAR) AS what FROM net_conn x JOIN term t ON t.id = x.term_id LEFT JOIN net n ON n.id = x.outer_net_id WHERE x.map_exact * x.term_exact * x.outer_exact = 1 AND {_width('x', 'term_lo', 'term_hi', 't.width')} <> {_width('x', 'outer_lo', 'outer_hi', 'n.width')}",
    "K58": _each(_id(t, f"x.map_exact = 1 AND x.term_exact = 1 AND EXISTS (FROM {t} y WHERE y.term_id = x.term_id AND y.map_exact = 1 AND y.term_exact = 1 AND (y.term_lo < x.term_lo OR (y.term_lo = x.term_lo AND y.ordinal < x.ordinal)) AND y.term_hi >= x.term_lo)", "term_id") for t in ("term_map", "net_conn")),
    "K59": _id("hier_ref", "EXISTS (FROM net n WHERE n.id = x.resolved_net_id AND n.inst_id IS DISTINCT FROM x.resolved_inst_id)"),
    "K60": _id("net_conn", "EXISTS (FROM hier_ref h WHERE h.id = x.outer_hier_ref_id AND h.access <> 'connect')"),
    "K61": _id("net_conn", f"NOT {_LEGAL_CONN}"),
    "K62": f"""SELECT k AS what FROM (SELECT unnest(['schema_version', 'analysis_status', 'tool', 'tool_version', 'slang_version', 'producer_revision', 'config_digest', {', '.join(f"'{k}'" for k in _COUNTS.split())}]) AS k) WHERE NOT EXISTS (FROM meta WHERE key = k AND value IS NOT NULL)
 UNION ALL SELECT key FROM meta WHERE (key = 'schema_version' AND value <> '14') OR (key IN {_list(_COUNTS)} AND regexp_replace(value, '[0-9]', '', 'g') || if(value = '', 'x', '') <> '') OR (key = 'analysis_status' AND value <> 'complete' AND value <> 'partial' AND value <> 'hierarchy_only')
 UNION ALL SELECT 'complete' WHERE {_META.format('analysis_status')} = 'complete' AND EXISTS (FROM meta WHERE key IN ('error_count', 'empty_procedure_count', 'duplicate_path_count') AND TRY_CAST(value AS BIGINT) <> 0)""",
    "K63": _each(f"SELECT '{k}' AS what WHERE EXISTS (FROM meta WHERE key = '{k}') AND TRY_CAST({_META.format(k)} AS BIGINT) IS DISTINCT FROM (SELECT {k} FROM v_db_info)" for k in ("schema_version " + _COUNTS).split()),
    "K65": _each(_totals(f"v_{v}", _count(f"v_{v}"), _count(t)) for v, t in [(x, x) for x in "tree_node net term term_map net_conn net_dep stmt stmt_target call_site".split()] + [("stmt_operand", "assign_operand")]),
    "K66": _totals("arcs", _count("arcs"), _N.format(_SHARED)),
    "K67": _totals("v_driver", _count("v_driver"), _count("net_dep"), _INWARD, _OUTWARD, _ROOT.format("output")),
    "K68": _totals("v_load", _count("v_load"), "(SELECT count(src_net_id) FROM net_dep)", _N.format(_SHARED + f" AND t.direction <> 'output' AND {_OUTER}"), _OUTWARD, _ROOT.format("input"), "(SELECT count(net_id) FROM proc_event)", _count("expr_ref e WHERE e.role NOT IN ('control', 'call_argument') OR NOT EXISTS (FROM net_dep d WHERE d.expr_ref_id = e.id)"), _count("assign_operand o WHERE NOT EXISTS (FROM net_dep d WHERE d.assign_operand_id = o.id)")),
    "K69": _totals("v_net_attachment", _count("v_net_attachment"), *map(_count, "term_map stmt_target assign_operand expr_ref net_dep".split()), "(SELECT count(outer_net_id) FROM net_conn)", "(SELECT count(h.resolved_net_id) FROM net_conn c JOIN hier_ref h ON h.id = c.outer_hier_ref_id)", "(SELECT count(net_id) FROM proc_event)", "(SELECT count(src_net_id) FROM net_dep)", "(SELECT count(resolved_net_id) FROM hier_ref)"),
    "K70": _id("v_net_attachment", "x.attachment_kind NOT IN " + _list(" ".join(k for *_, k in _TYPES)), "net_id"),
    "K71": _HUNG.format("release", "release_target"),
    "K72": _HUNG.format("alias", "alias_binding"),
    "K73": _id("v_net_attachment", "len(list_filter([" + ", ".join(f"x.{c}" for c, _, _ in _TYPES) + "], lambda y: y IS NOT NULL)) <> 1", "net_id"),
    "K74": _each(_id("v_net_attachment", f"CASE WHEN x.attachment_kind IN {_list(k)} THEN x.{c} IS NULL ELSE x.{c} IS NOT NULL END", "net_id") for c, _, k in _TYPES),
    "K75": _each(_id("v_net_attachment", f"x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT id FROM {t})", "net_id") for c, t, _ in _TYPES),
    "K76": _id("v_driver", f"x.driver_net_id IS NOT NULL AND x.driver_kind IN {_listed(schema.NETLESS_DRIVERS)}", "signal_net_id"),
    "K77": _id("v_driver", "x.driver_net_id IS NULL AND x.driver_kind IN ('data', 'control', 'alias', 'connection', 'connection_expression')", "signal_net_id"),
    "K78": "SELECT CAST(v.dep_id AS VARCHAR) AS what FROM v_driver v WHERE v.driver_kind = 'external' AND EXISTS (FROM net_dep d, hier_ref h WHERE d.id = v.dep_id AND h.id = d.src_hier_ref_id AND NOT (v.driver_name IS NULL AND h.resolved_net_id IS NULL))",
    "K79": _totals("external", _count("v_driver WHERE driver_kind = 'external'"), _count("net_dep WHERE src_hier_ref_id IS NOT NULL AND src_net_id IS NULL")),
    "K80": _id("v_driver", f"x.driver_kind IN {_listed(schema.BARE_DRIVERS)} AND NOT (x.driver_name IS NULL AND coalesce(x.driver_lo, x.driver_hi, x.driver_exact, x.map_exact) IS NULL)", "signal_net_id"),
    "K81": _id("v_load", "x.load_net_id IS NULL AND NOT (x.load_name IS NULL AND coalesce(x.load_lo, x.load_hi, x.load_exact, x.map_exact) IS NULL)", "signal_net_id"),
    "K82": _id("v_driver", "CASE WHEN x.driver_kind = 'terminal' THEN x.term_id IS NULL ELSE x.term_id IS NOT NULL END", "signal_net_id"),
    "K83": _id("v_load", f"CASE WHEN x.load_kind IN {_listed(schema.NETLESS_LOADS)} THEN x.load_net_id IS NOT NULL ELSE x.load_net_id IS NULL END", "signal_net_id"),
    "K84": _id("v_load", "CASE WHEN x.load_kind = 'terminal' THEN x.term_id IS NULL ELSE x.term_id IS NOT NULL END", "signal_net_id"),
    "K85": _id("v_driver", "x.driver_kind NOT IN ('data', 'control', 'primitive', 'procedure', 'connection', 'connection_expression', 'constant', 'terminal', 'system_task', 'alias', 'external')", "signal_net_id") + " UNION ALL " + _id("v_load", "x.load_kind NOT IN ('dataflow', 'connection', 'sensitivity', 'wait', 'statement', 'terminal', 'alias')", "signal_net_id"),
    "K87": _id("file", "x.src_file_id IS NULL"),
}
