"""The rules a design must meet.

A rule is a condition of a broken row, over a frame: a table, a view, or a join of some (FRAMES). All rules of a frame
are judged in one pass over it: each row gives the names of the rules it breaks. References (K4) are one anti join of all
references of all tables with all ids. Rules about counts compare totals. A condition that is null breaks nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions.tables import written
from wirespan.operators import closure, views
from wirespan.sources import schema

WINDOWS = [
    ("term_map", "term_lo", "term_hi", "term_exact"), ("term_map", "inner_lo", "inner_hi", "inner_exact"), ("net_conn", "outer_lo", "outer_hi", "outer_exact"), ("net_conn", "term_lo", "term_hi", "term_exact"),
    ("stmt_target", "lo", "hi", "is_exact"), ("assign_operand", "lo", "hi", "is_exact"), ("expr_ref", "lo", "hi", "is_exact"), ("net_dep", "src_lo", "src_hi", "src_exact"), ("net_dep", "tgt_lo", "tgt_hi", "tgt_exact"), ("hier_ref", "lo", "hi", "is_exact"),
]
BOOLEANS = [
    ("net", "is_implicit"), ("term", "is_const"), ("term_map", "term_exact"), ("term_map", "inner_exact"), ("term_map", "map_exact"), ("net_conn", "outer_exact"), ("net_conn", "term_exact"), ("net_conn", "map_exact"),
    ("stmt_target", "is_exact"), ("assign_operand", "is_exact"), ("expr_ref", "is_exact"), ("net_dep", "src_exact"), ("net_dep", "tgt_exact"), ("net_dep", "map_exact"), ("hier_ref", "is_exact"),
]
LOCATED = ("module", "inst", "prim", "net", "term", "net_conn", "proc", "stmt", "proc_event", "hier_ref")
REQUIRED = "schema_version analysis_status error_count unresolved_count empty_procedure_count duplicate_path_count tool tool_version slang_version producer_revision config_digest".split()
NUMBERS = "error_count unresolved_count empty_procedure_count duplicate_path_count".split()
STATUSES = "complete partial hierarchy_only".split()

#: Joins that rules are judged on: id (what a broken row is named by) and the columns the conditions read.
FRAMES = {
    "node": """SELECT n.id, n.node_kind AS kind, n.parent_node_id AS parent, i.id AS inst, p.id AS prim, i.module_id, i.unresolved_def, i.param_signature, i.parent_inst_id, p.inst_id AS prim_inst, a.ancestor
  FROM {tree_node} n LEFT JOIN {inst} i ON i.id = n.id LEFT JOIN {prim} p ON p.id = n.id LEFT JOIN {nearest} a ON a.node = n.id""",
    "occurrence": "SELECT i.id, i.parent_inst_id, coalesce(i.param_signature, '') AS given, n.node_kind AS kind, coalesce(s.signature, '') AS signature FROM {inst} i LEFT JOIN {tree_node} n ON n.id = i.id LEFT JOIN {signatures} s ON s.inst_id = i.id",
    "scoped": "SELECT x.id, x.inst_id, CASE WHEN i.id IS NOT NULL THEN i.id ELSE a.ancestor END AS owner FROM (SELECT id, scope_node_id, inst_id FROM {net} UNION ALL SELECT id, scope_node_id, inst_id FROM {proc} UNION ALL SELECT id, scope_node_id, inst_id FROM {stmt}) x LEFT JOIN {inst} i ON i.id = x.scope_node_id LEFT JOIN {nearest} a ON a.node = x.scope_node_id",
    "free_param": "SELECT p.inst_id AS id, i.id AS inst FROM {inst_param} p LEFT JOIN {inst} i ON i.id = p.inst_id",
    "mapped": "SELECT m.term_id AS id, m.map_exact, t.inst_id AS term_inst, n.inst_id AS net_inst, coalesce(m.term_hi - m.term_lo + 1, t.width) AS term_size, coalesce(m.inner_hi - m.inner_lo + 1, n.width) AS net_size FROM {term_map} m JOIN {term} t ON t.id = m.term_id JOIN {net} n ON n.id = m.inner_net_id",
    "connected": """SELECT c.id, c.conn_kind AS kind, c.outer_net_id AS net, c.outer_hier_ref_id AS ref, c.map_exact, c.term_exact, c.outer_exact, i.parent_inst_id AS above, n.inst_id AS net_inst, h.access, w.node_kind = 'unresolved' AS black_box,
    coalesce(c.term_hi - c.term_lo + 1, t.width) AS term_size, coalesce(c.outer_hi - c.outer_lo + 1, n.width) AS net_size
  FROM {net_conn} c LEFT JOIN {term} t ON t.id = c.term_id LEFT JOIN {inst} i ON i.id = t.inst_id LEFT JOIN {tree_node} w ON w.id = t.inst_id LEFT JOIN {net} n ON n.id = c.outer_net_id LEFT JOIN {hier_ref} h ON h.id = c.outer_hier_ref_id""",
    "touched": "SELECT x.id, x.role, s.stmt_kind AS kind, s.inst_id AS stmt_inst, n.inst_id AS net_inst FROM (SELECT id, stmt_id, net_id, CAST(NULL AS STRING) AS role FROM {stmt_target} UNION ALL SELECT id, stmt_id, net_id, NULL FROM {assign_operand} UNION ALL SELECT id, stmt_id, net_id, role FROM {expr_ref}) x JOIN {stmt} s ON s.id = x.stmt_id LEFT JOIN {net} n ON n.id = x.net_id",
    "event": "SELECT e.id, e.proc_id, p.inst_id AS proc_inst, n.inst_id AS net_inst, s.id AS stmt, s.proc_id AS stmt_proc FROM {proc_event} e JOIN {proc} p ON p.id = e.proc_id LEFT JOIN {net} n ON n.id = e.net_id LEFT JOIN {stmt} s ON s.id = e.stmt_id",
    "release": """SELECT s.id, t.s IS NOT NULL AS targets, h.s IS NOT NULL AS refs, o.s IS NOT NULL OR d.s IS NOT NULL AS works FROM (SELECT id FROM {stmt} WHERE stmt_kind = 'release') s LEFT JOIN (SELECT DISTINCT stmt_id AS s FROM {stmt_target}) t ON t.s = s.id
  LEFT JOIN (SELECT DISTINCT stmt_id AS s FROM {hier_ref}) h ON h.s = s.id LEFT JOIN (SELECT DISTINCT stmt_id AS s FROM {assign_operand}) o ON o.s = s.id LEFT JOIN (SELECT DISTINCT stmt_id AS s FROM {net_dep}) d ON d.s = s.id""",
    "sited": "SELECT s.id, s.inst_id AS own, c.inst_id AS site FROM {stmt} s JOIN {call_site} c ON c.id = s.call_site_id",
    "sited_dep": "SELECT d.id, s.inst_id AS own, c.inst_id AS site FROM {net_dep} d JOIN {call_site} c ON c.id = d.call_site_id JOIN {stmt} s ON s.id = d.stmt_id",
    "nested": "SELECT c.id, c.depth, c.inst_id, p.id AS parent, p.depth AS parent_depth, p.inst_id AS parent_inst, s.inst_id AS caller_inst FROM {call_site} c LEFT JOIN {call_site} p ON p.id = c.parent_call_site_id LEFT JOIN {stmt} s ON s.id = c.caller_stmt_id",
    "dep_from": "SELECT d.id, d.src_net_id AS net, d.stmt_id AS stmt, h.resolved_net_id AS ref_net, h.stmt_id AS ref_stmt FROM {net_dep} d JOIN {hier_ref} h ON h.id = d.src_hier_ref_id",
    "dep_to": "SELECT d.id, d.tgt_net_id AS net, d.stmt_id AS stmt, h.resolved_net_id AS ref_net, h.stmt_id AS ref_stmt, d.src_hier_ref_id IS DISTINCT FROM d.tgt_hier_ref_id AS other FROM {net_dep} d JOIN {hier_ref} h ON h.id = d.tgt_hier_ref_id",
    "dep_operand": "SELECT d.id, d.src_net_id AS net, d.stmt_id AS stmt, o.net_id AS own_net, o.stmt_id AS own_stmt FROM {net_dep} d JOIN {assign_operand} o ON o.id = d.assign_operand_id",
    "dep_target": "SELECT d.id, d.tgt_net_id AS net, d.stmt_id AS stmt, w.net_id AS own_net, w.stmt_id AS own_stmt, s.stmt_kind AS kind FROM {net_dep} d JOIN {stmt_target} w ON w.id = d.stmt_target_id LEFT JOIN {stmt} s ON s.id = w.stmt_id",
    "dep_expr": "SELECT d.id, d.dep_kind AS kind, d.src_net_id AS net, d.stmt_id AS stmt, e.net_id AS own_net, e.stmt_id AS own_stmt, e.role FROM {net_dep} d JOIN {expr_ref} e ON e.id = d.expr_ref_id",
    "dep_ends": """SELECT d.id, d.dep_kind AS kind, d.src_hier_ref_id IS NULL AND d.tgt_hier_ref_id IS NULL AS local, d.map_exact, d.src_exact, d.tgt_exact, a.inst_id AS src_inst, b.inst_id AS tgt_inst, s.inst_id AS own,
    coalesce(d.src_hi - d.src_lo + 1, a.width) AS src_size, coalesce(d.tgt_hi - d.tgt_lo + 1, b.width) AS tgt_size FROM {net_dep} d JOIN {net} a ON a.id = d.src_net_id JOIN {net} b ON b.id = d.tgt_net_id LEFT JOIN {stmt} s ON s.id = d.stmt_id""",
    "alias": "SELECT d.id FROM {net_dep} d LEFT ANTI JOIN (SELECT stmt_id, src_net_id, tgt_net_id FROM {net_dep} WHERE dep_kind = 'alias') r ON r.stmt_id = d.stmt_id AND r.src_net_id = d.tgt_net_id AND r.tgt_net_id = d.src_net_id WHERE d.dep_kind = 'alias'",
    "idle_target": "SELECT w.id FROM {stmt_target} w JOIN {stmt} s ON s.id = w.stmt_id LEFT ANTI JOIN {net_dep} d ON d.stmt_target_id = w.id LEFT ANTI JOIN (SELECT stmt_id FROM {hier_ref} WHERE access = 'read') h ON h.stmt_id = w.stmt_id WHERE s.stmt_kind <> 'release'",
    "segment": """SELECT term_id AS id, term_lo, max(term_hi) OVER (PARTITION BY side, term_id ORDER BY term_lo, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT 0 AS side, term_id, ordinal, term_lo, term_hi, map_exact, term_exact FROM {term_map} UNION ALL SELECT 1, term_id, ordinal, term_lo, term_hi, map_exact, term_exact FROM {net_conn}) x WHERE map_exact = 1 AND term_exact = 1 AND term_lo IS NOT NULL""",
    "reference": "SELECT h.id, h.resolved_inst_id AS inst, n.inst_id AS net_inst FROM {hier_ref} h JOIN {net} n ON n.id = h.resolved_net_id",
    "hung": "SELECT v.net_id AS id, v.attachment_kind AS kind, s.stmt_kind FROM {v_net_attachment} v JOIN {stmt} s ON s.id = v.stmt_id WHERE v.stmt_target_id IS NOT NULL",
    "external": "SELECT v.dep_id AS id, v.driver_name, h.resolved_net_id FROM {v_driver} v JOIN {net_dep} d ON d.id = v.dep_id JOIN {hier_ref} h ON h.id = d.src_hier_ref_id WHERE v.driver_kind = 'external'",
}

#: Of an attachment, the one id that is set, by its kind, and the table it names.
TYPED = {
    "term_id": ("term", "terminal_inside actual_outside"), "stmt_target_id": ("stmt_target", "written_by release_target alias_binding"), "assign_operand_id": ("assign_operand", "read_by"), "expr_ref_id": ("expr_ref", "condition statement_read"),
    "proc_id": ("proc", "event"), "dep_id": ("net_dep", "dep_in dep_out"), "hier_ref_id": ("hier_ref", "named_from_outside"),
}


def _words(words: str | Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in (words.split() if isinstance(words, str) else words))


def _set(*columns: str) -> str:
    return " OR ".join(f"{c} IS NOT NULL" for c in columns)


def _none(*columns: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


#: (rule, frame, condition of a broken row)
ROW_RULES: list[tuple[str, str, str]] = [
    ("K2", "src_file", "digest IS NULL OR length(digest) <> 64"),
    *(("K5", t, f"{c} NOT IN ({_words(d)})" + ("" if (t, c) in schema.NULLABLE else f" OR {c} IS NULL")) for (t, c), d in schema.DOMAINS.items()),
    *(("K6", t, f"{c} NOT IN (0, 1)") for t, c in BOOLEANS),
    *(("K7", t, f"({lo} IS NULL) <> ({hi} IS NULL) OR {lo} > {hi} OR ({lo} IS NOT NULL AND {e} IS NULL)") for t, lo, hi, e in WINDOWS),
    ("K8", "node", "(parent IS NULL) <> (kind IN ('root', 'package'))"),
    ("K9", "node", "(kind IN ('root', 'instance', 'unresolved', 'package')) <> (inst IS NOT NULL)"),
    ("K10", "node", "(kind = 'primitive') <> (prim IS NOT NULL)"),
    ("K11", "node", "inst IS NOT NULL AND (kind = 'unresolved') <> (module_id IS NULL)"),
    ("K12", "node", "inst IS NOT NULL AND kind = 'unresolved' AND (unresolved_def IS NULL OR param_signature IS NOT NULL)"),
    ("K13", "occurrence", "(parent_inst_id IS NULL) <> coalesce(kind IN ('root', 'package'), false)"),
    ("K14", "node", "inst IS NOT NULL AND parent_inst_id IS DISTINCT FROM ancestor"),
    ("K15", "node", "prim IS NOT NULL AND prim_inst IS DISTINCT FROM ancestor"),
    ("K16", "scoped", "owner <> inst_id"),
    ("K17", "tree_node", "contains(name, '.') AND NOT (startswith(name, chr(92)) AND endswith(name, ' '))"),
    *(("K18", t, "file_id IS NOT NULL AND (line < 1 OR col < 1)") for t in LOCATED),
    ("K20", "occurrence", "given <> signature"),
    ("K21", "free_param", "inst IS NULL"),
    ("K22", "mapped", "term_inst <> net_inst"),
    ("K23", "connected", "net_inst <> above"),
    ("K24", "touched", "stmt_inst <> net_inst"),
    ("K25", "event", "net_inst <> proc_inst OR (stmt IS NOT NULL AND stmt_proc IS DISTINCT FROM proc_id)"),
    ("K26", "proc_event", "(event_kind = 'sensitivity') <> (stmt_id IS NULL)"),
    ("K27", "stmt", "(stmt_kind = 'assignment') <> (assign_kind IS NOT NULL)"),
    ("K28", "stmt", "stmt_kind = 'release' AND construct NOT IN ('release', 'deassign')"),
    ("K29", "release", "NOT targets AND NOT refs"),
    ("K30", "release", "works"),
    ("K31", "dep_target", "kind = 'release'"),
    ("K32", "sited", "own <> site"),
    ("K33", "sited_dep", "own <> site"),
    ("K34", "net_dep", "call_site_id IS NOT NULL AND stmt_id IS NULL"),
    ("K35", "call_site", "(parent_call_site_id IS NULL) <> (depth = 1)"),
    ("K36", "nested", "parent IS NOT NULL AND (depth <> parent_depth + 1 OR inst_id <> parent_inst)"),
    ("K37", "nested", "caller_inst <> inst_id"),
    ("K38", "stmt", "assign_kind = 'continuous' AND proc_id IS NOT NULL"),
    ("K39", "stmt", "proc_id IS NULL AND sequence IS NOT NULL"),
    ("K40", "stmt", "proc_id IS NOT NULL AND sequence IS NULL AND stmt_kind <> 'event_control'"),
    ("K41", "touched", "(role = 'assertion' AND kind <> 'assertion') OR (role = 'wait' AND kind NOT IN ('wait', 'event_control')) OR (role = 'event' AND kind <> 'event_control') OR (role = 'system_task' AND kind <> 'system_task')"),
    ("K41", "touched", "(role = 'call_argument' AND kind NOT IN ('call', 'assignment', 'system_task')) OR role NOT IN ('control', 'assertion', 'wait', 'event', 'system_task', 'call_argument')"),
    # provenance, kind by kind: what must be there, what must not, and of two ways to name an end exactly one
    ("K42", "net_dep", f"dep_kind = 'data' AND ({_none('stmt_id')} OR {_set('expr_ref_id', 'prim_id')} OR (stmt_target_id IS NULL) = (tgt_hier_ref_id IS NULL) OR (src_net_id IS NULL AND assign_operand_id IS NOT NULL) OR (src_net_id IS NOT NULL AND (assign_operand_id IS NULL) = (src_hier_ref_id IS NULL)))"),
    ("K42", "net_dep", f"dep_kind = 'control' AND ({_none('stmt_id')} OR coalesce(src_net_id, src_hier_ref_id) IS NULL OR {_set('assign_operand_id', 'prim_id')} OR (expr_ref_id IS NULL) = (src_hier_ref_id IS NULL) OR (stmt_target_id IS NULL) = (tgt_hier_ref_id IS NULL) OR map_exact IS DISTINCT FROM 0)"),
    ("K42", "net_dep", f"dep_kind = 'primitive' AND ({_none('prim_id')} OR {_set('stmt_id', 'stmt_target_id', 'assign_operand_id', 'expr_ref_id', 'src_hier_ref_id', 'tgt_hier_ref_id')})"),
    ("K42", "net_dep", f"dep_kind = 'alias' AND ({_none('stmt_id', 'src_net_id', 'stmt_target_id', 'assign_operand_id', 'map_exact')} OR {_set('expr_ref_id', 'prim_id', 'src_hier_ref_id', 'tgt_hier_ref_id')})"),
    ("K42", "net_dep", f"dep_kind = 'procedure' AND ({_set('prim_id', 'stmt_target_id', 'assign_operand_id')} OR coalesce(src_net_id, src_hier_ref_id) IS NULL OR (expr_ref_id IS NOT NULL AND src_hier_ref_id IS NOT NULL))"),
    ("K42", "net_dep", "dep_kind NOT IN ('data', 'control', 'primitive', 'alias', 'procedure')"),
    ("K43", "dep_from", "ref_net IS DISTINCT FROM net"),
    ("K44", "dep_from", "ref_stmt <> stmt"),
    ("K44", "dep_to", "other AND ref_stmt <> stmt"),
    ("K45", "dep_to", "ref_net IS NULL OR ref_net <> net"),
    ("K46", "net_dep", f"coalesce(src_net_id, src_hier_ref_id) IS NULL AND ({_set('src_lo', 'src_exact', 'map_exact')})"),
    ("K47", "dep_operand", "own_net <> net OR own_stmt <> stmt"),
    ("K48", "dep_target", "own_net <> net OR own_stmt <> stmt"),
    ("K49", "dep_expr", "own_net <> net OR own_stmt <> stmt OR (kind = 'control' AND role <> 'control') OR (kind = 'procedure' AND role <> 'call_argument')"),
    ("K50", "dep_ends", "kind IN ('data', 'control') AND local AND (src_inst <> own OR tgt_inst <> own)"),
    ("K51", "alias", "true"),
    ("K52", "net_dep", "dep_kind = 'alias' AND src_net_id = tgt_net_id"),
    ("K53", "stmt", "stmt_kind = 'alias' AND (proc_id IS NOT NULL OR construct <> 'alias')"),
    ("K54", "idle_target", "true"),
    ("K55", "mapped", "map_exact = 1 AND term_size <> net_size"),
    ("K56", "dep_ends", "map_exact = 1 AND src_exact = 1 AND tgt_exact = 1 AND src_size <> tgt_size"),
    ("K57", "connected", "map_exact = 1 AND term_exact = 1 AND outer_exact = 1 AND term_size <> net_size"),
    ("K58", "segment", "reach >= term_lo"),
    ("K59", "reference", "inst IS NULL OR inst <> net_inst"),
    ("K60", "connected", "access <> 'connect'"),
    ("K61", "connected", "kind IN ('constant', 'unconnected') AND (net IS NOT NULL OR map_exact IS NOT NULL)"),
    ("K61", "connected", "kind = 'signal' AND (net IS NULL OR (map_exact IS NULL AND NOT coalesce(black_box, false)))"),
    ("K61", "connected", "kind = 'external_reference' AND (net IS NOT NULL OR ref IS NULL OR (map_exact IS NULL AND NOT coalesce(black_box, false)))"),
    ("K61", "connected", "kind = 'expression_operand' AND ((net IS NULL) = (ref IS NULL) OR (net IS NOT NULL AND map_exact <> 0))"),
    ("K61", "connected", "kind = 'interface' AND net IS NOT NULL"),
    ("K61", "connected", "kind NOT IN ('signal', 'expression_operand', 'constant', 'unconnected', 'interface', 'external_reference')"),
    ("K70", "v_net_attachment", f"attachment_kind NOT IN ({_words(schema.ATTACHMENT_KINDS)})"),
    ("K71", "hung", "(stmt_kind = 'release') <> (kind = 'release_target')"),
    ("K72", "hung", "(stmt_kind = 'alias') <> (kind = 'alias_binding')"),
    ("K73", "v_net_attachment", f"size(filter(array({', '.join(TYPED)}), x -> x IS NOT NULL)) <> 1"),
    *(("K74", "v_net_attachment", f"({c} IS NOT NULL) <> (attachment_kind IN ({_words(kinds)}))") for c, (_, kinds) in TYPED.items()),
    ("K76", "v_driver", f"driver_kind IN ({_words(schema.NETLESS_DRIVERS)}) AND driver_net_id IS NOT NULL"),
    ("K77", "v_driver", f"driver_net_id IS NULL AND driver_kind NOT IN ({_words(schema.NETLESS_DRIVERS)}, 'primitive', 'procedure')"),
    ("K78", "external", "driver_name IS NOT NULL OR resolved_net_id IS NOT NULL"),
    ("K80", "v_driver", f"driver_kind IN ({_words(schema.BARE_DRIVERS)}) AND ({_set('driver_name', 'driver_lo', 'driver_hi', 'driver_exact', 'map_exact')})"),
    ("K81", "v_load", f"load_net_id IS NULL AND ({_set('load_name', 'load_lo', 'load_hi', 'load_exact', 'map_exact')})"),
    ("K82", "v_driver", "(driver_kind = 'terminal') <> (term_id IS NOT NULL)"),
    ("K83", "v_load", f"(load_kind IN ({_words(schema.NETLESS_LOADS)})) <> (load_net_id IS NULL)"),
    ("K84", "v_load", "(load_kind = 'terminal') <> (term_id IS NOT NULL)"),
    ("K85", "v_driver", f"driver_kind NOT IN ({_words(schema.DRIVER_KINDS)})"),
    ("K85", "v_load", f"load_kind NOT IN ({_words(schema.LOAD_KINDS)})"),
    ("K87", "file", "src_file_id IS NULL"),
]

#: What a row of these is named by, if not by its id.
KEYS = {"inst_param": "inst_id", "term_map": "term_id", "v_net_attachment": "net_id", "v_driver": "signal_net_id", "v_load": "signal_net_id"}

_MET = """{net_conn} c JOIN {term} t ON t.id = c.term_id JOIN {term_map} m ON m.term_id = c.term_id LEFT JOIN {hier_ref} h ON h.id = c.outer_hier_ref_id
  WHERE (c.conn_kind IN ('signal', 'constant') OR (c.conn_kind = 'external_reference' AND h.resolved_net_id IS NOT NULL) OR (c.conn_kind = 'expression_operand' AND coalesce(c.outer_net_id, h.resolved_net_id) IS NOT NULL))
  AND coalesce(c.term_lo <= m.term_hi, true) AND coalesce(m.term_lo <= c.term_hi, true)"""
_IN = _MET + " AND t.direction IN ('input', 'inout', 'ref')"
_OUT = _MET + " AND t.direction IN ('output', 'inout', 'ref') AND c.conn_kind IN ('signal', 'external_reference') AND coalesce(c.outer_net_id, h.resolved_net_id) IS NOT NULL"
_PINS = "{{term_map}} m JOIN {{term}} t ON t.id = m.term_id JOIN {{tree_node}} r ON r.id = t.inst_id WHERE r.node_kind = 'root' AND t.direction IN ('{0}', 'inout', 'ref')"
_NO_DEP = "SELECT DISTINCT {0} AS e FROM {{net_dep}} WHERE {0} IS NOT NULL"
#: (rule, name): what the name's rows must be as many as, each side a list of FROM clauses.
TOTALS: dict[tuple[str, str], tuple[list[str], list[str]]] = {
    **{("K65", f"v_{v}"): ([f"{{v_{v}}}"], [f"{{{t}}}"]) for v, t in {"tree_node": "tree_node", "net": "net", "term": "term", "term_map": "term_map", "net_conn": "net_conn", "net_dep": "net_dep", "stmt": "stmt", "stmt_target": "stmt_target", "stmt_operand": "assign_operand", "call_site": "call_site"}.items()},
    ("K66", "arcs"): (["{arcs}"], [_MET]),
    ("K67", "v_driver"): (["{v_driver}"], ["{net_dep}", _IN, _OUT, _PINS.format("input")]),
    ("K68", "v_load"): (["{v_load}"], [
        "{net_dep} WHERE src_net_id IS NOT NULL", _IN + " AND coalesce(c.outer_net_id, h.resolved_net_id) IS NOT NULL", _OUT, _PINS.format("output"), "{proc_event} WHERE net_id IS NOT NULL",
        f"{{expr_ref}} x LEFT JOIN ({_NO_DEP.format('expr_ref_id')}) d ON d.e = x.id WHERE x.role IN ('assertion', 'wait', 'event', 'system_task') OR d.e IS NULL",
        f"{{assign_operand}} x LEFT ANTI JOIN ({_NO_DEP.format('assign_operand_id')}) d ON d.e = x.id"]),
    ("K69", "v_net_attachment"): (["{v_net_attachment}"], [
        "{term_map}", "{net_conn} WHERE outer_net_id IS NOT NULL", "{net_conn} c JOIN {hier_ref} h ON h.id = c.outer_hier_ref_id WHERE h.resolved_net_id IS NOT NULL", "{stmt_target}", "{assign_operand}", "{expr_ref}",
        "{proc_event} WHERE net_id IS NOT NULL", "{net_dep}", "{net_dep} WHERE src_net_id IS NOT NULL", "{hier_ref} WHERE resolved_net_id IS NOT NULL"]),
    ("K79", "external"): (["{v_driver} WHERE driver_kind = 'external'"], ["{net_dep} WHERE src_net_id IS NULL AND src_hier_ref_id IS NOT NULL"]),
}
FILLED = ("module", "tree_node", "inst", "net", "term", "term_map")

_WANTED = "SELECT explode(array({0})) AS k"
#: rule -> SELECT of what breaks it, for rules on few rows or on totals of one table
WHOLE = {
    "K1": "\nUNION ALL ".join(f"SELECT '{t}' AS what FROM {{{t}}} HAVING count(*) = 0" for t in FILLED),
    "K2": "SELECT 'none' AS what FROM {src_file} HAVING count(*) = 0",
    "K19": "SELECT 'duplicate_path_count' AS what FROM (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM {tree_node} GROUP BY parent_node_id, name)) a CROSS JOIN (SELECT max(try_cast(value AS BIGINT)) AS m FROM {meta} WHERE key = 'duplicate_path_count') b WHERE n IS DISTINCT FROM m",
    "K62": f"""SELECT k AS what FROM ({_WANTED.format(_words(REQUIRED))}) w LEFT JOIN {{meta}} m ON m.key = w.k WHERE m.value IS NULL OR (k = 'schema_version' AND value <> '{schema.VERSION}') OR (k IN ({_words(NUMBERS)}) AND NOT value RLIKE '^[0-9]+$') OR (k = 'analysis_status' AND value NOT IN ({_words(STATUSES)}))
UNION ALL SELECT 'complete' AS what FROM {{meta}} HAVING max(CASE WHEN key = 'analysis_status' THEN value END) = 'complete' AND max(CASE WHEN key IN ('error_count', 'empty_procedure_count', 'duplicate_path_count') THEN try_cast(value AS BIGINT) END) > 0""",
    "K63": "SELECT m.key AS what FROM {v_db_info} v CROSS JOIN (SELECT key, value FROM {meta} WHERE key IN ('schema_version', " + _words(NUMBERS) + ")) m WHERE try_cast(m.value AS BIGINT) IS DISTINCT FROM CASE m.key " + " ".join(f"WHEN '{k}' THEN v.{k}" for k in ["schema_version", *NUMBERS]) + " END",
    "K75": "\nUNION ALL ".join(f"SELECT CAST(x.net_id AS STRING) AS what FROM {{v_net_attachment}} x LEFT ANTI JOIN {{{t}}} y ON y.id = x.{c} WHERE x.{c} IS NOT NULL" for c, (t, _) in TYPED.items()),
}

RULES = sorted({r for r, _, _ in ROW_RULES} | {r for r, _ in TOTALS} | set(WHOLE) | {"K4"}, key=lambda r: int(r[1:]))


def signatures(params: DataFrame) -> DataFrame:
    """(inst_id, signature): name=value of each parameter, by ordinal, between commas."""
    entry = F.struct("ordinal", F.concat("name", F.lit("="), "value").alias("text"))
    return params.groupBy("inst_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ",").alias("signature"))


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def dangling(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, what) of references to ids that are not there: all references of a table in one scan. Each id that is referred to is looked up once, however many
    rows name it (a file, a type): references are made distinct where they are read, before one anti join; only those of missing ids are traced back to rows."""

    def of(table: str) -> DataFrame:
        own = [(c, r) for t, c, r in schema.REFERENCES if t == table]
        ends = F.array(*(F.struct(F.lit(r).alias("table"), F.col(c).alias("id")) for c, r in own))
        return tables[table].select(F.col(KEYS.get(table, "id")).cast("string").alias("what"), F.explode(ends).alias("e")).select("what", "e.table", "e.id").where("id is not null")

    asked = reduce(DataFrame.unionByName, [of(t) for t in dict.fromkeys(t for t, _, _ in schema.REFERENCES)])
    ids = reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("table"), "id") for t in dict.fromkeys(r for _, _, r in schema.REFERENCES)])
    missing = written(asked.select("table", "id").distinct().join(ids, ["table", "id"], "left_anti"))
    return asked.join(missing, ["table", "id"], "left_semi").select(F.lit("K4").alias("rule"), "what")


def violations(spark: SparkSession, tables: Mapping[str, DataFrame], rules: list[str] | None = None) -> DataFrame:
    """(rule, what) for all that breaks the rules. A view that several of them read is made once, as a table."""
    wanted = set(rules or RULES)
    by_frame: dict[str, list[tuple[str, str]]] = {}
    for rule, frame, broken in ROW_RULES:
        if rule in wanted:
            by_frame.setdefault(frame, []).append((rule, broken))
    totals = {k: v for k, v in TOTALS.items() if k[0] in wanted}
    whole = {r: q for r, q in WHOLE.items() if r in wanted}
    uses = Counter(n for text in (*(FRAMES.get(f, f"{{{f}}}") for f in by_frame), *whole.values(), *(x for sides in totals.values() for side in sides for x in side)) for n in re.findall(r"\{(\w+)\}", text))
    made: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in made:
            if name == "nearest":
                made[name] = closure.nearest(tables["tree_node"].select("id", F.col("parent_node_id").alias("parent")), tables["inst"])
            elif name == "arcs":
                made[name] = views.conn_arc(tables)
            elif name == "signatures":
                made[name] = signatures(tables["inst_param"])
            else:
                made[name] = views.VIEWS[name](tables) if name in views.VIEWS else tables[name]
            if uses[name] > 1 and name not in schema.TABLES:
                made[name] = written(made[name])
        return made[name]

    def sql(text: str) -> DataFrame:
        return spark.sql(text, **{n: frame(n) for n in _names(text)})

    def judged(name: str, conditions: list[tuple[str, str]]) -> DataFrame:
        rows = sql(FRAMES[name]) if name in FRAMES else frame(name)
        broken = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(rule)) for rule, cond in conditions)))
        return rows.select(F.explode(broken).alias("rule"), F.col(KEYS.get(name, "id") if name not in FRAMES else "id").cast("string").alias("what"))

    def count(clauses: list[str]) -> str:
        return "SELECT sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {x}" for x in clauses) + ")"

    out = [judged(name, conditions) for name, conditions in by_frame.items()]
    out += [sql(f"SELECT '{rule}' AS rule, '{name}' AS what FROM ({count(a)}) a CROSS JOIN ({count(b)}) b WHERE a.n <> b.n") for (rule, name), (a, b) in totals.items()]
    out += [sql(text).select(F.lit(rule).alias("rule"), "what") for rule, text in whole.items()]
    if "K4" in wanted:
        out.append(dangling(tables))
    return reduce(DataFrame.unionByName, out)


def view_columns(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """K64: the views whose columns differ from the contract, with what they have."""
    return {name: df.columns for name, f in views.VIEWS.items() for df in [f(tables)] if df.columns != schema.VIEWS[name]}


def view_contract(tables: Mapping[str, DataFrame]) -> DataFrame:
    """K64 as rows: (view_name, columns, n_rows) of each view as it is."""
    each = [f(tables) for f in views.VIEWS.values()]
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view_name"), F.lit(",".join(df.columns)).alias("columns"), "n_rows") for name, df in zip(views.VIEWS, each, strict=True)])


def tops(tables: Mapping[str, DataFrame]) -> DataFrame:
    """K88 as rows: (name, is_top): each root, and whether it is the design's declared top."""
    declared = tables["meta"].where(F.col("key") == "top").agg(F.max("value").alias("top"))
    return tables["tree_node"].where("node_kind = 'root'").join(F.broadcast(declared)).select("name", F.coalesce(F.col("name") == F.col("top"), F.lit(False)).alias("is_top"))


def top_is(tables: Mapping[str, DataFrame], expected: str) -> bool:
    """K88: whether the design's top is the one expected."""
    return tables["meta"].where(F.col("key") == "top").agg(F.max("value")).first()[0] == expected
