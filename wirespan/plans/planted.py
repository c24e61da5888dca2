"""Rows to add to a design: for each rule one that breaks it, and a legal one that nearly does."""

from __future__ import annotations

from wirespan.sources import schema

B = 9_000_000_000
TOP, SUB, BLACK, GEN, PRIM = B + 1, B + 2, B + 3, B + 4, B + 5
NET, OTHER, IN_TOP, BYTE = B + 1, B + 2, B + 3, B + 4  # nets of SUB (8 bits, 8 bits), of TOP (8 bits), of SUB (4 bits)
PROC, SITE, STMT, RELEASE, ALIAS, WAIT, HEADER, CALL = B + 1, B + 1, B + 1, B + 2, B + 3, B + 4, B + 5, B + 6
TARGET, OPERAND, READ, ARGUMENT, REF, TIE = B + 1, B + 1, B + 1, B + 2, B + 1, B + 2


def _node(k: int, name: str, kind: str, parent: int | None = TOP) -> tuple[str, dict]:
    return "tree_node", {"id": B + k, "name": name, "node_kind": kind, "parent_node_id": parent}


def _inst(k: int, parent: int | None = TOP, module: int | None = 1, **more) -> tuple[str, dict]:
    return "inst", {"id": B + k, "module_id": module, "parent_inst_id": parent, **more}


def _net(k: int, inst: int = SUB, scope: int | None = None, **more) -> tuple[str, dict]:
    return "net", {"id": B + k, "inst_id": inst, "scope_node_id": scope or inst, "name": f"n{k}", "decl_kind": "wire", "width": 8, "is_implicit": 0, **more}


def _stmt(k: int, kind: str, **more) -> tuple[str, dict]:
    return "stmt", {"id": B + k, "inst_id": SUB, "scope_node_id": SUB, "stmt_kind": kind, **more}


def _dep(k: int, kind: str, **more) -> tuple[str, dict]:
    return "net_dep", {"id": B + k, "tgt_net_id": OTHER, "dep_kind": kind, **more}


def _data(k: int, **more) -> tuple[str, dict]:
    return _dep(k, "data", **({"src_net_id": NET, "stmt_id": STMT, "assign_operand_id": OPERAND, "stmt_target_id": TARGET, "src_exact": 1, "map_exact": 1} | more))


def _conn(k: int, kind: str, **more) -> tuple[str, dict]:
    return "net_conn", {"id": B + k, "term_id": B + 1, "conn_kind": kind, **more}


def _seg(k: int, ordinal: int, lo: int, hi: int, exact: int = 1) -> tuple[str, dict]:
    return "term_map", {"term_id": B + k, "ordinal": ordinal, "inner_net_id": NET, "term_lo": lo, "term_hi": hi, "inner_lo": lo, "inner_hi": hi, "map_exact": exact}


#: Legal rows that the others refer to.
LEGAL: list[tuple[str, dict]] = [
    _node(1, "planted", "root", None), _inst(1, None), _node(2, "u", "instance"), _inst(2), _node(3, "bb", "unresolved"), _inst(3, TOP, None, unresolved_def="x"), _node(4, "g", "generate", SUB), _node(5, "p", "primitive", GEN), ("prim", {"id": PRIM, "inst_id": SUB, "prim_kind": "gate", "def_name": "and"}),
    _net(1), _net(2), _net(3, TOP), _net(4, width=4), ("term", {"id": B + 1, "inst_id": SUB, "name": "t", "term_kind": "signal", "direction": "input", "width": 8}), ("term", {"id": B + 2, "inst_id": BLACK, "name": "t", "term_kind": "signal"}),
    ("proc", {"id": PROC, "inst_id": SUB, "scope_node_id": GEN, "proc_kind": "always"}), ("call_site", {"id": SITE, "inst_id": SUB, "subroutine_name": "f", "depth": 1}),
    _stmt(1, "assignment", assign_kind="continuous"), _stmt(2, "release", construct="deassign"), _stmt(3, "alias", construct="alias"), _stmt(4, "wait", proc_id=PROC, sequence=1), _stmt(5, "event_control", proc_id=PROC), _stmt(6, "call"),
    ("stmt_target", {"id": TARGET, "stmt_id": STMT, "net_id": OTHER}), ("stmt_target", {"id": B + 2, "stmt_id": RELEASE, "net_id": OTHER}), ("stmt_target", {"id": B + 3, "stmt_id": ALIAS, "net_id": OTHER}), ("assign_operand", {"id": OPERAND, "stmt_id": STMT, "net_id": NET}), ("assign_operand", {"id": B + 3, "stmt_id": ALIAS, "net_id": NET}),
    ("expr_ref", {"id": READ, "stmt_id": STMT, "net_id": NET, "role": "control"}), ("expr_ref", {"id": ARGUMENT, "stmt_id": CALL, "net_id": NET, "role": "call_argument"}),
    ("hier_ref", {"id": REF, "inst_id": SUB, "stmt_id": STMT, "path": "planted.n3", "access": "read", "resolved_inst_id": TOP, "resolved_net_id": IN_TOP}), ("hier_ref", {"id": TIE, "inst_id": SUB, "path": "planted.n3", "access": "connect", "resolved_inst_id": TOP, "resolved_net_id": IN_TOP}),
]

#: (rule, whether it is broken, rows): the last row is the one judged; what it is named by is its key.
CASES: list[tuple[str, bool, list[tuple[str, dict]]]] = [
    ("K2", True, [("src_file", {"id": B + 10, "digest": "short"})]), ("K2", False, [("src_file", {"id": B + 11, "digest": "0" * 64})]),
    ("K4", True, [_net(10, data_type_id=B + 99)]), ("K4", False, [_net(11, data_type_id=None)]),
    ("K5", True, [("module", {"id": B + 10, "name": "m", "def_kind": "nonsense"})]), ("K5", False, [("module", {"id": B + 11, "name": "m", "def_kind": "checker"})]), ("K5", True, [("term", {"id": B + 12, "inst_id": SUB, "name": "t", "term_kind": "signal", "direction": "up"})]),
    ("K6", True, [_net(12, is_implicit=2)]), ("K6", False, [("term", {"id": B + 13, "inst_id": SUB, "name": "t", "term_kind": "signal", "is_const": None})]),
    ("K7", True, [("stmt_target", {"id": B + 10, "stmt_id": RELEASE, "net_id": OTHER, "lo": 5, "hi": 2})]), ("K7", False, [("stmt_target", {"id": B + 11, "stmt_id": RELEASE, "net_id": OTHER, "lo": 5, "hi": 5})]), ("K7", True, [_conn(10, "interface", outer_lo=1, outer_hi=2)]), ("K7", True, [_data(10, src_lo=3)]),
    ("K8", True, [_node(10, "k8", "generate", None)]), ("K8", False, [_node(20, "k8", "package", None), _inst(20, None)]),
    ("K9", True, [_node(11, "k9", "instance")]), ("K9", False, [_node(21, "k9", "generate")]),
    ("K10", True, [_node(12, "k10", "primitive")]), ("K10", False, [("prim", {"id": B + 22, "inst_id": SUB, "prim_kind": "udp", "def_name": "u"}), _node(22, "k10", "primitive", SUB)]),
    ("K11", True, [_node(13, "k11", "instance"), _inst(13, TOP, None)]), ("K11", True, [_node(23, "k11p", "package", None), _inst(23, None, None)]), ("K11", False, [_node(24, "k11u", "unresolved"), _inst(24, TOP, None, unresolved_def="y")]),
    ("K12", True, [_node(14, "k12", "unresolved"), _inst(14, TOP, None)]), ("K12", True, [_node(25, "k12s", "unresolved"), _inst(25, TOP, None, unresolved_def="y", param_signature="A=1")]), ("K12", False, [_node(65, "k12u", "unresolved"), _inst(65, TOP, None, unresolved_def="y")]),
    ("K13", True, [_node(15, "k13", "instance"), _inst(15, None)]), ("K13", False, [_node(26, "k13", "root", None), _inst(26, None)]), ("K13", True, [_inst(60, None)]), ("K13", True, [_node(61, "k13r", "root", None), _inst(61, TOP)]), ("K13", False, [_inst(62, TOP)]),
    ("K14", True, [_node(16, "k14", "instance", SUB), _inst(16, TOP)]), ("K14", False, [_node(27, "k14", "instance", GEN), _inst(27, SUB)]),
    ("K15", True, [_node(17, "k15", "primitive", GEN), ("prim", {"id": B + 17, "inst_id": TOP, "prim_kind": "gate", "def_name": "or"})]), ("K15", False, [_node(66, "k15", "primitive", GEN), ("prim", {"id": B + 66, "inst_id": SUB, "prim_kind": "gate", "def_name": "or"})]),
    ("K16", True, [_net(16, TOP, GEN)]), ("K16", True, [_net(17, TOP, SUB)]), ("K16", False, [_net(18, SUB, GEN)]),
    ("K17", True, [_node(30, "a.b", "generate")]), ("K17", True, [_node(31, "\\a.c", "generate")]), ("K17", False, [_node(32, "\\a.d ", "generate")]), ("K17", False, [_node(33, "", "generate")]),
    ("K18", True, [_net(20, file_id=1, line=0, col=1)]), ("K18", False, [_net(21, file_id=1)]), ("K18", False, [_net(22, line=0, col=0)]),
    ("K20", True, [_node(34, "k20", "instance"), _inst(34, param_signature="A=1")]), ("K20", True, [_inst(63, param_signature="A=1")]), ("K20", True, [("inst_param", {"inst_id": B + 64, "name": "A", "value": "1"}), _inst(64)]), ("K20", False, [("inst_param", {"inst_id": B + 35, "ordinal": 1, "name": "B", "value": "2"}), ("inst_param", {"inst_id": B + 35, "name": "A", "value": "1"}), _node(35, "k20b", "instance"), _inst(35, param_signature="A=1,B=2")]),
    ("K21", True, [("inst_param", {"inst_id": B + 98, "name": "A", "value": "1"})]), ("K21", False, [_node(67, "k21", "instance"), _inst(67, param_signature="A=1"), ("inst_param", {"inst_id": B + 67, "name": "A", "value": "1"})]),
    ("K22", True, [("term", {"id": B + 14, "inst_id": SUB, "name": "t", "term_kind": "signal"}), ("term_map", {"term_id": B + 14, "inner_net_id": IN_TOP})]), ("K22", False, [("term", {"id": B + 15, "inst_id": SUB, "name": "t", "term_kind": "signal"}), ("term_map", {"term_id": B + 15, "inner_net_id": NET})]),
    ("K23", True, [_conn(11, "signal", outer_net_id=NET, map_exact=0)]), ("K23", False, [_conn(12, "signal", outer_net_id=IN_TOP, map_exact=0)]), ("K23", False, [("term", {"id": B + 16, "inst_id": TOP, "name": "t", "term_kind": "signal"}), ("net_conn", {"id": B + 13, "term_id": B + 16, "conn_kind": "signal", "outer_net_id": IN_TOP, "map_exact": 0})]),
    ("K24", True, [("assign_operand", {"id": B + 10, "stmt_id": STMT, "net_id": IN_TOP})]), ("K24", False, [("assign_operand", {"id": B + 11, "stmt_id": STMT, "net_id": NET})]),
    ("K25", True, [("proc_event", {"id": B + 10, "proc_id": PROC, "net_id": IN_TOP, "event_kind": "sensitivity"})]), ("K25", True, [("proc_event", {"id": B + 11, "proc_id": PROC, "stmt_id": STMT, "event_kind": "wait"})]), ("K25", False, [("proc_event", {"id": B + 12, "proc_id": PROC, "net_id": NET, "stmt_id": WAIT, "event_kind": "wait"})]),
    ("K26", True, [("proc_event", {"id": B + 13, "proc_id": PROC, "event_kind": "wait"})]), ("K26", False, [("proc_event", {"id": B + 14, "proc_id": PROC, "event_kind": "sensitivity"})]),
    ("K27", True, [_stmt(10, "assignment")]), ("K27", False, [_stmt(11, "assertion")]),
    ("K28", True, [_stmt(12, "release", construct="force")]), ("K28", False, [_stmt(13, "release")]),
    ("K29", True, [_stmt(14, "release", construct="release")]), ("K29", False, [("hier_ref", {"id": B + 10, "inst_id": SUB, "stmt_id": B + 15, "path": "x", "access": "write"}), _stmt(15, "release", construct="release")]),
    ("K30", True, [("assign_operand", {"id": B + 12, "stmt_id": B + 16, "net_id": NET}), _stmt(16, "release", construct="release")]), ("K30", False, [_stmt(17, "release", construct="release")]),
    ("K31", True, [_data(11, stmt_id=RELEASE, stmt_target_id=B + 2)]), ("K31", False, [_data(12)]),
    ("K32", True, [_stmt(18, "call", call_site_id=SITE, inst_id=TOP, scope_node_id=TOP)]), ("K32", False, [_stmt(19, "call", call_site_id=SITE)]),
    ("K33", True, [("call_site", {"id": B + 10, "inst_id": TOP, "subroutine_name": "f", "depth": 1}), _data(13, call_site_id=B + 10)]), ("K33", False, [_data(14, call_site_id=SITE)]),
    ("K34", True, [_data(15, call_site_id=SITE, stmt_id=None)]), ("K34", False, [_data(16, stmt_id=None)]),
    ("K35", True, [("call_site", {"id": B + 11, "inst_id": SUB, "subroutine_name": "f", "depth": 2})]), ("K35", False, [("call_site", {"id": B + 12, "inst_id": SUB, "subroutine_name": "f", "depth": 2, "parent_call_site_id": SITE})]),
    ("K36", True, [("call_site", {"id": B + 13, "inst_id": SUB, "subroutine_name": "f", "depth": 3, "parent_call_site_id": SITE})]), ("K36", True, [("call_site", {"id": B + 14, "inst_id": TOP, "subroutine_name": "f", "depth": 2, "parent_call_site_id": SITE})]), ("K36", False, [("call_site", {"id": B + 15, "inst_id": SUB, "subroutine_name": "g", "depth": 2, "parent_call_site_id": SITE})]),
    ("K37", True, [("call_site", {"id": B + 16, "inst_id": TOP, "subroutine_name": "f", "depth": 1, "caller_stmt_id": CALL})]), ("K37", False, [("call_site", {"id": B + 17, "inst_id": SUB, "subroutine_name": "f", "depth": 1, "caller_stmt_id": CALL})]),
    ("K38", True, [_stmt(20, "assignment", assign_kind="continuous", proc_id=PROC, sequence=3)]), ("K38", False, [_stmt(21, "assignment", assign_kind="blocking")]),
    ("K39", True, [_stmt(22, "wait", sequence=4)]), ("K39", False, [_stmt(23, "wait")]), ("K40", True, [_stmt(24, "wait", proc_id=PROC)]), ("K40", False, [_stmt(25, "event_control", proc_id=PROC)]),
    ("K41", True, [("expr_ref", {"id": B + 10, "stmt_id": STMT, "net_id": NET, "role": "wait"})]), ("K41", False, [("expr_ref", {"id": B + 11, "stmt_id": HEADER, "net_id": NET, "role": "wait"})]), ("K41", False, [("expr_ref", {"id": B + 12, "stmt_id": HEADER, "net_id": NET, "role": "control"})]), ("K41", False, [("expr_ref", {"id": B + 13, "stmt_id": STMT, "net_id": NET, "role": "call_argument"})]), ("K41", True, [("expr_ref", {"id": B + 14, "stmt_id": WAIT, "net_id": NET, "role": "call_argument"})]),
    ("K42", True, [_data(20, tgt_hier_ref_id=TIE)]), ("K42", True, [_data(21, src_hier_ref_id=REF)]), ("K42", True, [_data(22, src_net_id=None)]), ("K42", False, [_data(23, src_net_id=None, assign_operand_id=None, src_exact=None, map_exact=None)]), ("K42", False, [_data(24, src_net_id=IN_TOP, assign_operand_id=None, src_hier_ref_id=REF)]),
    ("K42", True, [_dep(25, "control", stmt_id=STMT, src_net_id=NET, expr_ref_id=READ, stmt_target_id=TARGET)]), ("K42", False, [_dep(26, "control", stmt_id=STMT, src_net_id=NET, expr_ref_id=READ, stmt_target_id=TARGET, map_exact=0)]), ("K42", True, [_dep(27, "control", stmt_id=STMT, src_net_id=NET, expr_ref_id=READ, src_hier_ref_id=REF, stmt_target_id=TARGET, map_exact=0)]),
    ("K42", True, [_dep(28, "primitive", prim_id=PRIM, src_net_id=NET, expr_ref_id=READ)]), ("K42", False, [_dep(29, "primitive", prim_id=PRIM, src_net_id=NET)]), ("K42", True, [_dep(30, "procedure", expr_ref_id=ARGUMENT)]), ("K42", False, [_dep(31, "procedure", src_net_id=NET, expr_ref_id=ARGUMENT)]), ("K42", True, [_dep(32, "alias", stmt_id=ALIAS, src_net_id=NET, stmt_target_id=B + 3, assign_operand_id=B + 3)]),
    ("K43", True, [_data(33, src_net_id=NET, assign_operand_id=None, src_hier_ref_id=REF)]), ("K43", False, [_data(34, src_net_id=IN_TOP, assign_operand_id=None, src_hier_ref_id=REF)]),
    ("K44", True, [_data(35, src_net_id=IN_TOP, assign_operand_id=None, src_hier_ref_id=REF, stmt_id=CALL)]), ("K44", False, [_data(36, src_net_id=IN_TOP, assign_operand_id=None, src_hier_ref_id=REF, stmt_id=None)]), ("K44", True, [_data(37, stmt_target_id=None, tgt_net_id=IN_TOP, tgt_hier_ref_id=REF, stmt_id=CALL)]),
    ("K45", True, [_data(38, stmt_target_id=None, tgt_hier_ref_id=TIE)]), ("K45", False, [_data(39, stmt_target_id=None, tgt_net_id=IN_TOP, tgt_hier_ref_id=TIE)]),
    ("K46", True, [_data(40, src_net_id=None, assign_operand_id=None, map_exact=None)]), ("K46", False, [_data(41, src_net_id=None, src_exact=None, map_exact=None)]),
    ("K47", True, [_data(42, src_net_id=BYTE)]), ("K47", False, [_data(43, src_net_id=None)]), ("K48", True, [_data(44, tgt_net_id=NET)]), ("K48", False, [_data(45, stmt_id=None)]),
    ("K49", True, [_dep(46, "control", stmt_id=STMT, src_net_id=BYTE, expr_ref_id=READ)]), ("K49", True, [_dep(47, "procedure", stmt_id=STMT, src_net_id=NET, expr_ref_id=READ)]), ("K49", False, [_dep(48, "procedure", src_net_id=NET, expr_ref_id=ARGUMENT)]),
    ("K50", True, [_data(49, tgt_net_id=IN_TOP)]), ("K50", True, [_data(50, stmt_id=B + 18)]), ("K50", False, [_dep(51, "procedure", src_net_id=NET, stmt_id=B + 18)]), ("K50", False, [_data(52, src_net_id=IN_TOP, src_hier_ref_id=REF)]),
    ("K51", True, [_dep(53, "alias", stmt_id=ALIAS, src_net_id=BYTE)]), ("K51", False, [_dep(54, "alias", stmt_id=ALIAS, src_net_id=OTHER, tgt_net_id=NET), _dep(55, "alias", stmt_id=ALIAS, src_net_id=NET)]),
    ("K52", True, [_dep(56, "alias", stmt_id=ALIAS, src_net_id=OTHER, src_lo=0, src_hi=3, src_exact=1, tgt_lo=4, tgt_hi=7)]), ("K52", False, [_dep(57, "data", stmt_id=STMT, src_net_id=OTHER)]),
    ("K53", True, [_stmt(26, "alias", construct="alias", proc_id=PROC, sequence=1)]), ("K53", False, [_stmt(27, "alias", construct="alias")]),
    ("K54", True, [("hier_ref", {"id": B + 11, "inst_id": SUB, "stmt_id": B + 28, "path": "x", "access": "write"}), _stmt(28, "assertion"), ("stmt_target", {"id": B + 12, "stmt_id": B + 28, "net_id": OTHER})]), ("K54", False, [("hier_ref", {"id": B + 12, "inst_id": SUB, "stmt_id": B + 29, "path": "x", "access": "read"}), _stmt(29, "assertion"), ("stmt_target", {"id": B + 13, "stmt_id": B + 29, "net_id": OTHER})]),
    ("K55", True, [("term", {"id": B + 17, "inst_id": SUB, "name": "t", "term_kind": "signal", "width": 8}), ("term_map", {"term_id": B + 17, "inner_net_id": BYTE, "term_exact": 0, "inner_exact": 0})]), ("K55", False, [("term", {"id": B + 18, "inst_id": SUB, "name": "t", "term_kind": "signal"}), ("term_map", {"term_id": B + 18, "inner_net_id": BYTE})]),
    ("K56", True, [_data(58, src_net_id=BYTE)]), ("K56", False, [_data(59, src_net_id=BYTE, src_exact=0)]),
    ("K57", True, [_conn(14, "constant", outer_lo=0, outer_hi=3, outer_exact=1, term_exact=1, map_exact=1)]), ("K57", False, [_conn(15, "signal", outer_net_id=IN_TOP, outer_exact=1, term_exact=1, map_exact=1)]),
    ("K58", True, [("term", {"id": B + 19, "inst_id": SUB, "name": "t", "term_kind": "signal", "width": 8}), _seg(19, 0, 0, 3), _seg(19, 1, 3, 7)]), ("K58", False, [("term", {"id": B + 20, "inst_id": SUB, "name": "t", "term_kind": "signal", "width": 8}), _seg(20, 0, 0, 3), _seg(20, 1, 4, 7), _seg(20, 2, 0, 7, 0), ("term_map", {"term_id": B + 20, "ordinal": 3, "inner_net_id": NET})]),
    ("K59", True, [("hier_ref", {"id": B + 13, "inst_id": SUB, "path": "x", "access": "read", "resolved_inst_id": SUB, "resolved_net_id": IN_TOP})]), ("K59", False, [("hier_ref", {"id": B + 14, "inst_id": SUB, "path": "x", "access": "read", "resolved_inst_id": SUB})]),
    ("K60", True, [_conn(16, "external_reference", outer_hier_ref_id=REF, map_exact=1)]), ("K60", False, [_conn(17, "external_reference", outer_hier_ref_id=TIE, map_exact=1)]),
    ("K61", True, [_conn(18, "signal", outer_net_id=IN_TOP)]), ("K61", False, [("net_conn", {"id": B + 19, "term_id": B + 2, "conn_kind": "signal", "outer_net_id": IN_TOP})]), ("K61", True, [_conn(20, "expression_operand", outer_net_id=IN_TOP, map_exact=1)]), ("K61", False, [_conn(21, "expression_operand", outer_net_id=IN_TOP, map_exact=0)]), ("K61", True, [_conn(22, "external_reference", outer_hier_ref_id=TIE)]), ("K61", True, [_conn(23, "unconnected", map_exact=0)]), ("K61", True, [_conn(24, "interface", outer_net_id=IN_TOP)]),
    ("K78", True, [_data(60, src_net_id=None, assign_operand_id=None, src_hier_ref_id=REF, src_exact=None, map_exact=None)]), ("K78", False, [("hier_ref", {"id": B + 15, "inst_id": SUB, "stmt_id": STMT, "path": "far.x", "access": "read"}), _data(61, src_net_id=None, assign_operand_id=None, src_hier_ref_id=B + 15, src_exact=None, map_exact=None)]),
    ("K87", True, [("file", {"id": B + 10, "path": "f"})]), ("K87", False, [("file", {"id": B + 11, "path": "f", "src_file_id": 1})]),
]


def filled(table: str, values: dict) -> tuple:
    """A whole row: what is not given is null, or 0, empty or (flags) 1 where it may not be."""
    return tuple(values.get(f.name, None if f.nullable else {"long": 0, "string": "", "integer": 1}[f.dataType.typeName()]) for f in schema.TABLES[table].fields)


#: A file, a module and a terminal given twice, and a primitive that drives both ways: joins on them count rows twice (K65 to K69).
DOUBLED: list[tuple[str, dict]] = [("file", {"id": 1, "path": "again"}), ("module", {"id": 2, "name": "again", "def_kind": "module"}), ("net", {"id": 20_000_001, "inst_id": 1, "scope_node_id": 1, "name": "again", "decl_kind": "wire", "is_implicit": 0}), ("term", {"id": 1_000_012, "inst_id": 1_000_012, "name": "again", "term_kind": "signal", "direction": "input"})]
TWO_WAY: list[tuple[str, dict]] = [_dep(80, "primitive", prim_id=PRIM, src_net_id=NET), _dep(81, "primitive", prim_id=PRIM, src_net_id=OTHER, tgt_net_id=NET)]


def rows(given: list[tuple[str, dict]] | None = None) -> dict[str, list[tuple]]:
    """table -> rows to add: those given, or all of LEGAL and CASES."""
    out: dict[str, list[tuple]] = {}
    for table, values in given if given is not None else [*LEGAL, *(r for _, _, own in CASES for r in own)]:
        out.setdefault(table, []).append(filled(table, values))
    return out


def what(table: str, values: dict) -> str:
    return str(values[{"inst_param": "inst_id", "term_map": "term_id"}.get(table, "id")])
