"""The tables of a design, their value domains, references and the columns of the views."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 14

_TYPES = {"l": T.LongType(), "s": T.StringType(), "i": T.IntegerType()}


def _struct(spec: str) -> T.StructType:
    """Columns as name:type, l for long, s for string, i for int; ? for nullable."""
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, _TYPES[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


_AT = "file_id:l? line:l? col:l?"
_WINDOW = "id:l stmt_id:l ordinal:l net_id:l lo:l? hi:l? is_exact:i"

#: Names and order are the format's.
TABLES: dict[str, T.StructType] = {
    name: _struct(spec)
    for name, spec in {
        "meta": "key:s value:s?",
        "src_file": "id:l path:s? digest:s?",
        "file": "id:l path:s? src_file_id:l?",
        "data_type": "id:l text:s?",
        "module": "id:l name:s def_kind:s " + _AT,
        "tree_node": "id:l parent_node_id:l? name:s node_kind:s ordinal:l",
        "inst": "id:l module_id:l? parent_inst_id:l? param_signature:s? unresolved_def:s? " + _AT,
        "inst_param": "inst_id:l ordinal:l name:s value:s",
        "prim": "id:l inst_id:l prim_kind:s def_name:s " + _AT,
        "net": "id:l inst_id:l scope_node_id:l name:s decl_kind:s data_type_id:l? width:l? is_implicit:i " + _AT,
        "term": "id:l inst_id:l name:s term_kind:s direction:s? data_type_id:l? width:l? ordinal:l is_const:i? modport:s? " + _AT,
        "term_map": "term_id:l ordinal:l inner_net_id:l term_lo:l? term_hi:l? term_exact:i inner_lo:l? inner_hi:l? inner_exact:i map_exact:i",
        "net_conn": "id:l outer_net_id:l? term_id:l ordinal:l conn_kind:s outer_lo:l? outer_hi:l? outer_exact:i? term_lo:l? term_hi:l? term_exact:i? map_exact:i? outer_intf_inst_id:l? outer_hier_ref_id:l? " + _AT,
        "proc": "id:l inst_id:l scope_node_id:l name:s? proc_kind:s ordinal:l " + _AT,
        "call_site": "id:l inst_id:l caller_stmt_id:l? parent_call_site_id:l? subroutine_name:s depth:l",
        "stmt": "id:l inst_id:l scope_node_id:l proc_id:l? ordinal:l sequence:l? stmt_kind:s construct:s? assign_kind:s? delay:s? dropped_operand_count:l call_site_id:l? " + _AT,
        "stmt_target": _WINDOW,
        "assign_operand": _WINDOW,
        "expr_ref": "id:l stmt_id:l ordinal:l net_id:l role:s lo:l? hi:l? is_exact:i",
        "proc_event": "id:l proc_id:l stmt_id:l? net_id:l? event_kind:s edge_kind:s? " + _AT,
        "net_dep": "id:l src_net_id:l? tgt_net_id:l stmt_id:l? assign_operand_id:l? stmt_target_id:l? expr_ref_id:l? prim_id:l? src_hier_ref_id:l? tgt_hier_ref_id:l? dep_kind:s src_lo:l? src_hi:l? src_exact:i? tgt_lo:l? tgt_hi:l? tgt_exact:i map_exact:i? call_site_id:l?",
        "hier_ref": "id:l inst_id:l stmt_id:l? path:s access:s resolved_inst_id:l? resolved_net_id:l? lo:l? hi:l? is_exact:i " + _AT,
    }.items()
}

#: (table, column) -> words; those in NULLABLE may be null. Fixed values.
DOMAINS = {
    ("module", "def_kind"): "module interface program checker package",
    ("tree_node", "node_kind"): "root instance generate primitive unresolved package",
    ("prim", "prim_kind"): "gate switch udp",
    ("term", "term_kind"): "signal interface",
    ("term", "direction"): "input output inout ref",
    ("net_conn", "conn_kind"): "signal constant unconnected expression_operand interface external_reference",
    ("proc", "proc_kind"): "always always_ff always_comb always_latch initial final task function",
    ("stmt", "stmt_kind"): "assignment assertion wait call system_task event_control alias release",
    ("stmt", "assign_kind"): "continuous blocking nonblocking",
    ("expr_ref", "role"): "control assertion wait event call_argument system_task",
    ("proc_event", "event_kind"): "sensitivity wait",
    ("proc_event", "edge_kind"): "posedge negedge both",
    ("net_dep", "dep_kind"): "data control primitive procedure alias",
    ("hier_ref", "access"): "read write connect",
}
NULLABLE = {("term", "direction"), ("stmt", "assign_kind"), ("proc_event", "edge_kind")}
DRIVER_KINDS = "data control primitive procedure connection connection_expression constant terminal system_task alias external"
LOAD_KINDS = "dataflow connection sensitivity wait statement terminal alias"
#: Kinds of drivers that have no net, those of them that have nothing else either, and kinds of loads that have no net.
NETLESS_DRIVERS = "constant terminal system_task external"
BARE_DRIVERS = "constant terminal system_task"
NETLESS_LOADS = "sensitivity wait statement terminal"
ATTACHMENT_KINDS = "terminal_inside actual_outside written_by release_target alias_binding read_by condition statement_read event dep_in dep_out named_from_outside"

#: (table, column, table it names)
REFERENCES = [
    *((t, "file_id", "file") for t in ("module", "inst", "prim", "net", "term", "net_conn", "proc", "stmt", "proc_event", "hier_ref")),
    *((t, "inst_id", "inst") for t in ("inst_param", "prim", "net", "term", "proc", "call_site", "stmt", "hier_ref")),
    *((t, "scope_node_id", "tree_node") for t in ("net", "proc", "stmt")),
    *((t, "stmt_id", "stmt") for t in ("stmt_target", "assign_operand", "expr_ref", "proc_event", "net_dep", "hier_ref")),
    *((t, "net_id", "net") for t in ("stmt_target", "assign_operand", "expr_ref", "proc_event")),
    *((t, "data_type_id", "data_type") for t in ("net", "term")),
    *((t, "proc_id", "proc") for t in ("stmt", "proc_event")),
    *((t, "call_site_id", "call_site") for t in ("stmt", "net_dep")),
    *((t, "term_id", "term") for t in ("term_map", "net_conn")),
    ("file", "src_file_id", "src_file"), ("tree_node", "parent_node_id", "tree_node"), ("inst", "id", "tree_node"), ("inst", "module_id", "module"),
    ("inst", "parent_inst_id", "inst"), ("prim", "id", "tree_node"), ("term_map", "inner_net_id", "net"), ("net_conn", "outer_net_id", "net"),
    ("net_conn", "outer_intf_inst_id", "inst"), ("net_conn", "outer_hier_ref_id", "hier_ref"), ("call_site", "caller_stmt_id", "stmt"),
    ("call_site", "parent_call_site_id", "call_site"), ("net_dep", "src_net_id", "net"), ("net_dep", "tgt_net_id", "net"),
    ("net_dep", "assign_operand_id", "assign_operand"), ("net_dep", "stmt_target_id", "stmt_target"), ("net_dep", "expr_ref_id", "expr_ref"),
    ("net_dep", "prim_id", "prim"), ("net_dep", "src_hier_ref_id", "hier_ref"), ("net_dep", "tgt_hier_ref_id", "hier_ref"),
    ("hier_ref", "resolved_inst_id", "inst"), ("hier_ref", "resolved_net_id", "net"),
]

_PLACE = "file_path src_path src_line src_col"
#: Columns of the views, in the order of the contract. Fixed values.
VIEWS = {
    name: columns.split()
    for name, columns in {
        "v_db_info": "schema_version tool_version slang_version producer_revision top analysis_status error_count unresolved_count empty_procedure_count duplicate_path_count config_digest",
        "v_tree_node": "node_id parent_node_id node_name node_kind ordinal inst_id parent_inst_id module_id module_name param_signature def_name " + _PLACE,
        "v_net": "net_id inst_id module_id module_name param_signature scope_node_id net_name decl_kind data_type width is_implicit " + _PLACE,
        "v_term": "term_id inst_id module_id module_name term_name term_kind direction data_type width ordinal is_const modport " + _PLACE,
        "v_term_map": "term_id term_inst_id term_name map_ordinal inner_net_id inner_net_name term_lo term_hi term_exact inner_lo inner_hi inner_exact map_exact",
        "v_net_conn": "conn_id outer_net_id outer_inst_id outer_net_name term_id term_inst_id term_name direction conn_kind ordinal outer_lo outer_hi outer_exact term_lo term_hi term_exact map_exact outer_intf_inst_id outer_hier_ref_id " + _PLACE,
        "v_net_dep": "dep_id src_net_id src_inst_id src_name src_lo src_hi src_exact tgt_net_id tgt_inst_id tgt_name tgt_lo tgt_hi tgt_exact stmt_id assign_operand_id stmt_target_id expr_ref_id prim_id src_hier_ref_id tgt_hier_ref_id dep_kind map_exact call_site_id " + _PLACE,
        "v_driver": "signal_net_id signal_inst_id signal_name signal_lo signal_hi signal_exact driver_net_id driver_inst_id driver_name driver_lo driver_hi driver_exact driver_kind dep_id conn_id stmt_id prim_id term_id map_exact call_site_id " + _PLACE,
        "v_load": "signal_net_id signal_inst_id signal_name signal_lo signal_hi signal_exact load_net_id load_inst_id load_name load_lo load_hi load_exact load_kind dep_id conn_id stmt_id proc_id term_id map_exact call_site_id " + _PLACE,
        "v_stmt": "stmt_id inst_id module_id module_name scope_node_id proc_id ordinal sequence stmt_kind construct assign_kind delay dropped_operand_count " + _PLACE,
        "v_stmt_target": "target_id stmt_id ordinal net_id net_name tgt_lo tgt_hi tgt_exact",
        "v_stmt_operand": "operand_id stmt_id ordinal net_id net_name operand_lo operand_hi operand_exact",
        "v_net_attachment": "net_id inst_id net_name attachment_kind lo hi exact stmt_id term_id stmt_target_id assign_operand_id expr_ref_id proc_id dep_id hier_ref_id",
        "v_call_site": "call_site_id inst_id module_id module_name caller_stmt_id parent_call_site_id subroutine_name depth",
    }.items()
}
