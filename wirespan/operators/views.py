"""The views of a design. Fact views keep the rows of their table; composite views are unions, kept split
so that a filter on a net reaches the scan of every branch. A design is any mapping of table names to
DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.functions import ranges
from wirespan.sources import schema

Tables = Mapping[str, DataFrame]
COUNTS = ("schema_version", "error_count", "unresolved_count", "empty_procedure_count", "duplicate_path_count")
INTO, OUT_OF = ("input", "inout", "ref"), ("output", "inout", "ref")


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def _files(t: Tables) -> DataFrame:
    return t["file"].alias("f").join(t["src_file"].alias("s"), F.col("f.src_file_id") == F.col("s.id"), "left").select(F.col("f.id").alias("at_file"), F.col("f.path").alias("file_path"), F.col("s.path").alias("src_path"))


def _placed(df: DataFrame, t: Tables, file_id: str | Column, line: str | Column = "line", col: str | Column = "col") -> DataFrame:
    """df with file_path, src_path, src_line and src_col."""
    named = df.withColumns({"__file": F.col(file_id) if isinstance(file_id, str) else file_id, "src_line": F.col(line) if isinstance(line, str) else line, "src_col": F.col(col) if isinstance(col, str) else col})
    return named.join(_files(t), F.col("__file") == F.col("at_file"), "left")


def _of(name: str, df: DataFrame, **names: str | Column) -> DataFrame:
    """The columns of a view in their order; names: column -> where it comes from, if that has another name."""
    return df.select(*((F.col(names[c]) if isinstance(names.get(c), str) else names[c] if c in names else F.col(c)).alias(c) for c in schema.VIEWS[name]))


def _ends(t: Tables, prefix: str) -> DataFrame:
    """id, instance and name of nets, with a prefix."""
    return t["net"].select(F.col("id").alias(f"{prefix}_id"), F.col("inst_id").alias(f"{prefix}_inst"), F.col("name").alias(f"{prefix}_name"))


def _with_end(df: DataFrame, t: Tables, column: str, prefix: str, how: str = "inner") -> DataFrame:
    return df.join(_ends(t, prefix), F.col(column) == F.col(f"{prefix}_id"), how)


def _modules(df: DataFrame, t: Tables) -> DataFrame:
    """df (with inst_id) with module_id, module_name and param_signature of its instance."""
    inst = t["inst"].select(F.col("id").alias("__inst"), "module_id", "param_signature")
    named = t["module"].select(F.col("id").alias("__module"), F.col("name").alias("module_name"))
    return df.join(inst, F.col("inst_id") == F.col("__inst")).join(named, F.col("module_id") == F.col("__module"), "left")


def db_info(t: Tables) -> DataFrame:
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    values = t["meta"].agg(*(of(c).alias(c) for c in schema.VIEWS["v_db_info"]))
    return values.select(*(F.col(c).try_cast("long").alias(c) if c in COUNTS else F.col(c) for c in schema.VIEWS["v_db_info"]))


def tree_node(t: Tables) -> DataFrame:
    inst, prim = _as(t["inst"], "i"), _as(t["prim"], "p")
    df = t["tree_node"].join(inst, F.col("id") == F.col("i_id"), "left").join(prim, F.col("id") == F.col("p_id"), "left")
    df = df.join(t["module"].select(F.col("id").alias("__module"), F.col("name").alias("module_name")), F.col("i_module_id") == F.col("__module"), "left")
    df = _placed(df, t, F.coalesce("i_file_id", "p_file_id"), F.coalesce("i_line", "p_line"), F.coalesce("i_col", "p_col"))
    return _of("v_tree_node", df, node_id="id", node_name="name", inst_id="i_id", parent_inst_id=F.coalesce("i_parent_inst_id", "p_inst_id"), module_id="i_module_id", param_signature="i_param_signature", def_name=F.coalesce("p_def_name", "i_unresolved_def"))


def _typed(df: DataFrame, t: Tables) -> DataFrame:
    return df.join(t["data_type"].select(F.col("id").alias("__type"), F.col("text").alias("data_type")), F.col("data_type_id") == F.col("__type"), "left")


def net(t: Tables) -> DataFrame:
    return _of("v_net", _placed(_typed(_modules(t["net"], t), t), t, "file_id"), net_id="id", net_name="name")


def term(t: Tables) -> DataFrame:
    return _of("v_term", _placed(_typed(_modules(t["term"], t), t), t, "file_id"), term_id="id", term_name="name")


def _terms(t: Tables) -> DataFrame:
    return t["term"].select(F.col("id").alias("t_id"), F.col("inst_id").alias("term_inst_id"), F.col("name").alias("term_name"), "direction")


def term_map(t: Tables) -> DataFrame:
    df = _with_end(t["term_map"].join(_terms(t), F.col("term_id") == F.col("t_id")), t, "inner_net_id", "n")
    return _of("v_term_map", df, map_ordinal="ordinal", inner_net_name="n_name")


def net_conn(t: Tables) -> DataFrame:
    df = _with_end(t["net_conn"].join(_terms(t), F.col("term_id") == F.col("t_id")), t, "outer_net_id", "n", "left")
    return _of("v_net_conn", _placed(df, t, "file_id"), conn_id="id", outer_inst_id="n_inst", outer_net_name="n_name")


def _deps(t: Tables, source: str) -> DataFrame:
    """Dependencies with both ends, statement and place. source: how sources are joined."""
    df = _with_end(_with_end(t["net_dep"], t, "tgt_net_id", "tn"), t, "src_net_id", "sn", source)
    df = df.join(_as(t["stmt"].select("id", "stmt_kind", "proc_id", "file_id", "line", "col"), "s"), F.col("stmt_id") == F.col("s_id"), "left")
    df = df.join(_as(t["prim"].select("id", "file_id", "line", "col"), "p"), F.col("prim_id") == F.col("p_id"), "left")
    return _placed(df, t, F.coalesce("s_file_id", "p_file_id"), F.coalesce("s_line", "p_line"), F.coalesce("s_col", "p_col"))


def net_dep(t: Tables) -> DataFrame:
    return _of("v_net_dep", _deps(t, "left"), dep_id="id", src_inst_id="sn_inst", src_name="sn_name", tgt_inst_id="tn_inst", tgt_name="tn_name")


def conn_arc(t: Tables) -> DataFrame:
    """Each place where an outer and an inner segment of a terminal share bits, with both nets' windows cut to them.

    The outer net is the connection's own, or that of a resolved reference. Those are two branches, so
    that outer_net_id is a plain column in each and a filter on it reaches the scan.
    """
    conns = t["net_conn"].where(F.col("conn_kind").isin("signal", "expression_operand", "constant", "external_reference"))
    fixed = [F.col(c) for c in ("id", "conn_kind", "term_id", "file_id", "line", "col")] + [F.col(a).alias(b) for a, b in (("term_lo", "c_lo"), ("term_hi", "c_hi"), ("term_exact", "c_term_exact"), ("map_exact", "c_map"))]
    refs = t["hier_ref"].select(F.col("id").alias("h_id"), "resolved_net_id", F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"), F.col("is_exact").alias("h_exact"))
    own = conns.where(F.col("outer_net_id").isNotNull())
    named = own.where("conn_kind = 'external_reference'").join(refs.where("resolved_net_id is not null").select("h_id"), F.col("outer_hier_ref_id") == F.col("h_id"), "left_semi")
    direct = own.where("conn_kind <> 'external_reference'").unionByName(named).select(*fixed, "outer_net_id", F.col("outer_lo").alias("o_lo"), F.col("outer_hi").alias("o_hi"), F.col("outer_exact").alias("o_exact"))
    through = conns.where(F.col("outer_net_id").isNull()).drop("outer_net_id").join(refs, F.col("outer_hier_ref_id") == F.col("h_id"), "left")
    through = through.where((F.col("conn_kind").isin("signal", "constant")) | F.col("resolved_net_id").isNotNull())
    through = through.select(*fixed, F.col("resolved_net_id").alias("outer_net_id"), F.col("h_lo").alias("o_lo"), F.col("h_hi").alias("o_hi"), F.col("h_exact").alias("o_exact"))
    inside = t["term_map"].select(F.col("term_id").alias("m_term"), "inner_net_id", F.col("term_lo").alias("m_lo"), F.col("term_hi").alias("m_hi"), F.col("term_exact").alias("m_term_exact"), F.col("inner_lo").alias("n_lo"), F.col("inner_hi").alias("n_hi"), F.col("inner_exact").alias("n_exact"), F.col("map_exact").alias("m_map"))
    terms = _terms(t).drop("term_name")
    return _arcs(direct, inside, terms).unionByName(_arcs(through, inside, terms))


ARC = "conn_id conn_kind term_id term_inst_id direction outer_net_id inner_net_id outer_lo outer_hi outer_exact inner_lo inner_hi inner_exact map_exact file_id line col".split()


def _arcs(outside: DataFrame, inside: DataFrame, terms: DataFrame) -> DataFrame:
    c = F.col
    meets = (c("term_id") == c("m_term")) & ranges.overlap(c("c_lo"), c("c_hi"), c("m_lo"), c("m_hi"))
    df = outside.join(inside, meets).join(terms, c("term_id") == c("t_id"))
    ends_exact = F.coalesce(c("c_term_exact") == 1, F.lit(False)) & (c("m_term_exact") == 1)
    outer_chain = ends_exact & F.coalesce(c("c_map") == 1, F.lit(False))
    inner_chain = ends_exact & (c("m_map") == 1)
    cut = ranges.common(c("c_lo"), c("c_hi"), c("m_lo"), c("m_hi"))
    outer = ranges.narrowed(c("o_lo"), c("o_hi"), c("o_exact"), outer_chain, c("c_lo"), *cut)
    inner = ranges.narrowed(c("n_lo"), c("n_hi"), c("n_exact"), inner_chain, c("m_lo"), *cut)
    there = c("outer_net_id").isNotNull()
    made = {
        "conn_id": c("id"), "outer_lo": F.when(there, outer[0]), "outer_hi": F.when(there, outer[1]),
        "outer_exact": F.when(there, F.when(outer_chain | (c("m_lo").isNull() & c("m_hi").isNull()), c("o_exact")).otherwise(0)),
        "inner_lo": inner[0], "inner_hi": inner[1],
        "inner_exact": F.when(inner_chain | (c("c_lo").isNull() & c("c_hi").isNull()), c("n_exact")).otherwise(0),
        "map_exact": F.when(there, F.when(c("conn_kind") == "expression_operand", F.lit(0)).otherwise(ranges.both(c("c_map"), c("m_map")))),
    }
    return df.select(*((made[x] if x in made else c(x)).alias(x) for x in ARC))



def _null(kind: str = "long") -> Column:
    return F.lit(None).cast(kind)


def _side(view: str, df: DataFrame, signal: tuple, other: tuple | None, kind: Column, **ids: str | Column) -> DataFrame:
    """Rows of v_driver or v_load. signal, other: (net, instance, name, lo, hi, exact) columns; other may be absent."""
    word = "driver" if view == "v_driver" else "load"
    types = ("long", "long", "string", "long", "long", "int")
    parts = ("net_id", "inst_id", "name", "lo", "hi", "exact")
    names: dict[str, str | Column] = {f"signal_{p}": x for p, x in zip(parts, signal, strict=True)}
    names |= {f"{word}_{p}": x for p, x in zip(parts, other or [_null(k) for k in types], strict=True)}
    names |= {c: ids.get(c, _null("int" if c == "map_exact" else "long")) for c in ("dep_id", "conn_id", "stmt_id", "prim_id", "proc_id", "term_id", "map_exact", "call_site_id")}
    return _of(view, df, **names, **{f"{word}_kind": kind})


def _window(net: str, end: str, side: str) -> tuple:
    return (net, f"{end}_inst", f"{end}_name", f"{side}_lo", f"{side}_hi", f"{side}_exact")


def _arcs_placed(t: Tables, directions: tuple, outer: str) -> DataFrame:
    df = conn_arc(t).where(F.col("direction").isin(*directions))
    return _placed(_with_end(_with_end(df, t, "inner_net_id", "in"), t, "outer_net_id", "out", outer), t, "file_id")


def _root_terms(t: Tables, directions: tuple) -> DataFrame:
    roots = t["tree_node"].where("node_kind = 'root'").select(F.col("id").alias("__root"))
    terms = t["term"].where(F.col("direction").isin(*directions)).join(roots, F.col("inst_id") == F.col("__root"), "left_semi").select(F.col("id").alias("t_id"), "file_id", "line", "col")
    return _placed(_with_end(t["term_map"].join(terms, F.col("term_id") == F.col("t_id")), t, "inner_net_id", "n"), t, "file_id")


def driver(t: Tables) -> DataFrame:
    """What drives each net: dependencies, connections from outside, connections from inside, pins of roots."""
    c = F.col
    kind = F.when(c("src_net_id").isNotNull(), c("dep_kind")).when(c("src_hier_ref_id").isNotNull(), "external").when(c("s_stmt_kind") == "system_task", "system_task").when(c("dep_kind") != "data", c("dep_kind")).otherwise("constant")
    inner, outer = _window("inner_net_id", "in", "inner"), _window("outer_net_id", "out", "outer")
    arc_kind = F.when(c("conn_kind") == "expression_operand", "connection_expression").when(c("conn_kind") == "constant", "constant").otherwise("connection")
    arcs = {"conn_id": "conn_id", "map_exact": "map_exact"}
    return (
        _side("v_driver", _deps(t, "left"), _window("tgt_net_id", "tn", "tgt"), _window("src_net_id", "sn", "src"), kind, dep_id="id", stmt_id="stmt_id", prim_id="prim_id", map_exact="map_exact", call_site_id="call_site_id")
        .unionByName(_side("v_driver", _arcs_placed(t, INTO, "left"), inner, outer, arc_kind, **arcs))
        .unionByName(_side("v_driver", _arcs_placed(t, OUT_OF, "inner").where(c("conn_kind").isin("signal", "external_reference")), outer, inner, F.lit("connection"), **arcs))
        .unionByName(_side("v_driver", _root_terms(t, INTO), _window("inner_net_id", "n", "inner"), None, F.lit("terminal"), term_id="term_id"))
    )


def driving(t: Tables) -> DataFrame:
    """(signal, driver, stmt_id, prim_id, conn_id, conn_kind, call_site_id): the rows of v_driver with a driver, of ids alone."""
    c = F.col
    none = _null()
    deps = t["net_dep"].where(c("src_net_id").isNotNull()).select(c("tgt_net_id").alias("signal"), c("src_net_id").alias("driver"), "stmt_id", "prim_id", none.alias("conn_id"), _null("string").alias("conn_kind"), "call_site_id")
    into = F.when(c("direction").isin(*INTO), F.struct(c("inner_net_id").alias("signal"), c("outer_net_id").alias("driver")))
    out = F.when(c("direction").isin(*OUT_OF) & c("conn_kind").isin("signal", "external_reference"), F.struct(c("outer_net_id").alias("signal"), c("inner_net_id").alias("driver")))
    arcs = conn_arc(t).where(c("outer_net_id").isNotNull()).select("conn_id", "conn_kind", F.explode(F.array_compact(F.array(into, out))).alias("e"))
    return deps.unionByName(arcs.select("e.signal", "e.driver", none.alias("stmt_id"), none.alias("prim_id"), "conn_id", "conn_kind", none.alias("call_site_id")))


def root_pins(t: Tables, directions: tuple) -> DataFrame:
    """(net_id) of the nets inside pins of roots."""
    roots = t["tree_node"].where("node_kind = 'root'").select(F.col("id").alias("inst_id"))
    pins = t["term"].where(F.col("direction").isin(*directions)).join(roots, "inst_id", "left_semi").select(F.col("id").alias("term_id"))
    return t["term_map"].join(pins, "term_id", "left_semi").select(F.col("inner_net_id").alias("net_id"))


def driven(t: Tables) -> DataFrame:
    """(net_id), repeated: all nets in v_driver."""
    lone = conn_arc(t).where(F.col("outer_net_id").isNull() & F.col("direction").isin(*INTO)).select(F.col("inner_net_id").alias("net_id"))
    return t["net_dep"].select(F.col("tgt_net_id").alias("net_id")).union(driving(t).select("signal")).union(lone).union(root_pins(t, INTO))


def read(t: Tables) -> DataFrame:
    """(net_id), repeated: all nets in v_load. Reads that a dependency names are in it by the dependency's source."""
    out = driving(t).select(F.col("driver").alias("net_id")).union(root_pins(t, OUT_OF)).union(t["proc_event"].select("net_id"))
    unnamed = lambda table, by: t[table].join(t["net_dep"].where(F.col(by).isNotNull()).select(F.col(by).alias("id")), "id", "left_anti")
    spoken = t["expr_ref"].where(F.col("role").isin("assertion", "wait", "event", "system_task"))
    return out.union(spoken.select("net_id")).union(unnamed("expr_ref", "expr_ref_id").select("net_id")).union(unnamed("assign_operand", "assign_operand_id").select("net_id")).where("net_id is not null")


def load(t: Tables) -> DataFrame:
    """What reads each net: dependencies, both directions of connections, events, reads that no dependency names, pins of roots."""
    c = F.col
    inner, outer = _window("inner_net_id", "in", "inner"), _window("outer_net_id", "out", "outer")
    arcs = {"conn_id": "conn_id", "map_exact": "map_exact"}
    stmts = _as(t["stmt"].select("id", "proc_id", "file_id", "line", "col"), "s")
    event = _placed(_with_end(t["proc_event"], t, "net_id", "n"), t, "file_id").withColumns({"lo": _null(), "hi": _null(), "is_exact": F.lit(1)})
    read = ("net_id", "n_inst", "n_name", "lo", "hi", "is_exact")

    def unnamed(table: str, by: str) -> DataFrame:
        named = t["net_dep"].where(c(by).isNotNull()).select(c(by).alias("__named")).distinct()
        return t[table].join(named, c("id") == c("__named"), "left")

    def placed_reads(df: DataFrame) -> DataFrame:
        return _placed(_with_end(df.join(stmts, c("stmt_id") == c("s_id")), t, "net_id", "n"), t, "s_file_id", "s_line", "s_col")

    refs = placed_reads(unnamed("expr_ref", "expr_ref_id").where(c("role").isin("assertion", "wait", "event", "system_task") | c("__named").isNull()))
    operands = placed_reads(unnamed("assign_operand", "assign_operand_id").where(c("__named").isNull()))
    role = F.when(c("role") == "wait", "wait").when(c("role") == "event", "sensitivity").otherwise("statement")
    return (
        _side("v_load", _deps(t, "inner"), _window("src_net_id", "sn", "src"), _window("tgt_net_id", "tn", "tgt"), F.when(c("dep_kind") == "alias", "alias").otherwise("dataflow"), dep_id="id", stmt_id="stmt_id", proc_id="s_proc_id", map_exact="map_exact", call_site_id="call_site_id")
        .unionByName(_side("v_load", _arcs_placed(t, INTO, "inner"), outer, inner, F.lit("connection"), **arcs))
        .unionByName(_side("v_load", _arcs_placed(t, OUT_OF, "inner").where(c("conn_kind").isin("signal", "external_reference")), inner, outer, F.lit("connection"), **arcs))
        .unionByName(_side("v_load", event, read, None, c("event_kind"), stmt_id="stmt_id", proc_id="proc_id"))
        .unionByName(_side("v_load", refs, read, None, role, stmt_id="stmt_id", proc_id="s_proc_id"))
        .unionByName(_side("v_load", operands, read, None, F.lit("statement"), stmt_id="stmt_id", proc_id="s_proc_id"))
        .unionByName(_side("v_load", _root_terms(t, OUT_OF), _window("inner_net_id", "n", "inner"), None, F.lit("terminal"), term_id="term_id"))
    )


def stmt(t: Tables) -> DataFrame:
    return _of("v_stmt", _placed(_modules(t["stmt"], t), t, "file_id"), stmt_id="id")


def stmt_target(t: Tables) -> DataFrame:
    return _of("v_stmt_target", _with_end(t["stmt_target"], t, "net_id", "n"), target_id="id", net_name="n_name", tgt_lo="lo", tgt_hi="hi", tgt_exact="is_exact")


def stmt_operand(t: Tables) -> DataFrame:
    return _of("v_stmt_operand", _with_end(t["assign_operand"], t, "net_id", "n"), operand_id="id", net_name="n_name", operand_lo="lo", operand_hi="hi", operand_exact="is_exact")


def net_attachment(t: Tables) -> DataFrame:
    """Everything that hangs on a net, each row with exactly one typed id."""
    c = F.col

    def rows(df: DataFrame, net: str, kind: Column | str, lo, hi, exact, stmt=None, **typed: str) -> DataFrame:
        df = _with_end(df, t, net, "end")
        names = {"net_id": net, "inst_id": "end_inst", "net_name": "end_name", "attachment_kind": F.lit(kind) if isinstance(kind, str) else kind, "lo": lo, "hi": hi, "exact": exact, "stmt_id": stmt if stmt is not None else _null()}
        return _of("v_net_attachment", df, **names, **{x: typed.get(x, _null()) for x in schema.VIEWS["v_net_attachment"][8:]})

    refs = t["hier_ref"].where(c("resolved_net_id").isNotNull())
    tied = t["net_conn"].select("term_id", "outer_hier_ref_id").join(refs, c("outer_hier_ref_id") == c("id"))
    written = t["stmt_target"].join(t["stmt"].select(c("id").alias("s_id"), "stmt_kind"), c("stmt_id") == c("s_id"))
    write_kind = F.when(c("stmt_kind") == "release", "release_target").when(c("stmt_kind") == "alias", "alias_binding").otherwise("written_by")
    own = ("lo", "hi", "is_exact", "stmt_id")
    return (
        rows(t["term_map"], "inner_net_id", "terminal_inside", "inner_lo", "inner_hi", "inner_exact", term_id="term_id")
        .unionByName(rows(t["net_conn"], "outer_net_id", "actual_outside", "outer_lo", "outer_hi", "outer_exact", term_id="term_id"))
        .unionByName(rows(tied, "resolved_net_id", "actual_outside", "lo", "hi", "is_exact", term_id="term_id"))
        .unionByName(rows(written, "net_id", write_kind, *own, stmt_target_id="id"))
        .unionByName(rows(t["assign_operand"], "net_id", "read_by", *own, assign_operand_id="id"))
        .unionByName(rows(t["expr_ref"], "net_id", F.when(c("role") == "control", "condition").otherwise("statement_read"), *own, expr_ref_id="id"))
        .unionByName(rows(t["proc_event"], "net_id", "event", _null(), _null(), F.lit(1), "stmt_id", proc_id="proc_id"))
        .unionByName(rows(t["net_dep"], "tgt_net_id", "dep_in", "tgt_lo", "tgt_hi", "tgt_exact", "stmt_id", dep_id="id"))
        .unionByName(rows(t["net_dep"], "src_net_id", "dep_out", "src_lo", "src_hi", "src_exact", "stmt_id", dep_id="id"))
        .unionByName(rows(refs, "resolved_net_id", "named_from_outside", *own, hier_ref_id="id"))
    )


def call_site(t: Tables) -> DataFrame:
    return _of("v_call_site", _modules(t["call_site"], t), call_site_id="id")


VIEWS = {
    "v_db_info": db_info, "v_tree_node": tree_node, "v_net": net, "v_term": term, "v_term_map": term_map, "v_net_conn": net_conn, "v_net_dep": net_dep, "v_driver": driver,
    "v_load": load, "v_stmt": stmt, "v_stmt_target": stmt_target, "v_stmt_operand": stmt_operand, "v_net_attachment": net_attachment, "v_call_site": call_site,
}
