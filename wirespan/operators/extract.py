"""From references in statements, ports and connections to the rows of a template.

The inputs are staging rows, which a front end would give: each reference with the window of its net
(lo, hi, exact; null ends for the whole) and, where it has a place in the value of its statement, the window
it fills there (slot_lo, slot_hi; null where it has none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import ranges

PARTS = ("net_id", "lo", "hi", "exact", "slot_lo", "slot_hi")


def _named(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("id").alias(f"{prefix}_id"), *(F.col(c).alias(f"{prefix}_{c}") for c in PARTS))


def assign_deps(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each target and source of a statement that share bits of its value, both windows narrowed to
    them; a target that nothing reaches gets a row without a source. map_exact: bit for bit."""
    t, s = _named(targets, "t", "stmt_id"), _named(sources.withColumnRenamed("stmt_id", "__stmt"), "s", "__stmt")
    c = F.col
    meet = (c("stmt_id") == c("__stmt")) & ranges.overlap(c("t_slot_lo"), c("t_slot_hi"), c("s_slot_lo"), c("s_slot_hi"))
    df = t.join(s, meet, "left")
    placed = c("t_slot_lo").isNotNull() & c("s_slot_lo").isNotNull()
    cut = ranges.common(c("t_slot_lo"), c("t_slot_hi"), c("s_slot_lo"), c("s_slot_hi"))
    t_lo, t_hi = ranges.narrowed(c("t_lo"), c("t_hi"), c("t_exact"), placed, c("t_slot_lo"), *cut)
    s_lo, s_hi = ranges.narrowed(c("s_lo"), c("s_hi"), c("s_exact"), placed, c("s_slot_lo"), *cut)
    there = c("s_id").isNotNull()
    exact = placed & (c("t_exact") == 1) & (c("s_exact") == 1)
    return df.select(
        "stmt_id", c("t_id").alias("stmt_target_id"), c("s_id").alias("assign_operand_id"), c("t_net_id").alias("tgt_net_id"), F.when(there, t_lo).otherwise(c("t_lo")).alias("tgt_lo"), F.when(there, t_hi).otherwise(c("t_hi")).alias("tgt_hi"), c("t_exact").alias("tgt_exact"),
        c("s_net_id").alias("src_net_id"), s_lo.alias("src_lo"), s_hi.alias("src_hi"), c("s_exact").alias("src_exact"), F.when(there, exact.cast("int")).alias("map_exact"), F.lit("data").alias("dep_kind"),
    )


def control_deps(targets: DataFrame, gates: DataFrame) -> DataFrame:
    """Each read that decides whether a statement runs, with each target of the statement; never bit for bit."""
    t = targets.select("stmt_id", F.col("id").alias("stmt_target_id"), F.col("net_id").alias("tgt_net_id"))
    g = gates.select("stmt_id", F.col("id").alias("expr_ref_id"), F.col("net_id").alias("src_net_id"))
    return t.join(g, "stmt_id").withColumns({"map_exact": F.lit(0), "dep_kind": F.lit("control")})


def self_reads(targets: DataFrame) -> DataFrame:
    """The reads a compound assignment (a += b) adds: its own targets, without a place in the value."""
    none = F.lit(None).cast("long")
    return targets.where("compound").select("stmt_id", "id", "net_id", "lo", "hi", "exact", none.alias("slot_lo"), none.alias("slot_hi"))


def call_deps(bindings: DataFrame) -> DataFrame:
    """From (call_site_id, formal_net_id, actual_net_id, direction): actual to formal for inputs, formal to actual for
    outputs, both for inout and ref."""
    into = bindings.where(F.col("direction").isin("input", "inout", "ref")).select("call_site_id", F.col("actual_net_id").alias("src_net_id"), F.col("formal_net_id").alias("tgt_net_id"))
    out = bindings.where(F.col("direction").isin("output", "inout", "ref")).select("call_site_id", F.col("formal_net_id").alias("src_net_id"), F.col("actual_net_id").alias("tgt_net_id"))
    return into.unionByName(out).withColumn("dep_kind", F.lit("procedure"))


def alias_deps(refs: DataFrame) -> DataFrame:
    """From (stmt_id, side, net_id): every ordered pair of different sides of an alias, and never a net with itself.
    map_exact is 0 where a side has several references."""
    sides = refs.join(refs.groupBy("stmt_id", "side").agg(F.count(F.lit(1)).alias("n")), ["stmt_id", "side"])
    a = sides.select("stmt_id", F.col("side").alias("a"), F.col("net_id").alias("src_net_id"), F.col("n").alias("n_a"))
    b = sides.select("stmt_id", F.col("side").alias("b"), F.col("net_id").alias("tgt_net_id"), F.col("n").alias("n_b"))
    out = a.join(b, "stmt_id").where("a <> b and src_net_id <> tgt_net_id")
    return out.select("stmt_id", "src_net_id", "tgt_net_id", ((F.col("n_a") == 1) & (F.col("n_b") == 1)).cast("int").alias("map_exact"), F.lit("alias").alias("dep_kind"))


def prim_deps(pins: DataFrame) -> DataFrame:
    """From (prim_id, terminal, net_id, direction, width): each input with each output of a primitive; an inout is both,
    but not with itself. An output without input has a row without a source. Bit for bit only between single bits."""
    ins = pins.where(F.col("direction").isin("input", "inout")).select("prim_id", F.col("terminal").alias("from"), F.col("net_id").alias("src_net_id"), F.col("width").alias("w_in"))
    outs = pins.where(F.col("direction").isin("output", "inout")).select(F.col("prim_id").alias("__prim"), F.col("terminal").alias("to"), F.col("net_id").alias("tgt_net_id"), F.col("width").alias("w_out"))
    df = outs.join(ins, (F.col("__prim") == F.col("prim_id")) & (F.col("from") != F.col("to")), "left")
    exact = F.when(F.col("src_net_id").isNotNull(), ((F.col("w_in") == 1) & (F.col("w_out") == 1)).cast("int"))
    return df.select(F.col("__prim").alias("prim_id"), "src_net_id", "tgt_net_id", exact.alias("map_exact"), F.lit("primitive").alias("dep_kind"))


def windows_from_right(parts: DataFrame, key: str = "term_id") -> DataFrame:
    """(key, ordinal, width) with lo and hi: parts written first are the high bits, as in a concatenation."""
    below = Window.partitionBy(key).orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("width").over(below), F.lit(0)).cast("long")
    return parts.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("width") - 1)


def term_maps(ports: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of term_map. ports: (term_id, expr_net_id, symbol_net_id): a port stands for the net of its internal expression, else of
    its internal symbol, as a whole. parts: (term_id, ordinal, net_id, lo, hi, exact, width): a port made of several expressions has a row for each, with the
    window of the terminal it fills, from the right. Ports with neither have none; one with parts is not mapped as a whole."""
    null = F.lit(None).cast("long")
    single = ports.join(parts.select("term_id").distinct(), "term_id", "left_anti").withColumn("inner_net_id", F.coalesce("expr_net_id", "symbol_net_id")).where("inner_net_id is not null")
    whole = single.select("term_id", F.lit(0).cast("long").alias("ordinal"), "inner_net_id", null.alias("term_lo"), null.alias("term_hi"), F.lit(1).alias("term_exact"), null.alias("inner_lo"), null.alias("inner_hi"), F.lit(1).alias("inner_exact"), F.lit(1).alias("map_exact"))
    placed = windows_from_right(parts.withColumnsRenamed({"lo": "inner_lo", "hi": "inner_hi"}))
    exact = F.col("exact").cast("int")
    made = placed.select("term_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("net_id").alias("inner_net_id"), F.col("lo").alias("term_lo"), F.col("hi").alias("term_hi"), F.lit(1).alias("term_exact"), "inner_lo", "inner_hi", exact.alias("inner_exact"), exact.alias("map_exact"))
    return whole.unionByName(made)


def copies(segments: DataFrame) -> DataFrame:
    """A replicated segment ({n{x}}), once for each copy; lo and hi move up by its width."""
    each = segments.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times").cast("long") - 1)))
    return each.withColumns({"lo": F.col("lo") + F.col("copy") * F.col("width"), "hi": F.col("lo") + (F.col("copy") + 1) * F.col("width") - 1})


def conn_kind(net: Column, reference: Column, interface: Column, constant: Column, expression: Column) -> Column:
    """The kind of a connection by what its actual names, of boolean columns."""
    return F.when(interface, "interface").when(expression, "expression_operand").when(reference, "external_reference").when(net, "signal").when(constant, "constant").otherwise("unconnected")


def bodies(instances: DataFrame) -> DataFrame:
    """(group_key, representative): instances (id, def_name, file, line, col, params) with equal bodies. Lengths before
    the parts keep one part from passing for two."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("def_name", "file", "line", "col", "params")]
    key = F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))
    return instances.withColumn("group_key", key).groupBy("group_key").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("occurrences"))


def definitions(modules: DataFrame) -> DataFrame:
    """One row for each (name, file_id, line), the least of its ids."""
    return modules.groupBy("name", "file_id", "line").agg(F.min("id").alias("id"))


def outward(refs: DataFrame) -> DataFrame:
    """References that leave an instance, once for each statement, expression and direction; the path is the canonical
    one, else the text as written, else the hierarchical name."""
    return refs.groupBy("stmt_id", "expression", "access").agg(F.min("id").alias("id"), F.min_by(F.coalesce("canonical", "written", "hierarchical"), "id").alias("path"))


def delay(text: Column) -> Column:
    """Delay text with single blanks; empty is none."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(plain != "", plain)
