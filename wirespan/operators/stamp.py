"""Stamping: rows of templates repeated for each occurrence, with dense ids.

A template's rows are numbered from 0 within their group. Occurrences are ordered by a path key, so that
a parent precedes its children; each gets, for each table, the sum of the sizes before it as a base, and a
row's id is base + index + 1. The sums are built in two steps, within ranges of the order and over the
ranges, so no task sees all occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import running
from wirespan.functions.tables import written


def bases(occurrences: DataFrame, order: list[str], sizes: list[str]) -> DataFrame:
    """occurrences with base_<size> for each size column: its sum over the rows before, by the order (which must be unique)."""
    ranged = written(occurrences.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(*(F.sum(s).alias(f"__{s}") for s in sizes))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = parts.select("__part", *(F.coalesce(F.sum(f"__{s}").over(over), F.lit(0)).alias(f"__{s}") for s in sizes))
    out = ranged.withColumns({f"base_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sizes}).join(before, "__part")
    return out.withColumns({f"base_{s}": (F.col(f"base_{s}") + F.col(f"__{s}")).cast("long") for s in sizes}).drop("__part", *(f"__{s}" for s in sizes))


def replay(occurrences: DataFrame, template: DataFrame, base: str, refs: dict[str, str] | None = None, group: str = "group_key") -> DataFrame:
    """Template rows for each occurrence of their group. idx becomes id; refs: index columns of the template and the
    base each counts from, which become ids too; null stays null."""
    joined = occurrences.join(template, group)
    ids = {"id": F.col(base) + F.col("idx") + 1} | {c: F.col(b) + F.col(c) + 1 for c, b in (refs or {}).items()}
    return joined.withColumns(ids).drop("idx")


def path_keys(tree: DataFrame) -> DataFrame:
    """(id, path_key, level): a key that sorts nodes of (id, parent, ordinal) with parents before children and
    siblings by ordinal, then id; built level by level."""
    tree = written(tree.select("id", "parent", "ordinal"))
    step: Column = F.concat(F.lpad(F.col("ordinal").cast("string"), 12, "0"), F.lit(":"), F.lpad(F.col("id").cast("string"), 19, "0"))
    level = written(tree.where("parent is null").select("id", step.alias("path_key"), F.lit(0).alias("level")))
    out, k = level, 0
    while True:
        k += 1
        above = level.select(F.col("id").alias("a"), F.col("path_key").alias("above"))
        level = written(tree.join(above, F.col("parent") == F.col("a")).select("id", F.concat("above", F.lit("/"), step).alias("path_key"), F.lit(k).alias("level")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


SLOTS = {"generate": 0, "primitive": 1}


def reserved(nodes: DataFrame) -> DataFrame:
    """(id, node_id, level): the ids that a walk gives which, on entering an occurrence, takes ids for all it holds, its generate scopes first, then its
    primitives, then its children side by side, and only then descends into one child after another; a later sibling thus has an id before anything is below the first.

    nodes: (id, owner, kind, ordinal): owner is the occurrence that holds the node, null at the roots; kind generate or primitive, else a child (an instance, or a
    black box, which holds nothing). Equal ordinals go by id. How many ids are below each child is summed upwards by level; where a child's begin
    is a running sum over its elder siblings, handed down by level. No parent, and no level, is sorted in one task."""
    slot = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in SLOTS.items()), F.lit(2))
    given = nodes.select("id", "owner", slot.alias("slot"), "ordinal")
    held = running.before(given.where("owner is not null"), ["owner"], ["slot", "ordinal", "id"], {"nth": F.lit(1)})
    tops = given.where("owner is null").withColumn("nth", F.lit(0).cast("long"))
    tree = written(held.unionByName(tops))
    each = [written(tree.where("owner is null"))]
    while True:
        level = written(tree.join(each[-1].where("slot = 2").select(F.col("id").alias("__up")), F.col("owner") == F.col("__up"), "left_semi"))
        if level.isEmpty():
            break
        each.append(level)
    sized, below = [], None
    for level in reversed(each):
        if below is None:
            made = level.withColumns({"own": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("owner").alias("__of")).agg(F.count(F.lit(1)).alias("own"), F.sum("below").alias("__below"))
            made = level.join(sums, F.col("id") == F.col("__of"), "left").withColumns({"own": F.coalesce("own", F.lit(0)), "below": F.coalesce(F.col("own") + F.col("__below"), F.lit(0))}).drop("__of", "__below")
        below = written(made)
        sized.insert(0, below)
    elder = ["slot", "ordinal", "id"]
    roots = bases(sized[0].withColumn("n", F.col("below") + 1), elder, ["n"])
    at = written(roots.select("id", (F.col("base_n") + 1).alias("node_id"), (F.col("base_n") + 1).alias("start"), "own"))
    out = at.select("id", "node_id", F.lit(0).alias("level"))
    for k, level in enumerate(sized[1:], 1):
        placed = running.before(level, ["owner"], elder, {"past": F.col("below")})
        up = at.select(F.col("id").alias("__up"), F.col("start").alias("u_start"), F.col("own").alias("u_own"))
        at = written(placed.join(up, F.col("owner") == F.col("__up")).select("id", (F.col("u_start") + F.col("nth") + 1).alias("node_id"), (F.col("u_start") + F.col("u_own") + F.col("past")).alias("start"), "own"))
        out = out.unionByName(at.select("id", "node_id", F.lit(k).alias("level")))
    return out


def duplicate_siblings(tree: DataFrame) -> DataFrame:
    """One row: duplicates, the siblings beyond the first of each name."""
    return tree.groupBy("parent", "name").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def slot_pairs(targets: DataFrame, sources: DataFrame, key: str = "stmt_id") -> DataFrame:
    """Targets and sources of a statement that share bits of its value, with the bits they share. Both have
    (key, id, lo, hi), a null end being open; an equi-join on the key with the overlap as its condition."""
    from wirespan.functions import ranges

    t, s = targets.select(F.col(key), *(F.col(c).alias(f"tgt_{c}") for c in ("id", "lo", "hi"))), sources.select(F.col(key).alias("__key"), *(F.col(c).alias(f"src_{c}") for c in ("id", "lo", "hi")))
    met = t.join(s, (F.col(key) == F.col("__key")) & ranges.overlap(F.col("tgt_lo"), F.col("tgt_hi"), F.col("src_lo"), F.col("src_hi")))
    lo, hi = ranges.common(F.col("tgt_lo"), F.col("tgt_hi"), F.col("src_lo"), F.col("src_hi"))
    return met.select(key, "tgt_id", "src_id", lo.alias("lo"), hi.alias("hi"))


def interface_bindings(ports: DataFrame) -> DataFrame:
    """(term_id, bound_inst_id) for interface terminals (term_id, child_inst_id, via_term_id): a terminal is bound to an instance beside
    its own (child_inst_id) or passed on from a terminal of the instance above (via_term_id), which may be passed on itself. null where
    the chain leaves the design, breaks off or goes round. Each round doubles how far a terminal looks, so there are log(depth) rounds."""
    at = ports.select("term_id", F.col("child_inst_id").alias("bound_inst_id"), F.when(F.col("child_inst_id").isNull(), F.col("via_term_id")).alias("via"))
    rounds = 0
    while True:
        at = written(at)
        if rounds > 40 or at.where("via is not null").isEmpty():
            return at.select("term_id", "bound_inst_id")
        above = at.select(F.col("term_id").alias("a"), F.col("bound_inst_id").alias("a_bound"), F.col("via").alias("a_via"))
        at = at.join(above, F.col("via") == F.col("a"), "left").select("term_id", F.coalesce("bound_inst_id", "a_bound").alias("bound_inst_id"), F.when(F.col("via") != F.coalesce("a_via", F.lit(-1)), F.col("a_via")).alias("via"))
        rounds += 1


def pass_through(ports: DataFrame) -> DataFrame:
    """How each interface connection (term_id, child_inst_id, via_term_id) is bound: sibling, own port, or external (neither)."""
    way = F.when(F.col("child_inst_id").isNotNull(), "sibling").when(F.col("via_term_id").isNotNull(), "own port").otherwise("external")
    return ports.select("term_id", way.alias("binding"))


AT = ("file_id", "line", "col")


def unresolved(children: DataFrame, ports: DataFrame, conns: DataFrame, last_term: int = 0, last_conn: int = 0) -> dict[str, DataFrame]:
    """Rows of black boxes: tree_node, inst, term, net_conn. children: (id, parent_node_id, parent_inst_id, name, def_name, ordinal, file_id,
    line, col); ports: (inst_id, ordinal, name), one for each connection written; conns: (inst_id, port_ordinal, ordinal, conn_kind and the outer columns of net_conn).
    A terminal has no direction and a connection no terminal window of its own; a connection of a port that is not there is dropped.
    New ids follow last_term and last_conn in the order of instance and port."""
    null = F.lit(None).cast("long")
    nodes = children.select("id", "parent_node_id", "name", F.lit("unresolved").alias("node_kind"), "ordinal")
    insts = children.select("id", null.alias("module_id"), "parent_inst_id", F.lit(None).cast("string").alias("param_signature"), F.col("def_name").alias("unresolved_def"), *AT)
    own = ports.join(children.select(F.col("id").alias("inst_id"), *AT), "inst_id")
    numbered = bases(own.withColumn("n", F.lit(1)), ["inst_id", "ordinal"], ["n"]).withColumn("id", F.col("base_n") + last_term + 1)
    terms = numbered.select("id", "inst_id", "name", F.lit("signal").alias("term_kind"), F.lit(None).cast("string").alias("direction"), null.alias("data_type_id"), null.alias("width"), "ordinal", F.lit(None).cast("int").alias("is_const"), F.lit(None).cast("string").alias("modport"), *AT)
    of = terms.select("inst_id", F.col("ordinal").alias("port_ordinal"), F.col("id").alias("term_id"))
    joined = bases(conns.join(of, ["inst_id", "port_ordinal"]).withColumn("n", F.lit(1)), ["inst_id", "port_ordinal", "ordinal"], ["n"])
    return {"tree_node": nodes, "inst": insts, "term": terms, "net_conn": joined.withColumn("id", F.col("base_n") + last_conn + 1).drop("n", "base_n", "inst_id", "port_ordinal")}


def packages(given: DataFrame, members: DataFrame, last_module: int = 0, last_node: int = 0, last_net: int = 0) -> dict[str, DataFrame]:
    """Packages as occurrences above the roots: module, tree_node, inst, net. given: (package, ordinal, file_id, line, col); members:
    (package, ordinal, name, kind, decl_kind, data_type_id, width, is_implicit, file_id, line, col). The package std and nameless ones are left
    out, as are members without a name or other than variables and nets. Nothing drives a net here: who reads and writes it are references."""
    real = bases(given.where("package <> '' and package <> 'std'").withColumn("n", F.lit(1)), ["ordinal", "package"], ["n"])
    real = real.withColumns({"module_id": F.col("base_n") + last_module + 1, "id": F.col("base_n") + last_node + 1})
    null, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    own = members.where("name <> '' and kind in ('variable', 'net')").join(real.select("package", F.col("id").alias("inst_id")), "package")
    nets = bases(own.withColumn("n", F.lit(1)), ["inst_id", "ordinal", "name"], ["n"])
    return {
        "module": real.select(F.col("module_id").alias("id"), F.col("package").alias("name"), F.lit("package").alias("def_kind"), *AT),
        "tree_node": real.select("id", null.alias("parent_node_id"), F.col("package").alias("name"), F.lit("package").alias("node_kind"), F.col("base_n").alias("ordinal")),
        "inst": real.select("id", "module_id", null.alias("parent_inst_id"), text.alias("param_signature"), text.alias("unresolved_def"), *AT),
        "net": nets.select((F.col("base_n") + last_net + 1).alias("id"), "inst_id", F.col("inst_id").alias("scope_node_id"), "name", "decl_kind", "data_type_id", "width", "is_implicit", *AT),
    }
