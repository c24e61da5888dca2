"""Questions asked of a design."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.operators import closure, views

Tables = Mapping[str, DataFrame]


def of_nets(view: DataFrame, nets: list[int] | DataFrame, column: str = "signal_net_id") -> DataFrame:
    """Rows of a view for some nets: a filter for a list, which reaches the scans; a semi-join for a table (net_id)."""
    if isinstance(nets, DataFrame):
        return view.join(nets.select(F.col("net_id").alias(column)).distinct(), column, "left_semi")
    return view.where(F.col(column).isin(nets))


def multi_driven(t: Tables) -> DataFrame:
    """Nets with several drivers, other than constants, pins and aliases. Of ids alone; a dependency without a source counts
    if it is neither a constant, nor a system task's, nor an unresolved reference's."""
    d = t["net_dep"].where("dep_kind <> 'alias'")
    tasks = t["stmt"].where("stmt_kind = 'system_task'").select(F.col("id").alias("stmt_id"))
    bare = d.where("src_net_id is null and src_hier_ref_id is null and dep_kind <> 'data'").join(tasks, "stmt_id", "left_anti").select(F.col("tgt_net_id").alias("signal"), F.col("src_net_id").alias("driver"))
    arcs = views.driving(t).where("conn_kind <> 'constant'").select("signal", "driver")
    lone = views.conn_arc(t).where(F.col("outer_net_id").isNull() & (F.col("conn_kind") != "constant") & F.col("direction").isin(*views.INTO)).select(F.col("inner_net_id").alias("signal"), F.col("outer_net_id").alias("driver"))
    real = d.where("src_net_id is not null").select(F.col("tgt_net_id").alias("signal"), F.col("src_net_id").alias("driver")).union(bare).union(arcs).union(lone)
    return real.groupBy(F.col("signal").alias("signal_net_id")).agg(F.count(F.lit(1)).alias("n_drivers"), F.countDistinct("driver").alias("n_nets")).where("n_drivers > 1")


def by_name(t: Tables, pattern: str) -> DataFrame:
    """Nets whose name is like a pattern (% and _), whatever the case."""
    return t["net"].where(F.col("name").ilike(pattern)).select(F.col("id").alias("net_id"), "inst_id", F.col("name").alias("net_name"))


def by_parameter(t: Tables, name: str, value: str) -> DataFrame:
    return t["inst_param"].where((F.col("name") == name) & (F.col("value") == value)).select("inst_id")


def forced(t: Tables) -> DataFrame:
    """What force statements write."""
    at = t["stmt"].where("construct = 'force'").select(F.col("id").alias("stmt_id"), "inst_id")
    return t["stmt_target"].select("stmt_id", "net_id").join(at, "stmt_id").select("stmt_id", "inst_id", "net_id")


def two_way(t: Tables, by: str) -> DataFrame:
    """Pairs of nets that drive each other by the same statement, primitive or connection (by: stmt_id, prim_id or conn_id)."""
    arcs = views.driving(t).where(F.col(by).isNotNull()).select(by, F.col("driver").alias("a"), F.col("signal").alias("b")).distinct()
    back = arcs.select(F.col(by).alias("__by"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    return arcs.join(back, (F.col(by) == F.col("__by")) & (F.col("a") == F.col("__b")) & (F.col("b") == F.col("__a")) & (F.col("a") < F.col("b")), "left_semi")


def nearest_inst(t: Tables) -> DataFrame:
    """(node, ancestor): the nearest instance above each node."""
    return closure.nearest(t["tree_node"].select("id", F.col("parent_node_id").alias("parent")), t["inst"])


def scope_owner(t: Tables) -> DataFrame:
    """(node, ancestor): each node's instance, itself if it is one."""
    return closure.nearest(t["tree_node"].select("id", F.col("parent_node_id").alias("parent")), t["inst"], include_self=True)


def call_strings(t: Tables) -> DataFrame:
    """(call_site_id, caller_id, distance): all callers of each call site."""
    edges = t["call_site"].select(F.col("id").alias("src"), F.col("parent_call_site_id").alias("dst"))
    seeds = t["call_site"].select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return closure.reached(edges, seeds).where("depth > 0").select(F.col("seed").alias("call_site_id"), F.col("node").alias("caller_id"), F.col("depth").cast("long").alias("distance"))
