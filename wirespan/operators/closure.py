"""Closures over edges: what is reached from seeds, and the nearest ancestor of a kind.

Spark's recursive CTEs cannot drop what was reached before, so a closure over a graph with cycles is a
loop: join the frontier to the edges, drop what has been seen, write the rest. All seeds go together.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions.tables import written
from wirespan.operators import views

MERGE_EVERY = 16


def reached(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, node, depth) for all nodes reached from (seed, node) over edges (src, dst), the seeds included.
    Null ends stop; cycles and repeated edges do no harm. max_rounds limits the depth."""
    steps = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    frontier = written(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    k = 0
    while max_rounds is None or k < max_rounds:
        k += 1
        new = frontier.select("seed", "node").join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = written(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % MERGE_EVERY == 0:
            seen = written(seen)
    return seen


def reached_by_site(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, site, node, depth): closures of all call sites in one run. edges: (src, dst, site), site null where no call is meant; seeds: (seed, site, node), site null
    where none is chosen yet. The site is part of the state: the first edge with a site binds it, and from then on only edges of that site or of none
    are taken, so two calls of one subroutine never mix though they share its formals. The same as reached() once for each site."""
    steps = written(edges.where("src is not null and dst is not null").select("src", "dst", F.col("site").alias("by")).distinct())
    frontier = written(seeds.select("seed", "site", "node").distinct().withColumn("depth", F.lit(0)))
    seen, k = frontier, 0
    while max_rounds is None or k < max_rounds:
        k += 1
        fits = F.col("by").isNull() | F.col("site").isNull() | (F.col("by") == F.col("site"))
        new = frontier.join(steps, (F.col("node") == F.col("src")) & fits).select("seed", F.coalesce("site", "by").alias("site"), F.col("dst").alias("node")).distinct()
        old = seen.select(F.col("seed").alias("__seed"), F.col("site").alias("__site"), F.col("node").alias("__node"))
        known = (F.col("seed") == F.col("__seed")) & F.col("site").eqNullSafe(F.col("__site")) & (F.col("node") == F.col("__node"))
        frontier = written(new.join(old, known, "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % MERGE_EVERY == 0:
            seen = written(seen)
    return seen


def sited_edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """From each net to its drivers, with the call site of the dependency, for reached_by_site()."""
    return views.driving(tables).select(F.col("signal").alias("src"), F.col("driver").alias("dst"), F.col("call_site_id").alias("site"))


def fan_in_edges(tables: Mapping[str, DataFrame], call_site: DataFrame | None = None) -> DataFrame:
    """From each net to its drivers. call_site: one id; edges of other call sites are left out, so calls do not mix."""
    return _edges(tables, "signal", "driver", call_site)


def fan_out_edges(tables: Mapping[str, DataFrame], call_site: DataFrame | None = None) -> DataFrame:
    """From each net to its loads: the same edges, turned around."""
    return _edges(tables, "driver", "signal", call_site)


def _edges(tables: Mapping[str, DataFrame], src: str, dst: str, call_site: DataFrame | None) -> DataFrame:
    """Of ids alone: the views' names and places are not joined."""
    arcs = views.driving(tables)
    if call_site is not None:
        arcs = arcs.where("call_site_id is null").unionByName(arcs.join(call_site.select("call_site_id").distinct(), "call_site_id", "left_semi"))
    return arcs.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def nearest(tree: DataFrame, targets: DataFrame, include_self: bool = False) -> DataFrame:
    """(node, ancestor): for each node of a tree (id, parent) the nearest ancestor that is in targets (id); null
    where there is none, and where parents go round in a circle. include_self: a node that is a target is its own."""
    tree = written(tree.select("id", "parent").join(targets.select(F.col("id").alias("t")).distinct(), F.col("id") == F.col("t"), "left").select("id", "parent", F.col("t").isNotNull().alias("hit")))
    at = tree.select(F.col("id").alias("node"), F.when(F.lit(include_self) & F.col("hit"), F.col("id")).alias("ancestor"), F.col("parent").alias("next"))
    up = tree.select(F.col("id").alias("u"), F.col("parent").alias("u_parent"), F.col("hit").alias("u_hit"))
    done, rounds = [], tree.count()
    while True:
        at = written(at)
        ended = F.col("ancestor").isNotNull() | F.col("next").isNull()
        done.append(at.where(ended).select("node", "ancestor"))
        rest = at.where(~ended)
        if rest.isEmpty():
            break
        rounds -= 1
        if rounds < 0 or (done[-1].isEmpty() and _circles(rest, tree)):
            done.append(rest.select("node", F.lit(None).cast("long").alias("ancestor")))
            break
        at = rest.join(up, F.col("next") == F.col("u"), "left").select("node", F.when(F.col("u_hit"), F.col("u")).alias("ancestor"), F.col("u_parent").alias("next"))
    return reduce(DataFrame.unionByName, done)


def _circles(rest: DataFrame, tree: DataFrame) -> bool:
    """Whether no node that is still sought from can end: the nodes above those left are all among themselves, without a target or an end."""
    at = rest.select(F.col("next").alias("n")).distinct()
    above = at.join(tree, F.col("n") == F.col("id"), "left").select("n", "parent", F.coalesce("hit", F.lit(False)).alias("hit"))
    open_ends = above.where("hit or parent is null")
    left = above.select("parent").where("parent is not null").join(at, F.col("parent") == F.col("n"), "left_anti")
    return open_ends.isEmpty() and left.isEmpty()
