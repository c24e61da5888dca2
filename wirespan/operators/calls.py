"""Calls of subroutines, expanded by call site.

Every call is a site of its own: the body it runs is walked for it, and the calls in that body are sites below it. A subroutine that is already
being walked is not entered again (the call is a site without a body), and a module may walk just so many bodies; calls beyond that are sites
without a body, too, and counted.

Bodies are granted in document order, depth first. The loop goes by level, all modules and branches together, and a path of ordinals is a site's place in that
order. Of the sites found so far, one that is not among the first `budget` of its module cannot be among them later, as
more sites can only come before it: it is dropped at once. So a level holds at most `budget` bodies a module, however
fast the calls branch, and what remains at the end is what a walk one by one grants, whatever the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import running
from wirespan.functions.tables import discard, written

#: Bodies that a module may walk.
BUDGET = 4000
SITE = ["module_id", "path", "active", "subroutine", "stmt"]


def expand(roots: DataFrame, calls: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(module_id, idx, parent_idx, subroutine, depth, stmt, fate): the call sites of each module, numbered from 0 in document order.

    roots: (module_id, ordinal, callee, stmt, bindable), the calls outside of subroutines, ordinals unique within a module; calls: (caller, ordinal,
    callee, stmt, bindable), those in the bodies of subroutines, ordinals unique within a caller. stmt: the statement that calls, null where the call
    is in a condition (not bindable). fate: expanded, recursive or cut."""
    stmt = F.when(F.col("bindable"), F.col("stmt")).alias("stmt")
    first = roots.select("module_id", F.array(F.col("ordinal").cast("long")).alias("path"), F.array().cast("array<string>").alias("active"), F.col("callee").alias("subroutine"), stmt)
    bodies = written(calls.select("caller", F.col("ordinal").cast("long").alias("ordinal"), F.col("callee"), stmt.alias("__stmt")))
    sites = [written(first)]
    alive = written(_granted(sites[0].withColumn("round", F.lit(0)), budget))
    k = 0
    while True:
        frontier = alive.where(F.col("round") == k)
        if frontier.isEmpty():
            break
        k += 1
        below = frontier.join(bodies, F.col("subroutine") == F.col("caller")).select(
            "module_id", F.concat("path", F.array("ordinal")).alias("path"), F.concat("active", F.array("subroutine")).alias("active"), F.col("callee").alias("subroutine"), F.col("__stmt").alias("stmt"))
        sites.append(written(below))
        alive, old = written(_granted(alive.unionByName(sites[-1].withColumn("round", F.lit(k))), budget)), alive
        discard(old)
    granted = alive.select(F.col("module_id").alias("__m"), F.col("path").alias("__p"))
    found = reduce(DataFrame.unionByName, sites)
    above = F.slice("path", 1, F.size("path") - 1)
    top = found.where("size(path) = 1").withColumn("above", F.lit(None).cast("array<bigint>"))
    nested = found.where("size(path) > 1").withColumn("above", above).join(granted, (F.col("module_id") == F.col("__m")) & (F.col("above") == F.col("__p")), "left_semi")
    own = granted.withColumn("__walked", F.lit(True))
    walked = top.unionByName(nested).join(own, (F.col("module_id") == F.col("__m")) & (F.col("path") == F.col("__p")), "left")
    fate = F.when(F.col("__walked"), "expanded").when(F.array_contains("active", F.col("subroutine")), "recursive").otherwise("cut")
    placed = running.before(walked.select("module_id", "path", "above", "subroutine", "stmt", fate.alias("fate"), F.size("path").cast("long").alias("depth")), ["module_id"], ["path"], {"idx": F.lit(1)})
    placed = written(placed)
    parents = placed.where("fate = 'expanded'").select(F.col("module_id").alias("__m"), F.col("path").alias("__p"), F.col("idx").alias("parent_idx"))
    return placed.join(parents, (F.col("module_id") == F.col("__m")) & (F.col("above") == F.col("__p")), "left").select("module_id", "idx", "parent_idx", "subroutine", "depth", "stmt", "fate")


def _granted(sites: DataFrame, budget: int) -> DataFrame:
    """Of the sites whose subroutine is not being walked, the first of each module. Spark cuts to so many before it shuffles."""
    order = F.row_number().over(Window.partitionBy("module_id").orderBy("path"))
    return sites.where(~F.array_contains("active", F.col("subroutine"))).withColumn("__k", order).where(F.col("__k") <= budget).drop("__k")


def truncated(sites: DataFrame) -> DataFrame:
    """(module_id, sites, walked, cut): how many sites a module has, how many have bodies, and how many the budget cut."""
    is_ = lambda fate: F.sum((F.col("fate") == fate).cast("long"))
    return sites.groupBy("module_id").agg(F.count(F.lit(1)).alias("sites"), is_("expanded").alias("walked"), is_("cut").alias("cut"))


def body_rows(sites: DataFrame, statements: DataFrame) -> DataFrame:
    """The statements (subroutine, ordinal, ...) of each body, once for each call site that walks it."""
    return sites.where("fate = 'expanded'").select("module_id", F.col("idx").alias("call_site_idx"), F.col("subroutine").alias("__of"), "depth").join(statements, F.col("__of") == F.col("subroutine")).drop("__of")
