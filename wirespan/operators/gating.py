"""Which conditions decide whether a statement runs.

A construct (if, case, for, while, do, repeat) is made of parts: conditions, initialisers, steps and bodies, each an interval [begin, end) of
positions in the text of its body of code; parts are nested or apart. The parts around a statement are found by a sweep over
positions: a running sum gives the nesting depth at each begin and statement, and on each level the last begin before a statement is the
part it is in. So rows are those of the result (a statement with each part around it), and no two rows of a body are compared.

A construct's conditions gate its bodies, whatever stands first in the text (do, case labels); they gate the steps of a loop, but
not its initialisers; and what is inside a condition is gated by that condition and those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions import running


def enclosing(parts: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, part_id, level): each statement (stmt_id, body_id, pos) with the parts (part_id, body_id, begin, end) around it, the outermost on level 1.
    Of intervals with one begin the longer is the outer; an empty interval holds nothing."""
    real = parts.where("begin < end")
    none = F.lit(None).cast("long")
    # At one position, ends come before begins, and a statement after both; of begins the longest first.
    opens = real.select("body_id", F.col("begin").alias("pos"), F.lit(1).alias("kind"), (-F.col("end")).alias("rank"), F.col("part_id").alias("item"), F.lit(1).alias("step"))
    closes = real.select("body_id", F.col("end").alias("pos"), F.lit(0).alias("kind"), (-F.col("begin")).alias("rank"), F.col("part_id").alias("item"), F.lit(-1).alias("step"))
    asked = statements.select("body_id", "pos", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("rank"), F.col("stmt_id").alias("item"), F.lit(0).alias("step"))
    events = opens.unionByName(closes).unionByName(asked)
    order = ["pos", "kind", "rank", "item"]
    deep = running.before(events, ["body_id"], order, {"depth": F.col("step")})
    begun = deep.where("kind = 1").select("body_id", (F.col("depth") + 1).alias("level"), *order)
    within = deep.where("kind = 2 and depth > 0").select("body_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("level"), *order)
    swept = running.before(begun.unionByName(within), ["body_id", "level"], order, lasts={"part_id": F.when(F.col("kind") == 1, F.col("item")).otherwise(none)})
    return swept.where("kind = 2").select(F.col("item").alias("stmt_id"), "part_id", "level")


def gated_by(parts: DataFrame, statements: DataFrame, refs: DataFrame) -> DataFrame:
    """(stmt_id, expr_ref_id, net_id, construct_id, level): the reads that gate each statement, as extract.control_deps takes them.

    parts: (part_id, construct_id, body_id, role, ordinal, begin, end), role being condition, initialiser, step or body, ordinal the place among the conditions;
    refs: (ref_id, part_id, net_id), the reads of conditions."""
    around = enclosing(parts, statements).join(parts.select("part_id", "construct_id", "role", F.col("ordinal").alias("at")), "part_id").where("role <> 'initialiser'")
    conditions = parts.where("role = 'condition'").select("part_id", F.col("construct_id").alias("__of"), F.col("ordinal").alias("before"))
    reads = refs.join(conditions, "part_id").select("__of", "before", F.col("ref_id").alias("expr_ref_id"), "net_id")
    gates = (F.col("construct_id") == F.col("__of")) & ((F.col("role") != "condition") | (F.col("before") <= F.col("at")))
    return around.join(reads, gates).select("stmt_id", "expr_ref_id", "net_id", "construct_id", "level")


def bindable(parts: DataFrame, statements: DataFrame) -> DataFrame:
    """(stmt_id, bindable): whether a call there belongs to a statement of its own: all parts around it are bodies."""
    around = enclosing(parts, statements).join(parts.select("part_id", "role"), "part_id")
    inside = around.where("role <> 'body'").select("stmt_id").distinct().withColumn("__in", F.lit(True))
    return statements.select("stmt_id").join(inside, "stmt_id", "left").select("stmt_id", F.col("__in").isNull().alias("bindable"))
