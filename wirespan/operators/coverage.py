"""How much of a design is approximate: one row for each metric."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.operators import views
from wirespan.operators.verify import WINDOWS

METRIC = ["metric", "part", "whole", "percent"]


def _row(df: DataFrame, name: str, part: Column, whole: Column | None = None) -> DataFrame:
    counted = df.agg(F.coalesce(F.sum(part.cast("long")), F.lit(0)).cast("long").alias("part"), F.coalesce(F.sum(whole.cast("long")) if whole is not None else F.count(F.lit(1)), F.lit(0)).cast("long").alias("whole"))
    return counted.select(F.lit(name).alias("metric"), "part", "whole", F.when(F.col("whole") > 0, F.round(100.0 * F.col("part") / F.col("whole"), 2)).otherwise(0.0).alias("percent"))


def row_counts(t: Mapping[str, DataFrame], names: list[str]) -> DataFrame:
    rows = [t[n].agg(F.count(F.lit(1)).cast("long").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    return _union(rows)


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def inexact(t: Mapping[str, DataFrame]) -> DataFrame:
    """For each exactness column: rows that are not exact, of those that have the end; and coarse mappings."""
    rows = [_row(t[name].where(F.col(e).isNotNull()), f"{name}.{e}", F.col(e) == 0) for name, _, _, e in WINDOWS]
    rows += [_row(t[name].where(F.col("map_exact").isNotNull()), f"{name}.map_exact", F.col("map_exact") == 0) for name in ("net_dep", "net_conn")]
    return _union(rows)


def dropped(t: Mapping[str, DataFrame]) -> DataFrame:
    n = F.col("dropped_operand_count")
    total = t["stmt"].agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("operands"))
    return _row(t["stmt"], "stmt.dropped", n > 0).crossJoin(total)


def sourceless(t: Mapping[str, DataFrame]) -> DataFrame:
    return _row(t["net_dep"], "net_dep.sourceless", F.col("src_net_id").isNull())


def resolution(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row: references that name a net, those that name an instance only, all of them, and the percentage of the first."""
    net, inst = F.col("resolved_net_id").isNotNull(), F.col("resolved_inst_id").isNotNull()
    counted = t["hier_ref"].agg(F.count("resolved_net_id").alias("to_net"), F.count(F.when(inst & ~net, 1)).alias("to_instance_only"), F.count(F.lit(1)).alias("refs"))
    return counted.withColumn("percent", _percent("to_net", "refs"))


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(100.0 * F.col(part) / F.col(whole), 2)).otherwise(0.0)


def undriven(t: Mapping[str, DataFrame]) -> DataFrame:
    """Nets that nothing drives. An input, inout or ref pin of a root counts as driven by its terminal."""
    return t["net"].join(views.driven(t).select(F.col("net_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("net_id"), "inst_id", F.col("name").alias("net_name"))


def unused(t: Mapping[str, DataFrame]) -> DataFrame:
    return t["net"].join(views.read(t).select(F.col("net_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("net_id"), "inst_id", F.col("name").alias("net_name"))


def undriven_split(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row: undriven nets, those of them inside (not an input or inout of a root), how many nets are such inputs (the world drives those), all nets, and the percentage inside."""
    inputs = views.root_pins(t, ("input", "inout")).distinct()
    nets = t["net"].select(F.col("id").alias("net_id")).join(views.driven(t).distinct().withColumn("driven", F.lit(1)), "net_id", "left").join(inputs.withColumn("pin", F.lit(1)), "net_id", "left")
    bare = F.col("driven").isNull()
    counted = nets.agg(F.count(F.when(bare, 1)).alias("all_undriven"), F.count(F.when(bare & F.col("pin").isNull(), 1)).alias("internal"), F.count("pin").alias("root_inputs"), F.count(F.lit(1)).alias("nets"))
    return counted.withColumn("percent", _percent("internal", "nets"))


def expansion(t: Mapping[str, DataFrame]) -> DataFrame:
    """Occurrences for each distinct (module, parameters)."""
    real = t["inst"].where("module_id is not null")
    counted = real.agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("module_id", F.coalesce("param_signature", F.lit(""))).alias("variants"))
    return counted.select("occurrences", "variants", F.when(F.col("variants") > 0, F.round(F.col("occurrences") / F.col("variants"), 2)).otherwise(0.0).alias("ratio"))


META = "schema_version analysis_status tool_version slang_version producer_revision config_digest top error_count unresolved_count empty_procedure_count duplicate_path_count".split()


def meta(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the keys of META, null where one is missing."""
    return t["meta"].agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in META))


def bytes_of(spark: SparkSession, path: str) -> int:
    """The size of all files of a saved design."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def report(t: Mapping[str, DataFrame], names: list[str], as_json: bool = False, path: str | None = None) -> str:
    """All metrics as text; each is a few rows. path: where the design is saved, for its size."""
    parts = {"meta": meta(t), "rows": row_counts(t, names), "inexact": inexact(t), "dropped": dropped(t), "sourceless": sourceless(t), "references": resolution(t), "undriven": undriven_split(t), "expansion": expansion(t)}
    found = {k: [r.asDict() for r in df.collect()] for k, df in parts.items()}
    if path:
        found["bytes"] = [{"bytes": bytes_of(t["meta"].sparkSession, path)}]
    if as_json:
        return json.dumps(found, indent=1)
    return "\n".join(f"{k}: " + ", ".join(f"{c}={v}" for c, v in row.items()) for k, rows in found.items() for row in rows)
