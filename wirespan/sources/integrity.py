"""Whether tables hold what was written: row counts and digests that no order of rows changes.

A row's digest is the first 48 bits of the md5 of its values, each with its length before it, so that no value passes for two; a table's digest is the
sum of those of its rows. A changed, lost or doubled row changes the sum, and Spark adds it up before it shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.sources import schema

MANIFEST = "table_name string, n_rows long, digest string"


def row_digest(columns: list[str]) -> Column:
    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.conv(F.substring(F.md5(F.concat(*(told(c) for c in columns)).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")


def table_digest(name: str, df: DataFrame) -> DataFrame:
    """One row of MANIFEST."""
    total = F.coalesce(F.sum(row_digest(schema.TABLES[name].names)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("digest")).select(F.lit(name).alias("table_name"), "n_rows", "digest")


def digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """MANIFEST of all tables."""
    return reduce(DataFrame.unionByName, (table_digest(t, tables[t]) for t in schema.TABLES))


def problems(recorded: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, problem, recorded, found) for each table that is not as its manifest says: rows (other count), content (other digest), missing (not
    in the manifest)."""
    found = digests(tables).withColumnsRenamed({"n_rows": "f_rows", "digest": "f_digest"})
    both = found.join(recorded, "table_name", "left")
    problem = F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") != F.col("f_rows"), "rows").when(F.col("digest") != F.col("f_digest"), "content")
    text = lambda rows, digest: F.when(F.col("problem") == "content", F.col(digest)).otherwise(F.col(rows).cast("string"))
    return both.withColumn("problem", problem).where("problem is not null").select("table_name", "problem", text("n_rows", "digest").alias("recorded"), text("f_rows", "f_digest").alias("found"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")
