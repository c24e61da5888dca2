"""What a writer makes of values that stand for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = ("src_exact", "outer_exact", "term_exact", "map_exact", "is_const")


def text(c: Column) -> Column:
    """No text is null."""
    return F.nullif(c, F.lit(""))


def ident(c: Column) -> Column:
    """Ids begin at 1; 0 is none."""
    return F.nullif(c, F.lit(0))


def flag(c: Column) -> Column:
    """0, 1, or -1 for not known."""
    return F.nullif(c, F.lit(-1))


def width(c: Column) -> Column:
    """A width that is not known is below 0."""
    return F.when(c >= 0, c)


def encoded(rows: DataFrame, table: T.StructType) -> DataFrame:
    """rows with the columns and types of a table, and null where it may be null and a value stands for none: empty texts, ids of 0, flags and
    widths of -1, both ends of a window if either is below 0, and line and column without a file."""
    out = []
    for f in table.fields:
        c = F.col(f.name)
        if f.nullable and f.name in ("line", "col"):
            c = F.when(ident(F.col("file_id")).isNotNull(), c)
        elif f.nullable and f.name == "width":
            c = width(c)
        elif f.nullable and f.name.endswith(("lo", "hi")) and f.dataType == T.LongType():
            stem = f.name[:-2]
            c = F.when((F.col(f"{stem}lo") >= 0) & (F.col(f"{stem}hi") >= 0), c)
        elif f.nullable and f.name.endswith("_id"):
            c = ident(c)
        elif f.nullable and f.name in FLAGS:
            c = flag(c)
        elif f.nullable and f.dataType == T.StringType():
            c = text(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)
