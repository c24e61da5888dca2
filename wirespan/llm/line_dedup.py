"""Line deduplication with DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased; keys are hashed to
128 bits. The hash space is cut into ranges, and the rows of a range are sorted by hash, document
and position. In that stream a header row, which holds how many documents have the key and which
is the first, precedes the key's lines, so one pass decides each of them. The headers come from an
aggregation that Spark combines before it shuffles. A key with more than 1/`heavy` of all counted
lines (at most `heavy` keys, so they are broadcast) is salted by document into as many parts as it
has such shares, with a header for each, so no part outgrows the usual one. What comes out is a bitmap per
document: 64-bit masks of the lines kept, without the masks that keep everything. Texts are
shuffled once, when a caller applies the bitmaps.

Defined cases: a null text is one empty line, as is an empty text. Each row is one document,
whatever its doc_id; rows equal in doc_id and text are judged alike. A null doc_id is a document
of its own, ordered first. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespan.llm.common import WHITE, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() is faster, and the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    return F.transform(lines_of(ascii_lower(text)), lambda x: F.btrim(x, F.lit(WHITE)))


def _hashes(frame: DataFrame) -> DataFrame:
    """The key's two hashes. h2 is seeded before the key, not with h1: a seed after it would make h2 follow from h1."""
    return frame.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")}).drop("key")


def _salted(headers: DataFrame, heavy: int) -> DataFrame:
    """headers with salts: how many parts the lines of a key are dealt into."""
    share = (headers.agg(F.sum("n_docs")).first()[0] or 0) // heavy + 1
    return headers.withColumn("salts", F.expr(f"cast((n_docs + {share - 1}) div {share} as int)"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, range_bits: int = 16, heavy: int = 4096) -> DataFrame:
    """One row (doc_id, text_hash, keep) for each document that loses lines.

    min_docs: keys found in at least so many documents are repeated. keep="none" drops all their
    lines, keep="first" all but the first (by doc_id, then position). min_chars: shorter keys stay.
    keep is a map from i to a 64-bit mask of the lines 64*i to 64*i+63, with 1 for a line kept;
    masks without a 0 are left out.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), line_keys(F.col("text")).alias("keys"))
    long_enough = F.char_length("key") >= min_chars
    counted = (
        _hashes(named.select("doc_id", "text_hash", F.explode(F.array_distinct("keys")).alias("key")).where(long_enough))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first_doc"))
        .where(F.col("n_docs") >= min_docs)
    )
    headers = _salted(written(counted), heavy)
    large = headers.where("salts > 1").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "salts")
    by = F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("salts"))
    lines = _hashes(named.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key")).where(long_enough))
    lines = lines.join(F.broadcast(large), (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left").withColumn("salt", F.coalesce(by.cast("int"), F.lit(0)))
    headers = headers.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "first_doc")
    stream = (
        lines.select("h1", "h2", "salt", F.lit(1).alias("is_line"), "doc_id", "text_hash", "pos", F.lit(None).cast(headers.schema["first_doc"].dataType).alias("first_doc"))
        .unionByName(headers.select("h1", "h2", "salt", F.lit(0).alias("is_line"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(-1).alias("pos"), "first_doc"))
        .withColumn("range", F.shiftrightunsigned("h1", 64 - range_bits).cast("int"))
    )
    order = ["h1", "h2", "is_line", "doc_id", "text_hash", "pos"]
    passing = Window.partitionBy("range", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("is_line") == 0, F.struct("h1", "h2", "first_doc")), ignorenulls=True).over(passing)
    judged = stream.withColumn("header", header)
    repeated = (F.col("is_line") == 1) & (F.col("header.h1") == F.col("h1")) & (F.col("header.h2") == F.col("h2"))
    if keep == "first":
        own = Window.partitionBy("range", "salt", "h1", "h2", "is_line", "doc_id", "text_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        judged = judged.withColumn("first_pos", F.first("pos").over(own))
        first = F.col("header.first_doc").eqNullSafe(F.struct("doc_id", "text_hash")) & (F.col("first_pos") == F.col("pos"))
        repeated &= ~first
    bit = F.expr("shiftleft(1L, pos % 64)")
    masks = judged.where(repeated).groupBy("doc_id", "text_hash", F.expr("pos div 64").alias("i")).agg(F.bitwise_not(F.bit_or(bit)).alias("mask"))
    return masks.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("i", "mask"))).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with a column __keep, null where nothing is dropped. The bitmaps are the small side of a
    hash join, so texts are shuffled but not sorted."""
    left = docs.withColumn("__hash", F.xxhash64("text")).alias("d")
    right = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), F.col("keep").alias("__keep")).hint("shuffle_hash")
    return left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["__hash"] == right["__of"]), "left").drop("__id", "__of", "__hash")


def kept_lines(text: str = "text", keep: str = "__keep") -> Column:
    """The lines that stay, as an array."""
    masked = F.filter(lines_of(F.col(text)), lambda x, i: _bit(F.element_at(F.col(keep), F.shiftright(i, 6)), i))
    return F.when(F.col(keep).isNull(), lines_of(F.col(text))).otherwise(masked)


def _bit(mask: Column, i: Column) -> Column:
    return mask.isNull() | (F.getbit(mask, F.pmod(i, F.lit(64))) == 1)


def drop_lines(docs: DataFrame, **params) -> DataFrame:
    """docs with the repeated lines gone from text, and n_chars (if there) counted anew; a null text stays null."""
    out = with_bitmaps(docs, drop_bitmaps(docs, **params))
    text = F.when(F.col("__keep").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept_lines()))
    out = out.withColumn("text", text).drop("__keep")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the lines that stay, joined by \\n)."""
    out = with_bitmaps(docs.select("doc_id", "text"), drop_bitmaps(docs, **params))
    out = out.withColumns({"n_lines": F.size(lines_of(F.col("text"))).cast("long"), "kept": kept_lines()})
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"))
