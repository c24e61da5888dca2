"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions.tables import discard, written  # noqa: F401

#: The white space of the contracts: space and \\t \\n \\v \\f \\r.
WHITE = " \t\n\x0b\x0c\r"
#: Python workers take texts in slices of about so many bytes.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text"):
    """With doc_id, names a row: rows equal in both are judged alike."""
    return F.xxhash64(F.col(text))


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "left", heavy: int = 4096) -> DataFrame:
    """left joined to right (one row for each key, with n: how many rows of left have it). A key with more than 1/heavy of all those rows
    (at most heavy keys, so they are broadcast) is dealt by a hash of the column `by` into as many parts as it has such shares."""
    share = (right.agg(F.sum("n")).first()[0] or 0) // heavy + 1
    parted = right.withColumn("__parts", F.expr(f"cast((n + {share - 1}) div {share} as int)"))
    large = F.broadcast(parted.where("__parts > 1").select(*on, "__parts"))
    dealt = left.join(large, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = parted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__parts"), F.lit(1)) - 1))).drop("__parts", "n")
    return dealt.join(copies, [*on, "__part"], how).drop("__part")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in runs of rows with about `limit` bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Returns what is free in Arrow's pool and on the C heap to the system. Elsewhere than with glibc the heap stays as it is."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(run):
    """run, a function of a task's batches, that gives free memory back when the task ends. Spark keeps Python workers for later
    stages, and what they hold meanwhile counts beside the executor's heap."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs without white space) of all texts, one after another, and where each text's begin (with the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(some), at[ends]


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def multipliers(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of the `width` words from each position on; windows may cross texts, callers mask those."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(multipliers(width, seed)):
        out += words[k : k + n] * m
    return mixed(out)


def window_mask(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n positions start a window that lies within its text."""
    step = np.zeros(n + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:] - width + 1
    full = ends > starts
    np.add.at(step, starts[full], 1)
    np.add.at(step, ends[full], -1)
    return np.cumsum(step[:-1]) > 0
