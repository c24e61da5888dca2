"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of
near-duplicates stays, contaminated documents go, and the rest is packed into sequences.

Every stage but the last returns the columns it is given, whatever others there are beside those of documents.
Rows are judged one by one, so nulls in doc_id or other columns do no harm and repeated rows fare alike (but for the stage that
drops copies). A null or empty text is clean, has no repeated line, is no copy of another, and is packed as the end token. Empty tables give empty tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wirespan.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from wirespan.llm.common import table, written
from wirespan.llm.queries import fold_of

#: Bytes of rows that a Python worker takes at once (a longer row goes alone). Arrow doubles its buffers on both sides, and an executor that has run every
#: stage keeps what they have grown to.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def in_small_batches(stage):
    """stage, run with batches of BATCH bytes. The setting stays in the session, as the caller runs what the stage returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more. The lexicon is learned from the labelled documents of
    the folder, not from what earlier stages kept of them. Null and empty texts score as texts without matches and stay."""
    labels = table(spark, sf_dir, "labels").where(fold_of(4) != 2)
    return toxicity.drop_toxic(docs, toxicity.learn(table(spark, sf_dir, "documents"), labels), 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines whose keys ten rows or more have; n_chars counts what is left. A null text stays null; blank lines stay."""
    return line_dedup.drop_lines(docs, min_docs=10, keep="none", min_chars=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id (null last; of equal ids the least digest of the text). Repeated
    rows are copies, so one stays; rows without words all stay."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more stands in the benchmark. Null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, sources mixed in proportion to their tokens to the power 0.7. Null sources are one source; repeated rows are packed one by one."""
    return packing.pack(docs, temperature=packing.TEMPERATURE)


STAGES = [(name, in_small_batches(stage)) for name, stage in (("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack))]

#: No SQL: classification, similarity and tokens are beyond it. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents. Each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
