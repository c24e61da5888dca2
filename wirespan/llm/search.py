"""Ranked lexical search: document-at-a-time merge of compressed postings, shard by shard.

Index: each Spark task cuts its documents into shards of so many bytes of text, sorts a shard's documents by
doc_id and numbers them. A term's postings in a shard are a run of bytes: for each document the gap from the
last one's number, how often it has the term and how many terms it has in all. No text is shuffled, and the index is a
table, one row for each term of a shard, that any number of searches read.

Search: a join on the terms (salted by shard) brings the postings that the items ask for to groups of one shard and
one block of items. There each item's lists are merged by a heap of their next documents, in the order of the documents, and a heap of the k best, keyed by score and then doc_id,
gives the score that a document must beat. Lists whose greatest gains together do not beat it are no longer merged, only looked up for documents
that others name, and no more of them than can still matter: exact, as a later document with an equal score loses. What shards give is at most k rows an item; Spark
ranks these for each item, cutting to k before it shuffles.

Weights (BM25 in whole numbers): w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a term gives w ((10^9 tf) div (1000 tf + 8 m)).

Defined cases: a null text has no terms, and rows without terms do not count in N. Each row is a document of its own, whatever its doc_id:
repeated rows rank one by one, null doc_ids before all others of an equal score. An item without terms, or whose terms nothing has, gives no rows; rows with equal item_id are one
item. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.llm import codec
from wirespan.llm.common import slices, written

TOP = 10
#: Bytes of text in a shard, items in a block (about), and shards that share a part of a term's join.
SHARD_BYTES, BLOCK_ITEMS, SALT_SHARDS = 16 << 20, 256, 256
#: A-Z to lower case, what no term has to blanks; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
INDEX = "shard long, term string, df long, postings binary, doc_ids array<long>, total long"
HITS = "item_id {item}, shard long, number long, score long"


class _Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _shard(shard: int, ids: list, texts: list) -> pa.RecordBatch:
    """INDEX rows of one shard: one for each term, and one without a term for the documents that have terms."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    known, runs, kept, sizes = _Numbers(), [], [], []
    for k in order:
        terms = terms_of(texts[k])
        if terms:
            runs.append(np.fromiter(map(known.__getitem__, terms), np.int64, len(terms)))
            kept.append(ids[k])
            sizes.append(len(terms))
    if not kept:
        return pa.RecordBatch.from_pylist([], schema=_schema())
    n_docs, sizes = len(kept), np.array(sizes, np.int64)
    pairs, tf = np.unique(np.concatenate(runs) * n_docs + np.repeat(np.arange(n_docs), sizes), return_counts=True)
    term, doc = np.divmod(pairs, n_docs)
    first = np.flatnonzero(np.diff(term, prepend=-1))  # every term has a posting, so these are as many as terms
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    data, ends = codec.varbytes(np.stack([gaps, tf, sizes[doc]], 1).reshape(-1))
    cuts = np.concatenate([[0], ends[2::3][np.append(first[1:], len(doc)) - 1]])
    postings = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    words = pa.array([t.decode("utf-8", "replace") for t in known], pa.string())
    df = np.diff(np.append(first, len(doc)))
    none = pa.nulls(len(first), pa.list_(pa.int64()))
    own = pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard)), words, pa.array(df), postings, none, pa.nulls(len(first), pa.int64())], schema=_schema())
    docs = pa.RecordBatch.from_pylist([{"shard": shard, "df": n_docs, "doc_ids": kept, "total": int(sizes.sum())}], schema=_schema())
    return pa.concat_batches([own, docs])


def _schema() -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("total", pa.int64())])


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX as a table in the shared folder. The row of a shard without a term has its documents by number, and how many terms they have together."""

    def run(batches):
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for whole in batches:
            for batch in slices(whole, limit=shard_bytes):
                own = batch.column("text").cast(pa.binary())
                ids += batch.column("doc_id").cast(pa.int64()).to_pylist()
                texts += own.to_pylist()
                size += own.nbytes
                if size >= shard_bytes:
                    yield _shard(shard, ids, texts)
                    shard, ids, texts, size = shard + 1, [], [], 0
        if ids:
            yield _shard(shard, ids, texts)

    return written(docs.select("doc_id", "text").mapInArrow(run, INDEX))


def _queries(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    item = items.schema["item_id"].dataType

    def run(batches):
        for batch in batches:
            found = [sorted({t.decode("utf-8", "replace") for t in terms_of(x)}) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array([t for x in found for t in x], pa.string())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {item.simpleString()}, term string").distinct()


class Postings:
    """One term's documents in a shard, by number, what each gains from the term, and the most that any does."""

    __slots__ = ("docs", "gains", "bound")

    def __init__(self, data: bytes, weight: int, n_all: int, total: int):
        gaps, tf, n = codec.from_varbytes(data).reshape(-1, 3).T
        m = 10 + 90 * n * n_all // total if int(n.max()) * 90 * n_all < 1 << 62 else np.array([10 + 90 * int(x) * n_all // total for x in n], np.int64)
        gains = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        self.docs, self.gains, self.bound = np.cumsum(gaps).tolist(), gains.tolist(), int(gains.max())


def best(lists: list[Postings], k: int = TOP) -> list[tuple[int, int]]:
    """(score, document) of the k best with a score above 0, of equal ones those with the least numbers; a merge of all lists in the order of documents."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    below = [0]  # below[i]: the most that lists before i give together
    for x in lists:
        below.append(below[-1] + x.bound)
    at, first, least = [0] * len(lists), 0, 0
    found: list[tuple[int, int]] = []  # (score, -document): the worst of the k best on top
    heads = [(x.docs[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            own = lists[i]
            score += own.gains[at[i]]
            at[i] += 1
            if at[i] < len(own.docs):
                heapq.heapreplace(heads, (own.docs[at[i]], i))
            else:
                heapq.heappop(heads)
        for i in range(first - 1, -1, -1):
            if score + below[i + 1] <= least:
                break
            own = lists[i]
            at[i] = bisect_left(own.docs, doc, at[i])
            if at[i] < len(own.docs) and own.docs[at[i]] == doc:
                score += own.gains[at[i]]
        if score > least:
            if len(found) < k:
                heapq.heappush(found, (score, -doc))
            else:
                heapq.heapreplace(found, (score, -doc))
            if len(found) == k and found[0][0] > least:
                least, before = found[0][0], first
                while first < len(lists) and below[first + 1] <= least:
                    first += 1
                if first > before:
                    heads = [(d, i) for d, i in heads if i >= first]
                    heapq.heapify(heads)
    return [(s, -d) for s, d in found]


def candidates(docs_index: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS, salt_shards: int = SALT_SHARDS) -> DataFrame:
    """HITS: the k best of each shard for each item."""
    heads = docs_index.where("term is null")
    stats = heads.agg(F.sum("df"), F.sum("total"), F.count(F.lit(1))).first()
    n_all, total, shards = (x or 0 for x in stats)
    asked = written(_queries(items))
    blocks = asked.select("item_id").distinct().count() // block_items + 1
    salts = shards // salt_shards + 1
    wanted = asked.select("term").distinct()
    counted = docs_index.select("term", "df").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_all) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    grouped = asked.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "term").agg(F.collect_list(F.struct("item_id")).alias("items"))
    weighted = grouped.join(counted.select("term", weight.alias("weight")), "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = docs_index.where("term is not null").select("shard", "term", "postings", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int").alias("salt"))
    met = salted.join(weighted, ["term", "salt"]).select("shard", "block", "weight", "items", "postings")
    item = items.schema["item_id"].dataType.simpleString()
    out = pa.schema([("item_id", _arrow_type(asked)), ("shard", pa.int64()), ("number", pa.int64()), ("score", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        lists: dict = {}
        for weight, owners, data in zip(table.column("weight").to_pylist(), table.column("items").to_pylist(), table.column("postings").to_pylist(), strict=True):
            own = Postings(data, weight, n_all, total)
            for x in owners:
                lists.setdefault(x["item_id"], []).append(own)
        shard = table.column("shard")[0].as_py()
        rows = [(x, number, score) for x, own in lists.items() for score, number in best(own, k)]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], out.field(0).type), pa.array([shard] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], schema=out)

    return met.groupBy("shard", "block").applyInArrow(merge, HITS.format(item=item))


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["item_id"].dataType)


def search(docs_index: DataFrame, items: DataFrame, k: int = TOP, **params) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    hits = candidates(docs_index, items, k, **params)
    numbered = docs_index.where("term is null").select(F.col("shard").alias("__shard"), F.posexplode("doc_ids").alias("__number", "doc_id"))
    named = hits.join(numbered, (F.col("shard") == F.col("__shard")) & (F.col("number") == F.col("__number"))).select("item_id", "doc_id", "score", "shard", "number")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "shard", "number"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
