"""Near-duplicates by BagMinHash signatures, banding and exact verification.

A text is a bag of shingles (five words, or all of a shorter text). Two texts are linked if the
multiset Jaccard similarity of their bags is at least `similarity`; classes are the connected parts.

Signature: each shingle's weight (its count) lies on an axis cut into the octaves [0, 1), [1, 2), [2, 4), ...
Every (shingle, octave) has a Poisson process whose rate is the octave's size; a point has an
arrival time, a place in the octave and a register. A text sees the points below its weight, and a
register keeps the first to arrive. Octaves under the weight are taken whole, so a weight of w costs
log w processes and not w; an octave the weight ends in is thinned. Two registers agree with a
probability that is the weighted Jaccard similarity. Generation stops once all registers are full
and no process can still beat the latest of them.

Links: texts equal in all characters become one node first, so copies cost a row each and no more.
Nodes that share a band meet in a bucket. Each is compared to the bucket's first node, which
joins most of what belongs together at a cost in proportion to the bucket. Then every pair of a bucket whose
classes still differ is verified, so no pair that meets is left out: as rows in a bucket of up to `few` nodes,
and in a larger one by blocks of nodes whose common shingles are counted as a product of matrices. Only the
blocks' work grows with the square, and only of buckets where texts of several classes meet (a long template
with similarity just under 0.8); a block names one link for each text and other class. Pairs are verified on
whole texts. With 24 bands of 4 two texts of similarity 0.8 share no bucket in 3 of a million cases.

Frequent keys (a bucket, the first node of one, a text with many copies) are joined in parts.

Defined cases: texts without words (null, empty, blank) are classes of their own. Null doc_ids take
part; a class is named by its least doc_id that is not null. Rows with the same doc_id but other texts are
nodes of their own. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import discard, give_back, hashed, mixed, rolling, salted_join, slices, thrifty, words_of, written

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
#: Buckets of up to so many nodes give their pairs as rows; larger ones are compared in blocks of about BLOCK
#: nodes or BLOCK_BYTES of text against as many, COLUMNS shingles at a time.
FEW, BLOCK, BLOCK_BYTES, COLUMNS = 32, 1024, 8 << 20, 2048
#: Bytes of text a worker signs at once; the processes of a shingle take some 150 bytes.
SIGN_BYTES = 2 << 20


def bag(words: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, sorted, and their counts."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(rolling(words, min(shingle, len(words))), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """m registers for each bag; of an empty bag, all 0."""
    out = np.zeros(len(bags) * m, np.uint64)
    sizes = np.array([len(h) for h, _ in bags], np.int64)
    if not sizes.sum():
        return out.reshape(-1, m)
    doc = np.repeat(np.arange(len(bags)), sizes)
    h, w = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    first = np.full(len(bags) * m, np.inf)
    # octave 0 is [0, 1), octave k is [2**(k-1), 2**k)
    octaves = np.where(w > 1, np.floor(np.log2(np.maximum(w - 1, 1))).astype(np.int64) + 2, 1)
    row = np.repeat(np.arange(len(w)), octaves)
    octave = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    start = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    size = np.maximum(start, 1)
    below = np.minimum(w[row] - start, size)
    doc, seed = doc[row], mixed(h[row] + octave.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    t, k = np.zeros(len(row)), np.uint64(0)
    while len(row):
        k += np.uint64(1)
        r = mixed(seed + k * np.uint64(0xD1B54A32D192ED03))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        r2 = mixed(r ^ np.uint64(0xA0761D6478BD642F))
        seen = ((r2 >> np.uint64(20)) % size.astype(np.uint64)).astype(np.int64) < below
        key = doc[seen] * m + ((r2[seen] & np.uint64(0xFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, key, t[seen])
        best = t[seen] <= first[key]
        out[key[best]] = r[seen][best]
        active = t < first.reshape(-1, m).max(axis=1)[doc]
        if not active.all():
            doc, seed, t, size, below = doc[active], seed[active], t[active], size[active], below[active]
            row = row[active]
    return out.reshape(-1, m)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        keys = mixed(keys + sig[:, k::rows][:, :bands])
    return keys


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, node (a digest of the text), keys (64-bit band keys; null if there are no words) and bytes of the text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, limit=SIGN_BYTES):
                words, at = words_of(batch.column("text"))
                h = hashed(words)
                bags = [bag(h[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
                keys = _bands(signatures(bags, bands * rows), bands, rows).astype(np.int64)
                nodes = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in batch.column("text").to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1) * bands, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                some = pa.array(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(nodes, pa.binary()), pc.if_else(some, lists, pa.scalar(None, lists.type)), pc.binary_length(batch.column("text")).cast(pa.int64())], names=["doc_id", "node", "keys", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, node binary, keys array<long>, bytes long")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, rep), as a table. Texts are looked up by doc_id and node, so that the
    rows of a large group of copies go to many tasks."""
    ends = nodes.select(F.col("node").alias("__node"), "rep").hint("shuffle_hash")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("node"), "text")
    return written(named.join(ends, named["doc_id"].eqNullSafe(ends["rep"]) & (named["node"] == ends["__node"]), "left_semi").select("node", "text").dropDuplicates(["node"]))


def _verified(texts: DataFrame, pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those of the pairs (a, b), a table, whose texts are similar enough, as a table. b's text travels with each pair, a's once for each part of a's pairs."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    left = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = salted_join(right, left, ["a"], "b", "inner").select("a", "b", "text_a", "text_b")

    def run(batches):
        @lru_cache(32)
        def bag_of(text: str):
            return bag(hashed(words_of(pa.array([text], pa.string()))[0]), shingle)

        for batch in batches:
            ok = [similarity(bag_of(x.as_py()), bag_of(y.as_py())) >= least for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.mapInArrow(thrifty(run), "a binary, b binary"))


def _units(texts: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags of all texts as sets, the second of two equal shingles being another unit: owners, units, and sizes of the bags."""
    words, at = words_of(texts.combine_chunks())
    h = hashed(words)
    bags = [bag(h[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
    w = np.concatenate([c for _, c in bags])
    row = np.repeat(np.arange(len(w)), w)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)).astype(np.uint64)
    sizes = np.array([c.sum() for _, c in bags], np.int64)
    return np.repeat(np.arange(len(bags)), sizes), mixed(np.concatenate([u for u, _ in bags])[row] + nth * np.uint64(0x9E3779B97F4A7C15)), sizes


def in_common(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many units (owners, units, sizes) each of a's bags has in common with each of b's."""
    units = np.intersect1d(a[1], b[1])
    sides = []
    for owner, unit, sizes in (a, b):
        at = np.searchsorted(units, unit)
        hit = np.flatnonzero(np.append(units, np.uint64(0))[at] == unit) if len(units) else np.empty(0, np.int64)
        hit = hit[at[hit] < len(units)]
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((owner[order], at[order], len(sizes)))
    out = np.zeros((len(a[2]), len(b[2])), np.float32)
    for lo in range(0, len(units), COLUMNS):
        dense = []
        for owner, at, n in sides:
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            made = np.zeros((n, COLUMNS), np.float32)
            made[owner[i:j], at[i:j] - lo] = 1
            dense.append(made)
        out += dense[0] @ dense[1].T
    return out


def _across(least: float, shingle: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a block: links of texts of different roots, one for each text and other root."""
        i, j, part = (table.column(c).to_numpy() for c in ("i", "j", "part"))
        nodes = np.array(table.column("node").to_pylist(), object)
        roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        rows = [np.flatnonzero(part == i), np.flatnonzero(part == j)]
        out = []
        if len(rows[0]) and len(rows[1]):
            left = _units(table.column("text").take(pa.array(rows[0])), shingle)
            right = left if i[0] == j[0] else _units(table.column("text").take(pa.array(rows[1])), shingle)
            both = in_common(left, right).astype(np.float64)
            ok = (both / (left[2][:, None] + right[2][None, :] - both) >= least) & (roots[rows[0]][:, None] != roots[rows[1]][None, :])
            x, y = np.nonzero(ok)
            one = np.unique(x * (roots.max() + 1) + roots[rows[1]][y], return_index=True)[1]
            out = sorted({(min(p, q), max(p, q)) for p, q in zip(nodes[rows[0][x[one]]], nodes[rows[1][y[one]]], strict=True)})
        columns = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    return run


def _lean(block):
    """block, a function of a block's table, that gives free memory back after each."""

    def run(table: pa.Table) -> pa.Table:
        out = block(table)
        give_back()
        return out

    return run


def _rest(texts: DataFrame, met: DataFrame, parts: DataFrame, known: DataFrame, least: float, shingle: int, few: int, block: int) -> DataFrame:
    """The links among all pairs that meet in a bucket, have different roots and are not known. met: (band, key, node, bytes)."""
    rooted = written(met.join(parts, "node", "left").select("band", "key", "node", "bytes", F.coalesce("root", "node").alias("root")))
    several = rooted.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all")).where("r0 <> r1").select("band", "key", "n", F.col("n").alias("size"), "all")
    several = written(several)
    left = written(salted_join(rooted, several, ["band", "key"], "node", "inner"))
    small, large = left.where(F.col("size") <= few), left.where(F.col("size") > few)
    other = small.select("band", "key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = small.select("band", "key", F.col("node").alias("a"), "root").join(other, ["band", "key"]).where("a < b and root <> root_b").select("a", "b").distinct()
    pairs = written(pairs.join(known, ["a", "b"], "left_anti"))
    links = _verified(texts, pairs, least, shingle)
    if not large.isEmpty():
        n = F.ceil(F.greatest(F.col("size") / block, F.col("all") / BLOCK_BYTES)).cast("int")
        dealt = large.withColumn("n", n).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        blocks = dealt.select("band", "key", "node", "root", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("to"))
        blocks = blocks.select("band", "key", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", "node", "root")
        found = blocks.join(texts, "node").groupBy("band", "key", "i", "j").applyInArrow(_lean(_across(least, shingle)), "a binary, b binary")
        links = written(links.union(found).distinct())
    discard(rooted, several, left, pairs)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root), a table: the least node of each connected part, for all nodes of the links (a, b). Each round
    hangs every node's larger neighbours, and then its smaller ones, on the least it knows, until nothing moves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        following = written(small)
        same = following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty()
        discard(edges)
        edges = following
        if same:
            break
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()))
    discard(edges)
    return found


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, node, class_id (the least doc_id of the class), blank and root (the least node of the class; null if blank) for
    each row. Only root tells classes apart: a class_id can be null, or shared by texts of one doc_id."""
    marked = written(signed(docs, bands, rows, shingle))
    nodes = written(marked.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    entries = nodes.select("node", "rep", "bytes", F.posexplode("keys").alias("band", "key"))
    place = F.struct(F.col("rep").isNull(), "rep", "node")
    buckets = written(entries.groupBy("band", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", F.col("first.node").alias("first"), "n"))
    met = written(salted_join(entries, buckets, ["band", "key"], "node", "inner"))
    texts = _texts(docs, met.select("node", "rep").distinct())
    pairs = written(met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = _verified(texts, pairs, least, shingle)
    parts = components(links)
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _rest(texts, met, parts, known, least, shingle, few, block)
    if not rest.isEmpty():
        before, parts = parts, components(links.union(rest))
        discard(before)
    discard(buckets, met, texts, pairs, links, rest)
    rooted = nodes.select("node", "rep", "n").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    by_node = written(salted_join(rooted.withColumnRenamed("n", "copies"), written(named), ["root"], "node", "inner").select("node", "root", "class_id", F.col("copies").alias("n")))
    words = salted_join(marked.where("keys is not null").select("doc_id", "node"), by_node, ["node"], "doc_id", "inner")
    blank = marked.where("keys is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(True).alias("blank"), F.lit(None).cast("binary").alias("root"))
    return words.select("doc_id", "node", "class_id", F.lit(False).alias("blank"), "root").unionByName(blank)


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (of equal ids, the least text digest). Rows without words all stay."""
    of = classes(docs, **params)
    chosen = of.where("not blank").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("c")).select(F.col("c.doc_id").alias("__id"), F.col("c.node").alias("__node"))
    named = docs.withColumn("__md5", F.unhex(F.md5("text")))
    blank = F.col("text").isNull() | (F.regexp_replace("text", "[ \t\n\x0b\x0c\r]+", "") == "")
    right = chosen.hint("shuffle_hash")
    kept = named.where(~blank).join(right, named["doc_id"].eqNullSafe(right["__id"]) & (named["__md5"] == right["__node"]), "left_semi").dropDuplicates(["doc_id", "__md5"])
    return kept.unionByName(named.where(blank)).select(*docs.columns)
