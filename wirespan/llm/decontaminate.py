"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

A text is normalised by lower-casing A-Z and taking words, the runs of ASCII letters, digits and
characters beyond ASCII. Every window of `width` words of an item (or the whole item, if it is
shorter) is a pattern. The automaton works on word numbers, where a word that no item has is 0, so
its size follows the items alone and a document is scanned once. An automaton takes some 1.2 kB a word of
its items, so items come in blocks of about `block_words` words (a longer item stands alone): one automaton of 250 MB at most is built, broadcast and held
by a worker at a time. A benchmark of several blocks scans the documents once for each, writes what is found, and merges it by document.

Defined cases: a null or empty text has no words and is clean; an item without words is no
pattern; equal items, and equal windows of different items, all count; rows of equal item_id count
as one item; an item without id still marks words but is not listed. Repeated documents and null doc_ids are
judged as others. An empty table of documents gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import thrifty, written

WIDTH = 13
BLOCK_WORDS = 200_000
#: Bytes to blanks or lower case; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "doc_id long, text_hash long, contaminated boolean, spans array<struct<begin:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Of one block of items: finds the words within occurrences, and which items occur."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.ids: dict[bytes, int] = {}
        self.width = width
        windows: dict[tuple[int, ...], set] = defaultdict(set)
        for item_id, text in items:
            words = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            for k in range(max(1, len(words) - width + 1) if words else 0):
                windows[words[k : k + width]].add(item_id)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in windows.items():
            self.machine.add_word(window, (len(window), frozenset(owners)))
        self.empty = not windows
        if windows:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit words as sorted disjoint ranges [begin, end), and the items."""
        runs: list[tuple[int, int]] = []
        items: set = set()
        if self.empty or not words:
            return runs, items
        get = self.ids.get
        for end, (length, owners) in self.machine.iter(tuple([get(w, 0) for w in words])):
            runs.append((end + 1 - length, end + 1))
            items |= owners
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, width: int = WIDTH) -> Iterator[Automaton]:
    """Automata over the items, read in blocks and never all at once."""
    block, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        size = len(words_of(row[1]))
        if block and total + size > block_words:
            yield Automaton(block, width)
            block, total = [], 0
        block.append((row[0], row[1]))
        total += size
    if block:
        yield Automaton(block, width)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


FOUND = "doc_id long, text_hash long, runs array<struct<begin:int,end:int>>, items array<string>"


def _tables(docs: DataFrame, automata: Iterator[Automaton]) -> list[DataFrame]:
    """FOUND of each block, as tables. An item without id is a null among the items."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("runs", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
    named, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), []
    for automaton in automata:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches, shared=shared):
            for batch in batches:
                rows = []
                for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    runs, items = shared.value.scan(words_of(text))
                    if runs:
                        rows.append({"doc_id": doc_id, "text_hash": text_hash, "runs": [{"begin": a, "end": b} for a, b in runs], "items": list(items)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        out.append(written(named.mapInArrow(thrifty(run), FOUND).dropDuplicates(["doc_id", "text_hash"])))
        shared.destroy()
    return out


def _scanned(automaton: Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    words = words_of(text)
    return len(words), *automaton.scan(words)


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, judge, schema) -> DataFrame:
    """docs (with a column text) through judge(batch, [(number of words, runs, items) of each row]). The words themselves take several times their text, so those of one text are held at a time."""
    blocks = blocks_of(benchmark, block_words, width)
    first, second = next(blocks, Automaton([], width)), next(blocks, None)
    at = docs.columns.index("text")
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for batch in batches:
                yield judge(batch, [_scanned(shared.value, t.as_py()) for t in batch.column(at)])

        return docs.mapInArrow(thrifty(run), schema)
    found = reduce(DataFrame.unionByName, _tables(docs, chain([first, second], blocks)))
    one = found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("__runs"), F.flatten(F.collect_list("items")).alias("__items"))
    right = one.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), "__runs", "__items").hint("shuffle_hash")
    left = docs.withColumn("__hash", F.xxhash64("text"))
    joined = left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["__hash"] == right["__of"]), "left").select(*docs.columns, "__runs", "__items")

    def known(batches):
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column("__runs").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            yield judge(batch.drop_columns(["__runs", "__items"]), [(len(words_of(t)), merged([(r["begin"], r["end"]) for r in runs or []]), set(items or [])) for t, runs, items in rows])

    return joined.mapInArrow(thrifty(known), schema)


def _hit(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def _names(items: set) -> list[str]:
    return sorted(i for i in items if i is not None)


def digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, for each document."""

    def judge(batch, found):
        rows = [(n, _hit(runs), len(_names(items)), hashlib.sha256(",".join(_names(items)).encode()).hexdigest(), is_contaminated(_hit(runs), n)) for n, runs, items in found]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _judged(docs.select("doc_id", "text"), benchmark, width, block_words, judge, DIGEST)


def spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with hits: offsets of the hits in the original text, and the items found."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def judge(batch, found):
        rows = []
        for doc_id, text_hash, text, (n_words, runs, items) in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").to_pylist(), found, strict=True):
            if runs:
                at = [m.span() for m in WORD.finditer(text)]
                rows.append({"doc_id": doc_id, "text_hash": text_hash, "contaminated": is_contaminated(_hit(runs), n_words), "spans": [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in runs], "items": _names(items)})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    return _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), benchmark, width, block_words, judge, SPANS)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the contaminated ones, judged row by row as they are scanned."""

    def judge(batch, found):
        return batch.filter(pa.array(np.array([not is_contaminated(_hit(runs), n) for n, runs, _ in found], bool)))

    return _judged(docs, benchmark, width, block_words, judge, docs.schema)
