"""Exact substring deduplication with fixed-block anchors.

A window of `width` words is removed where its word sequence also starts earlier: in a smaller
doc_id, or earlier in the same document. Any such pair shares a block of `width` / 2 words that lies
on a fixed grid of the earlier document. So:

1. anchors: each document's grid blocks are indexed, and every rolling block of all documents probes
   the index; a block found in the index and in a second place is a hit;
2. extension: around hits, windows are compared over their whole length (128 hashed bits), and each
   but the earliest of equal windows is marked, which grows hits to maximal repeats;
3. marks return to their documents, which drop the words they cover.

Blocks and windows travel as packed arrays, by ranges of their hash. A slice of documents (some MB)
sends one entry for each distinct hash, however often it occurs, and decides the rest itself; so a
passage that a third of all documents have costs one entry for each slice. No pairs are made.

The number of ranges grows with the input, so that each is worked on in memory; but a slice is cut into `fan` parts
only. Where more ranges are needed, the parts of `fan` slices are merged and cut again, and so on:
rows grow with the input and not with slices times ranges. A merge also settles what it can: of equal windows
only the earliest travels on, and of blocks known to be hits only one, so a passage found in every slice
shrinks by `fan` with each merge. (Blocks that no merge has met on a grid travel on as they are.)

Slices are cut from rows sorted within their task, so a task that is repeated after a loss cuts the same ones,
in whatever order its rows come.

Defined cases: null and empty texts have no words. A null doc_id counts as the smallest. Rows with
the same doc_id are one place in the order: of windows at the same position in them neither is
earlier, so repeated rows are treated alike. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import discard, hashed, rolling, slices, window_mask, words_of, written

WIDTH = 20
#: Words for each range of hashes; a range is worked on in memory, at some 20 bytes a word.
RANGE_WORDS = 1_500_000
#: Into how many parts (2 ** FAN_BITS) a slice, and then a part of so many slices, is cut.
FAN_BITS = 8
#: Bytes of text a worker hashes at once.
HASH_BYTES = 4 << 20

PACKED = "range int, slice long, kind int, n int, a binary, b binary, c binary, d binary, e binary"
#: Of PACKED: an entry (a hashes, b more hash bits or flags, c positions in the slice, d doc_ids and
#: positions in the document, e slices where there are several), the documents of a slice (a starts, b doc_ids, c text
#: hashes), or positions found (c).
ENTRY, DOCS, FOUND = 0, 1, 2
LEAST = np.int64(-(2**63))


def _row(range_: int, slice_: int, kind: int, *arrays: np.ndarray | None) -> tuple:
    arrays = (*arrays, None, None, None, None, None)[:5]
    return (int(range_), int(slice_), kind, max(0 if x is None else len(x) for x in arrays), *(None if x is None else x.tobytes() for x in arrays))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 5
    columns = zip(*rows, strict=True) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["range", "slice", "kind", "n", "a", "b", "c", "d", "e"])


def _spread(range_of: np.ndarray, arrays: list[np.ndarray], slice_: int) -> Iterator[tuple]:
    """Entries by range, in the order of their positions."""
    order = np.argsort(range_of, kind="stable")
    own = range_of[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else [0]
    moved = [None if x is None else x[order] for x in arrays]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield _row(own[lo], slice_, ENTRY, *(None if x is None else x[lo:hi] for x in moved))


def _groups(sorted_keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where groups begin, and each row's group."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _range(h: np.ndarray, bits: int) -> np.ndarray:
    """The range of each hash: its top bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def _slices(batches, slice_bytes: int):
    """(slice number, batch). A repeated task gives the same ones, as its rows are sorted."""
    task, k = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in slices(whole, limit=slice_bytes):
            yield (task << 32) | k, batch
            k += 1


def _documents(slice_: int, batch: pa.RecordBatch, at: np.ndarray, bits: int) -> tuple:
    ids = batch.column("doc_id").fill_null(int(LEAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    none = np.array(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), np.uint8)
    return _row(slice_ % (1 << bits), slice_, DOCS, at.astype(np.int64), ids, batch.column("text_hash").to_numpy(zero_copy_only=False).astype(np.int64), none)


def _anchor_rows(bits: int, width: int, slice_bytes: int = HASH_BYTES):
    block = width // 2

    def run(batches):
        for slice_, batch in _slices(batches, slice_bytes):
            words, at = words_of(batch.column("text"))
            long_enough = np.diff(at) >= width
            h = rolling(hashed(words), block)
            inside = window_mask(at, block, len(h)) & np.repeat(long_enough, np.diff(at))[: len(h)]
            pos = np.flatnonzero(inside)
            begins = np.repeat(at[:-1], np.diff(at))[: len(h)]
            grid = (pos - begins[pos]) % block == 0
            order = np.argsort(h[pos], kind="stable")
            keys = h[pos][order]
            first, group = _groups((keys,))
            rows = [_documents(slice_, batch, at, bits)]
            if len(first):
                sizes = np.diff(np.append(first, len(keys)))
                flag = np.logical_or.reduceat(grid[order], first) | (sizes > 1)
                many = sizes[group] > 1
                if many.any():
                    rows.append(_row(slice_ % (1 << bits), slice_, FOUND, None, None, np.sort(pos[order][many]).astype(np.uint32)))
                u, where = keys[first], pos[order][first].astype(np.uint32)
                by_place = np.argsort(where)
                packed = (u & ~np.uint64(1)) | flag.astype(np.uint64)
                rows += _spread(_range(u, bits)[by_place], [_seven(packed[by_place]), None, where[by_place]], slice_)
            yield _batch(rows)

    return run


def _seven(h: np.ndarray) -> np.ndarray:
    """56 bits of each hash: the top ones name the range already, the lowest is the flag."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])


def _unseven(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _passed_on(table: pa.Table, bits: int) -> list[tuple]:
    """Rows that are no entries, spread over the ranges to come."""
    rest = table.take(pa.array(np.flatnonzero(table.column("kind").to_numpy() != ENTRY))).drop_columns(["batch"] if "batch" in table.column_names else [])
    return [(r[1] % (1 << bits), *r[1:]) for r in zip(*(c.to_pylist() for c in rest.columns), strict=True)] if len(rest) else []


def _entries(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The entry rows, and the slice and place of each of their entries."""
    rows = table.take(pa.array(np.flatnonzero(table.column("kind").to_numpy() == ENTRY))).to_pylist()
    if not rows:
        return rows, np.empty(0, np.int64), np.empty(0, np.uint32)
    of = [np.full(r["n"], r["slice"], np.int64) if r["e"] is None else np.frombuffer(r["e"], np.int64) for r in rows]
    return rows, np.concatenate(of), np.concatenate([np.frombuffer(r["c"], np.uint32) for r in rows])


def _found(slice_of: np.ndarray, where: np.ndarray, bits: int = 0) -> list[tuple]:
    order = np.lexsort((where, slice_of))
    slice_of, where = slice_of[order], where[order]
    first, _ = _groups((slice_of,))
    return [_row(slice_of[lo] % (1 << bits), slice_of[lo], FOUND, None, None, where[lo:hi]) for lo, hi in zip(first, np.append(first[1:], len(where)), strict=True)] if len(where) else []


def _cut(range_of: np.ndarray, arrays: list[np.ndarray | None], stay: np.ndarray, batch: int) -> list[tuple]:
    return list(_spread(range_of[stay], [None if x is None else x[stay] for x in arrays], batch))


def _merged_blocks(before: int, bits: int, last: bool):
    """Of the blocks of one range, or of the part of it that some slices sent (before: the bits that name it). Those that several slices have are hits,
    if one of them has it on its grid (or twice). If this is not the last merge, what others need to know goes on, cut by `bits` of the hash."""

    def run(table: pa.Table) -> pa.Table:
        entries, slice_of, where = _entries(table)
        rows = _passed_on(table, bits)
        if entries:
            top = np.uint64(int(entries[0]["range"]) >> (before - 8) if before >= 8 else 0)
            h = np.concatenate([_unseven(e["a"]) for e in entries]) | top << np.uint64(56)
            flag, key = (h & np.uint64(1)) == 1, h >> np.uint64(1)
            order = np.argsort(key, kind="stable")
            first, group = _groups((key[order],))
            hits = (np.diff(np.append(first, len(key))) > 1) & np.logical_or.reduceat(flag[order], first)
            hit = order[hits[group]]
            rows += _found(slice_of[hit], where[hit], bits)
            if not last:
                stay = np.ones(len(h), bool)
                stay[hit] = False
                one = order[first[hits]]
                h[one] |= np.uint64(1)
                stay[one] = True
                rows += _cut(_range(h, bits), [_seven(h), None, where, None, slice_of], stay, table.column("batch")[0].as_py())
        return pa.Table.from_batches([_batch(rows)])

    return run


def _window_rows(bits: int, width: int, slice_bytes: int = HASH_BYTES):
    block = width // 2

    def run(batches):
        for slice_, batch in _slices(batches, slice_bytes):
            words, at = words_of(batch.column("text"))
            own = hashed(words)
            h, more = rolling(own, width), rolling(own, width, 2)
            hits = np.zeros(len(own) + 1, np.int32)
            for lo, places in zip(at[:-1], batch.column("places").to_pylist(), strict=True):
                hits[lo + np.frombuffer(places, np.uint32)] = 1
            near = np.concatenate([[0], np.cumsum(hits)])
            n = len(h)
            inside = window_mask(at, width, n) & (near[block + 1 : block + 1 + n] > near[:n]) if n else np.zeros(0, bool)
            pos = np.flatnonzero(inside)
            rows = [_documents(slice_, batch, at, bits)]
            if len(pos):
                sizes = np.diff(at)
                ids = np.repeat(batch.column("doc_id").fill_null(int(LEAST)).to_numpy(zero_copy_only=False).astype(np.int64), sizes)[pos]
                place = pos - np.repeat(at[:-1], sizes)[pos]
                order = np.lexsort((place, ids, more[pos], h[pos]))
                pos, ids, place = pos[order], ids[order], place[order]
                first, group = _groups((h[pos], more[pos]))
                later = (ids > ids[first][group]) | (place > place[first][group])
                if later.any():
                    rows.append(_row(slice_ % (1 << bits), slice_, FOUND, None, None, np.sort(pos[later]).astype(np.uint32)))
                least = ~later  # repeated rows have the least of a window more than once
                by_place = np.argsort(pos[least])
                u = h[pos[least]][by_place]
                rows += _spread(_range(u, bits), [u, more[pos[least]][by_place], pos[least][by_place].astype(np.uint32), _two(ids[least][by_place], place[least][by_place])], slice_)
            yield _batch(rows)

    return run


def _two(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), np.dtype([("id", "<i8"), ("place", "<u4")]))
    out["id"], out["place"] = ids, place
    return out


def _merged_windows(before: int, bits: int, last: bool):
    """Of the windows of one range, or of the part of it that some slices sent: those that start earlier in another slice are found. If this is not
    the last merge, the others go on, cut by `bits` of the hash."""

    def run(table: pa.Table) -> pa.Table:
        entries, slice_of, where = _entries(table)
        rows = _passed_on(table, bits)
        if entries:
            h, more = (np.concatenate([np.frombuffer(e[c], np.uint64) for e in entries]) for c in ("a", "b"))
            at = np.concatenate([np.frombuffer(e["d"], np.dtype([("id", "<i8"), ("place", "<u4")])) for e in entries])
            order = np.lexsort((at["place"], at["id"], more, h))
            first, group = _groups((h[order], more[order]))
            ids, place = at["id"][order], at["place"][order]
            later = (ids > ids[first][group]) | (place > place[first][group])
            rows += _found(slice_of[order[later]], where[order[later]], bits)
            if not last:
                stay = np.ones(len(h), bool)
                stay[order[later]] = False
                rows += _cut(_range(h, bits), [h, more, where, at, slice_of], stay, table.column("batch")[0].as_py())
        return pa.Table.from_batches([_batch(rows)])

    return run


PLACES = "doc_id long, text_hash long, places binary"


def _by_document(table: pa.Table) -> pa.Table:
    """Of one slice: the places found, by document and counted from its first word."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["kind"] == DOCS)
    at, ids, hashes, none = (np.frombuffer(docs[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.int64), ("d", np.uint8)))
    found = [np.frombuffer(r["c"], np.uint32) for r in rows if r["kind"] == FOUND]
    places = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)
    cuts = np.searchsorted(places, at)
    out = [(None if none[k] else int(ids[k]), int(hashes[k]), (places[lo:hi] - at[k]).astype(np.uint32).tobytes()) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "text_hash", "places"])


#: Partitions of one shuffle, at most.
MOST = 20_000


def _round(docs: DataFrame, make, merge, width: int, size: int, range_words: int, fan_bits: int, slice_bytes: int) -> DataFrame:
    """Entries of the documents through their ranges, and what is found back to the documents, as a table."""
    whole = max(0, (-(-size // (6 * range_words)) - 1).bit_length())
    bits, batches = min(whole, fan_bits), max(1, size // slice_bytes)
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.sortWithinPartitions("doc_id", "text_hash").mapInArrow(make(bits, width, slice_bytes), PACKED)
    while bits < whole:
        batches = max(1, batches >> fan_bits)
        following = min(whole, bits + fan_bits)
        parted = rows.withColumn("batch", F.pmod(F.xxhash64("slice"), F.lit(batches)))
        rows = _dealt(parted, batches << bits, usual, "range", "batch").groupBy("range", "batch").applyInArrow(merge(bits, following, False), PACKED)
        bits = following
    found = _dealt(rows, 1 << bits, usual, "range").groupBy("range").applyInArrow(merge(bits, 0, True), PACKED)
    by_slice = _dealt(found, size // (8 * slice_bytes), usual, "slice").groupBy("slice").applyInArrow(_by_document, PLACES)
    return written(by_slice.dropDuplicates(["doc_id", "text_hash"]))


def partitions(groups: int, usual: int) -> int:
    """How many partitions so many groups get: one each or so, but no more than MOST, which one shuffle can keep account of; beyond that a
    task takes several groups, one after another, so its memory stays that of one."""
    return min(max(groups, usual), max(MOST, usual))


def _dealt(rows: DataFrame, groups: int, usual: int, *by: str) -> DataFrame:
    """rows in partitions(), where that is more than the session's number: so tasks stay as large as they are."""
    n = partitions(groups, usual)
    return rows.repartition(n, *by) if n > usual else rows


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    right = places.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), "places").hint("shuffle_hash")
    return docs.join(right, docs["doc_id"].eqNullSafe(right["__id"]) & (docs["text_hash"] == right["__of"]), how).drop("__id", "__of")


def later_windows(docs: DataFrame, width: int = WIDTH, range_words: int = RANGE_WORDS, fan_bits: int = FAN_BITS, slice_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, text_hash, places: the starts (32-bit, from the document's first word) of the windows that also start earlier."""
    if width % 2:
        raise ValueError("width must be even: blocks are half as long")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = _round(named, _anchor_rows, _merged_blocks, width, size, range_words, fan_bits, slice_bytes)
    near = written(_with_places(named, hits, "inner").select("doc_id", "text_hash", "text", "places"))
    found = _round(near, _window_rows, _merged_windows, width, size, range_words, fan_bits, slice_bytes)
    discard(hits, near)
    return found


def _covered(n: int, places: bytes | None, width: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    if places:
        starts = np.frombuffer(places, np.uint32).astype(np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(docs: DataFrame, width: int = WIDTH, range_words: int = RANGE_WORDS, fan_bits: int = FAN_BITS, slice_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one blank) for every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words, kept = _kept(text.as_py(), places.as_py(), width)
                rows.append((words, words - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(docs, width, range_words, fan_bits, slice_bytes).select("doc_id", "text", "places").mapInArrow(run, DIGEST)


def _marked(docs: DataFrame, *sizes: int) -> DataFrame:
    places = later_windows(docs, *sizes)
    return _with_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), places, "left")


def _kept(text: str | None, places: bytes | None, width: int) -> tuple[int, list[bytes]]:
    """The number of words, and those that stay. bytes.split() parts at the white space of the contract and no other."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not places:
        return len(words), words
    gone = _covered(len(words), places, width).tolist()
    return len(words), [w for w, g in zip(words, gone, strict=True) if not g]


def remove_repeats(docs: DataFrame, width: int = WIDTH, range_words: int = RANGE_WORDS) -> DataFrame:
    """doc_id and text: the words that stay, joined by one blank where any was removed, else the text as it was."""

    def run(batches):
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                out.append(b" ".join(_kept(text, places, width)[1]).decode("utf-8", "surrogatepass") if places else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _marked(docs, width, range_words).select("doc_id", "text", "places").mapInArrow(run, "doc_id long, text string")
