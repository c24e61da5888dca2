"""Token ids in binary files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Texts are tokenized once; the ids go to a table in the shared folder. Ids are counted (combined before they are
shuffled), and the most frequent gets rank 0: ranks below 256 take one byte, below 65 536 two. The
documents are range-partitioned and sorted by doc_id, and each task writes the files of its range in that order. A file
holds many documents: their ids and lengths, then the control bytes of all its ranks, then their data bytes (see codec). Files are cut at so
many tokens, so none grows with a range. The ranks are a table of at most one row for each id of the vocabulary.

A file's name tells the task attempt that wrote it, and the manifest, which Spark commits, lists the files of attempts that succeeded: what a
lost or speculative attempt leaves is never read. Reading starts at the manifest; where a file's first token stands
among all tokens is a sum over the files before it.

Files are written and read with pyarrow.fs, so the folder may be a file, hdfs, s3 (s3a), gs or abfs URI that all executors reach.

Layout of a file, little-endian: magic `WSTF`, u32 documents, u64 tokens, u64 control bytes, u64 data bytes; i64 doc_ids; u8 1 where doc_id is null; u32
tokens of each document; control bytes; data bytes; u32 crc32 of all before.

Defined cases: a null or empty text is the end id alone. Null doc_ids come first, equal ones are ordered by a hash of the text. Repeated rows are
stored one by one. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespan.functions.tables import scratch_dir
from wirespan.llm import codec
from wirespan.llm.common import discard, slices, text_key, written

END_ID = 0
#: Tokens a file holds before the next is begun; some 20 MB.
FILE_TOKENS = 16 << 20
#: Tokens coded at once (a multiple of four, so that blocks join).
BLOCK = 1 << 20
HEAD = struct.Struct("<4sIQQQ")
MAGIC = b"WSTF"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """Ids of whole texts. A byte-level vocabulary without a normaliser never joins ids across the parts its pattern cuts,
    so the library's model encodes each distinct part once. _pattern() cuts as the tokenizer does where every character is ASCII or was in Unicode
    3.2 with the category it has now (a test compares all code points); texts with others or with an added token, and any other kind of tokenizer, are left to the
    library as a whole."""

    KEPT = 300_000

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_parts = not spec["normalizer"] and level.items() <= (spec["pre_tokenizer"] or {}).items() and not spec["truncation"] and not spec["padding"]
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.known = _Known(self.tokenizer.model, self.KEPT)
        self.ascii, self.any = _pattern(frozenset(map(chr, range(128)))), _pattern(_steady())

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        plain = text.isascii()
        if not self.by_parts or not (plain or _steady().issuperset(text)) or any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self.known.turn()
        return b"".join(map(self.known.__getitem__, (self.ascii if plain else self.any).findall(text)))


class _Known(dict):
    """Ids of parts, encoded when first asked for. turn() forgets those that were not asked for since it last put some aside."""

    def __init__(self, model, kept: int):
        super().__init__()
        self.tokenize, self.kept, self.older = model.tokenize, kept, {}
        self.letters = _alphabet()

    def turn(self) -> None:
        if len(self) > self.kept:
            self.older = dict(self)
            self.clear()

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(charmap_decode(part.encode(), "strict", self.letters)[0])]).tobytes()
        self[part] = ids
        return ids


def _alphabet() -> str:
    """What byte-level vocabularies write for each byte: itself where Latin-1 prints it, else the next character from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    return "".join(chr(0x100 + rest.index(b)) if b in rest else chr(b) for b in range(256))


def _class(chars) -> str:
    """A set of characters as the ranges of a pattern."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


def _pattern(chars: frozenset[str]) -> re.Pattern:
    """The parts of byte-level vocabularies, for texts of these characters: words and numbers with a blank before, endings, other runs, and white space but
    for the blank before a word."""
    letters, digits = (_class(c for c in chars if unicodedata.category(c)[0] == k) for k in "LN")
    # White space, and the endings that are parts of their own.
    white = _class(c for c in chars if c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" or "\u2000" <= c <= "\u200a")
    return re.compile(rf" ?[{letters}]+| ?[{digits}]+|'(?:[stmd]|re|ve|ll)| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+")


@lru_cache(1)
def _steady() -> frozenset[str]:
    """ASCII, and the characters that Unicode 3.2 had with the category they have now."""
    old = unicodedata.ucd_3_2_0.category
    return frozenset(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c < "\x80" or unicodedata.category(c)[0] == old(c)[0] != "C")


@lru_cache(4)
def tokenizer(path: str) -> ByteTokenizer:
    """Loaded once a worker."""
    return ByteTokenizer(path)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash and ids (unsigned 16-bit numbers where all the vocabulary's ids are below 65 536, else 32-bit), the end id included."""
    kind = _kind(path)

    def run(batches):
        own = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text")
                ids = [np.frombuffer(own(t.as_py()) + end, "<u4").astype(kind).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(ids, pa.binary())], names=["doc_id", "text_hash", "ids"])

    return docs.select("doc_id", "text", text_key().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, ids binary")


def _kind(path: str) -> str:
    return "<u2" if tokenizer(path).size <= 1 << 16 else "<u4"


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All numbers of a column of binary values, without a copy for each."""
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, kind)
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def ranked(tokens: DataFrame, kind: str) -> list[int]:
    """Ids by falling count, equal counts by id; no more than the vocabulary has."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column("ids"), kind))
            if len(own) > len(counts):
                own, counts = counts, own
            counts[: len(own)] += own
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in sorted(counted.collect(), key=lambda r: (-r.n, r.id))]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def _file(ids: list, sizes: list[int], values: np.ndarray) -> bytes:
    blocks = [codec.pack(values[lo : lo + BLOCK]) for lo in range(0, len(values), BLOCK)]
    head = HEAD.pack(MAGIC, len(ids), len(values), sum(len(c) for c, _ in blocks), sum(len(d) for _, d in blocks))
    none = np.array([x is None for x in ids], np.uint8)
    body = b"".join([head, np.array([x or 0 for x in ids], "<i8").tobytes(), none.tobytes(), np.array(sizes, "<u4").tobytes(), *(c.tobytes() for c, _ in blocks), *(d.tobytes() for _, d in blocks)])
    return body + struct.pack("<I", zlib.crc32(body))


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files of docs to folder/files, with tables folder/ranks and folder/manifest, and returns the manifest: part and file (their order), name, n_docs,
    n_tokens. path: the vocabulary."""
    kind = _kind(path)
    spark = docs.sparkSession
    tokens = written(tokenized(docs, path, end_id), compression="zstd")
    order = ranked(tokens, kind)
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    where, rank_of = f"{folder}/files", np.zeros(max(order, default=0) + 1, kind)
    rank_of[order] = np.arange(len(order))

    def run(batches):
        files, top = _files(where)
        files.create_dir(top, recursive=True)
        context, count = TaskContext.get(), 0
        ids, sizes, held, n = [], [], [], 0

        def flush():
            nonlocal count, ids, sizes, held, n
            name = f"{context.partitionId():06d}-{count:06d}-{context.taskAttemptId():x}.ids"
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(_file(ids, sizes, np.concatenate(held)))
            made = pa.RecordBatch.from_pylist([{"part": context.partitionId(), "file": count, "name": name, "n_docs": len(ids), "n_tokens": n}], schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            count, ids, sizes, held, n = count + 1, [], [], [], 0
            return made

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                values = rank_of[np.frombuffer(own.as_buffer(), kind)]
                ids.append(doc_id)
                sizes.append(len(values))
                held.append(values)
                n += len(values)
                if n >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    dealt = tokens.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "ids")
    dealt.mapInArrow(run, "part int, file int, name string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    discard(tokens)
    return spark.read.parquet(f"{folder}/manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """manifest with start: the tokens of all files before. Summed within each part, and over the parts, of which there are as many as tasks wrote."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = parts.select("part", F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", within).join(before, "part").withColumn("start", F.col("start") + F.col("__before")).drop("__before")


class Corrupt(ValueError):
    """A file that is not what was written."""


def _read(raw: bytes, name: str):
    """doc_ids (None where null), tokens of each document, and all ranks."""
    if len(raw) < HEAD.size + 4 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(memoryview(raw)[:-4]):
        raise Corrupt(f"{name}: checksum")
    magic, n_docs, n_tokens, n_control, n_data = HEAD.unpack_from(raw)
    if magic != MAGIC or len(raw) != HEAD.size + 13 * n_docs + n_control + n_data + 4:
        raise Corrupt(f"{name}: layout")
    at = HEAD.size
    ids = np.frombuffer(raw, "<i8", n_docs, at)
    none = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(raw, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    control = np.frombuffer(raw, np.uint8, n_control, at)
    values = np.empty(n_tokens, np.uint32)
    done = 0
    for some in codec.unpack(control, np.frombuffer(raw, np.uint8, n_data, at + n_control), n_tokens):
        values[done : done + len(some)] = some
        done += len(some)
    return pa.array(ids, mask=none.astype(bool)), sizes, values


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """From the files that the manifest names: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 of the ids as little-endian unsigned
    32-bit numbers; with_ids: also the ids themselves, so coded. A changed file is an error."""
    id_of = np.array([r.id for r in sorted(spark.read.parquet(f"{folder}/ranks").collect())], "<u4")
    where = f"{folder}/files"

    def run(batches):
        files, top = _files(where)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with files.open_input_stream(f"{top}/{name}") as opened:
                    ids, sizes, values = _read(opened.read(), name)
                flat = memoryview(id_of[values]).cast("B")
                ends = np.cumsum(sizes)
                cuts = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True))
                columns = [ids, pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(flat[a:b]) for a, b in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(flat[a:b]) for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    manifest = _starts(spark.read.parquet(f"{folder}/manifest"))
    count = manifest.count()
    dealt = manifest.select("name", "start").repartition(max(1, min(count, 20_000)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def digest(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """The rows of read() after write(), to a new scratch folder unless one is given."""
    folder = folder or scratch_dir(docs.sparkSession)
    write(docs, path, folder, end_id, file_tokens)
    return read(docs.sparkSession, folder)
