"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens with a target share. A round gives every queue its share of one window of
`width` tokens, in whole tokens; what a queue got too little or too much is its deficit, which is carried to the
next window, across tasks and partitions alike. The deficits are not passed from task to task: they
follow from the number t of tokens given so far. Halve the list of queues, give the first half
floor(t * its share), the other half the rest, and go on in each half. No count ever falls as t
grows, a deficit stays under one token for each halving, and at the end of an epoch all are 0. So
any window, in any task, is filled without the ones before it, as the round-robin would have filled it. When a queue
runs dry, the others go on with their shares scaled up (a new epoch); there is at most one epoch for each queue.

Targets: given shares, or `temperature`: a share in proportion to tokens ** temperature (1: as the corpus has them; less
lifts small sources, until they are used up). Every token is packed once, so a lifted source ends early.

Queues: the `max_queues` sources with the most text, and those with a target, have one each. The rest, each with less than 1 / max_queues
of the text, stand in a tree: some `max_queues` sources are a group by a hash of their names, as many groups a larger one, until there are few; the largest groups are queues
beside those of the sources. A group is a stream which the same round-robin fills, window by window, from what is in it, by the same shares. So each source keeps its share at any number of sources: what it is
behind is at most its part of one window of its group (a source with a queue of its own: a token for each halving), and no plan, on the driver or in a task, has more than some `max_queues` queues.

Steps: tokenize (once, in Spark tasks; ids go to a table in the shared folder with each document's
place among its task's documents of the queue), sum the tokens by task and queue, turn the sums
into starts, and cut each document where its windows end. Texts are never shuffled, and tokens
only where there are very many tasks.

Defined cases: a null or empty text is the end token alone. Documents are cut freely. Every window
is full but the last. Null sources are one queue, that of the empty name. Null doc_ids are packed as others. Repeated rows
are packed one by one. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right
from codecs import charmap_decode
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.llm.common import slices, thrifty, words_of, written
from wirespan.llm.token_files import _alphabet

WIDTH = 4096
END_ID = 2
MAX_QUEUES = 256
#: Tokens of a group that one task places in its stream, about.
GROUP_TOKENS = 8 << 20
#: Of the registered query and the pipeline: sources have shares in proportion to the tokens to this power.
TEMPERATURE = 0.7
#: Bytes of text a worker tokenizes at once.
TOKENIZE_BYTES = 4 << 20
#: A table of so many (queue, task) rows at most, some MB, is broadcast; a larger one is joined by shuffling.
SMALL_ROWS = 50_000
TOKENS = "doc_id long, queue string, task int, start long, doc_tokens int, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known:
    """Ids of words, as two Arrow arrays that are looked up in bulk. encode gives those of distinct words that are not known. Beyond KEPT words or KEPT_BYTES,
    those stay that the present slice has, or that two slices had since the last time; if that is too much as well, fewer or none."""

    KEPT = 400_000
    KEPT_BYTES = 32 << 20

    def __init__(self, encode):
        self.encode = encode
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uses = np.empty(0, np.int32)

    def __call__(self, words: pa.Array) -> pa.Array:
        """Of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        missing = at.is_null()
        new = words.filter(missing)
        if not len(new):
            at = at.to_numpy()
            self.uses[at] += 1
            return self.ids.take(pa.array(at))
        made = self.encode(new)
        places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        places[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, made])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.uses[places] += 1
        out = self.ids.take(pa.array(places))
        if len(self.words) > self.KEPT or self._bytes() > self.KEPT_BYTES:
            self._forget(places)
        return out

    def _bytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes

    def _forget(self, present: np.ndarray) -> None:
        words, ids, none = self.words, self.ids, np.zeros(len(self.words), bool)
        now = none.copy()
        now[present] = True
        for keep in ((self.uses > 1) | now, now, none):
            self.words, self.ids = words.filter(pa.array(keep)), ids.filter(pa.array(keep))
            if 4 * len(self.words) <= 3 * self.KEPT and 4 * self._bytes() <= 3 * self.KEPT_BYTES:
                break
        self.uses = np.zeros(len(self.words), np.int32)


class WordTokenizer:
    """Ids of whole texts. A vocabulary with the normaliser and pattern below drops white space and never joins
    tokens across it, nor across what its pattern cuts into letters, digits and other runs, so a text's ids are those of its
    words, and a word's those of its parts; each is encoded when first met. Plain texts (of white space and printable
    characters below U+0180, which composition leaves alone) are lower-cased in bulk; of others, the plain
    words are, and only the rest is left to the whole tokenizer. Any other tokenizer encodes whole texts."""

    NOT_PLAIN = r"[^\t-\r -~\x{A1}-\x{12F}\x{131}-\x{17F}]|<\|"
    # The normaliser and pattern of the vocabulary that parts are cut for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    CUT = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    NO_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+)"

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if max(end_id, *self.tokenizer.get_vocab().values()) < 1 << 16 else "I"
        self.by_parts = self._cuts_parts(json.loads(self.tokenizer.to_str()))
        self.letters = _alphabet()
        self.lowered, self.any = _Known(self._lowered), _Known(self._any)

    @property
    def kind(self) -> str:
        """What ids are coded as: unsigned little-endian numbers of 16 bits where all the vocabulary's ids and the end token's are below 65 536, else of 32."""
        return "<u2" if self.code == "H" else "<u4"

    @classmethod
    def _cuts_parts(cls, spec: dict) -> bool:
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        marked = all(a["content"].startswith("<|") and not a["normalized"] for a in spec["added_tokens"])
        return spec["normalizer"] == cls.NORMALIZER and len(steps) == 2 and steps[0] == cls.CUT and level.items() <= steps[1].items() and marked and not spec["truncation"] and not spec["padding"]

    def _coded(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _lowered(self, words: pa.Array) -> pa.Array:
        """Of plain words in lower case."""
        return self._joined(pc.replace_substring_regex(words, self.NO_LETTERS, r" \1 "), self._parts)

    def _parts(self, parts: pa.Array) -> pa.Array:
        """A part that is known as a word has the word's ids."""
        at = pc.index_in(parts, value_set=self.lowered.words)
        missing = at.is_null()
        tokenize, code, letters = self.model.tokenize, self.code, self.letters
        made = [array(code, [t.id for t in tokenize(charmap_decode(p.encode(), "strict", letters)[0])]).tobytes() for p in parts.filter(missing).to_pylist()]
        return pc.replace_with_mask(self.lowered.ids.take(at), missing, pa.array(made, pa.large_binary()))

    def _any(self, words: pa.Array) -> pa.Array:
        """Of words of any characters, as they stand."""
        odd = pc.match_substring_regex(words, self.NOT_PLAIN)
        plain = pc.utf8_lower(words.filter(pc.invert(odd))).dictionary_encode()
        rest = words.filter(odd).to_pylist()
        made = [self._coded(e.ids) for lo in range(0, len(rest), 2_000) for e in self.tokenizer.encode_batch_fast(rest[lo : lo + 2_000], add_special_tokens=False)]
        ids = pc.replace_with_mask(pa.nulls(len(words), pa.large_binary()), pc.invert(odd), self.lowered(plain.dictionary).take(plain.indices))
        return pc.replace_with_mask(ids, odd, pa.array(made, pa.large_binary()))

    @staticmethod
    def _joined(texts: pa.Array, encode) -> pa.Array:
        words, at = words_of(texts)
        coded = words.dictionary_encode()
        ids = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), encode(coded.dictionary).take(coded.indices))
        return pc.binary_join(ids, pa.scalar(b"", pa.large_binary()))

    def coded(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as numbers of `kind`."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_parts:
            return pa.array([self._coded(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids) for t in texts], pa.large_binary())
        odd = pc.match_substring_regex(texts, self.NOT_PLAIN)
        plain = pc.invert(odd)
        out = pc.replace_with_mask(pa.nulls(len(texts), pa.large_binary()), plain, self._joined(pc.utf8_lower(texts.filter(plain)), self.lowered))
        return pc.replace_with_mask(out, odd, self._joined(texts.filter(odd), self.any))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        return [np.frombuffer(ids.as_buffer(), self.kind).astype("<u4").tobytes() for ids in self.coded(texts)]


@lru_cache(1)
def tokenizer(path: str, end_id: int = END_ID) -> WordTokenizer:
    """Loaded once a worker; the words that it knows serve all the worker's tasks."""
    return WordTokenizer(path, end_id)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """TOKENS: ids as the tokenizer's `kind` codes them, the end token included; start: tokens of
    the same queue before it in its task."""

    def run(batches):
        own, filled = tokenizer(path, end_id), {}
        width = np.dtype(own.kind).itemsize
        end, none = (pa.scalar(x, pa.large_binary()) for x in (np.array([end_id], own.kind).tobytes(), b""))
        task = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, limit=TOKENIZE_BYTES):
                ids = pc.binary_join_element_wise(own.coded(batch.column("text")), end, none)
                sizes, starts = (pc.binary_length(ids).to_numpy() // width).tolist(), []
                for queue, n in zip(batch.column("queue").to_pylist(), sizes, strict=True):
                    starts.append(filled.get(queue, 0))
                    filled[queue] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("queue"), pa.array(np.full(len(sizes), task, np.int32)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), ids.cast(pa.binary())], names=["doc_id", "queue", "task", "start", "doc_tokens", "ids"])

    return docs.mapInArrow(thrifty(run), TOKENS)


class Plan:
    """Which window takes which tokens of which queue. totals: tokens by queue; targets: wished shares by
    queue (any positive numbers; queues without one share the rest by size)."""

    def __init__(self, totals: dict, targets: dict | None = None, width: int = WIDTH):
        self.width, self.queues = width, sorted(totals)
        self.at = {q: k for k, q in enumerate(self.queues)}
        self.epochs: list[tuple[int, int, list[int], list[int]]] = []  # first output token, tokens, upper shares, tokens of each queue before
        left = [totals[q] for q in self.queues]
        wished = _wished(left, self.queues, targets or {})
        begin = 0
        while any(left):
            live = [k for k, n in enumerate(left) if n]
            weight = sum(wished[k] for k in live)
            taken = [0] * len(left)
            if targets:
                reach = min(left[k] * weight / wished[k] for k in live)
                for k in live:
                    taken[k] = left[k] if left[k] * weight / wished[k] <= reach * (1 + 1e-12) + 1e-9 else min(left[k], int(reach * wished[k] / weight))
            else:
                taken = left[:]
            upper = np.cumsum(np.array(taken, object)).tolist()
            before = [totals[q] - n for q, n in zip(self.queues, left, strict=True)]
            self.epochs.append((begin, upper[-1], upper, before))
            begin += upper[-1]
            left = [n - t for n, t in zip(left, taken, strict=True)]
        self.total = begin
        self.starts = {q: [e[3][k] for e in self.epochs] for q, k in self.at.items()}

    def taken(self, epoch: tuple, k: int, t: int) -> tuple[int, int]:
        """At output token t of the epoch: tokens that queues before k, and those up to k, have given in it."""
        begin, _, upper, _ = epoch
        x, before, lo, hi = t - begin, 0, 0, len(upper)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            under = upper[lo - 1] if lo else 0
            left = x * (upper[mid - 1] - under) // max(1, upper[hi - 1] - under)
            if k < mid:
                x, hi = left, mid
            else:
                x, before, lo = x - left, before + left, mid
        return before, before + x

    def deficit(self, queue, t: int) -> float:
        """How far what the queue has been given of the first t tokens is behind its share of them (ahead, if negative)."""
        epoch = self.epochs[max(0, bisect_right([e[0] for e in self.epochs], t) - 1)]
        begin, length, upper, _ = epoch
        k, x = self.at[queue], min(t - epoch[0], length)
        a, b = self.taken(epoch, k, begin + x)
        return x * (upper[k] - (upper[k - 1] if k else 0)) / length - (b - a)

    def cut(self, queue, first: int, last: int):
        """Of tokens [first, last) of a queue, the pieces (first, length, window, offset in it)."""
        k = self.at[queue]
        e = bisect_right(self.starts[queue], first) - 1
        x, lo = first, None
        while x < last:
            epoch = self.epochs[e]
            begin, length, upper, before = epoch
            own = upper[k] - (upper[k - 1] if k else 0)
            if x >= before[k] + own:
                e, lo = e + 1, None
                continue
            y = x - before[k]  # place among the queue's tokens of this epoch
            if lo is None:
                lo = self._window(epoch, k, own, y)
                from_t = max(begin, lo * self.width)
                a0, b0 = self.taken(epoch, k, from_t)
            else:  # the next one begins where the last one ended
                lo, from_t, a0, b0 = lo + 1, to_t, a1, b1
            to_t = min(begin + length, (lo + 1) * self.width)
            a1, b1 = self.taken(epoch, k, to_t)
            if b1 - a1 <= y:  # it has none of the queue's
                lo = None
                continue
            n = min(last - x, b1 - a1 - y)
            yield x, n, lo, from_t - lo * self.width + (a1 - a0) + (y - (b0 - a0))
            x += n

    def _window(self, epoch: tuple, k: int, own: int, y: int) -> int:
        """The first window whose end is past token y of the own ones that queue k has in the epoch."""
        begin, length, upper, _ = epoch
        lo, hi = begin // self.width, (begin + length - 1) // self.width
        guess = (begin + y * length // own) // self.width
        slack = 2 + len(upper).bit_length() * length // (own * self.width)
        lo, hi = max(lo, guess - slack), min(hi, guess + slack)
        while lo < hi:
            mid = (lo + hi) // 2
            a, b = self.taken(epoch, k, min(begin + length, (mid + 1) * self.width))
            if b - a > y:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def placed(self, queue, first: int, last: int):
        """Of tokens [first, last) of a queue, the runs (first, length, place in the output)."""
        for x, n, window, offset in self.cut(queue, first, last):
            yield x, n, window * self.width + offset


def _wished(sizes: list[int], queues: list, targets: dict) -> list[float]:
    rest = max(0.0, 1.0 - sum(targets.get(q, 0) for q in queues))
    others = sum(n for q, n in zip(queues, sizes, strict=True) if q not in targets) or 1
    return [targets[q] if q in targets else max(rest, 1e-9) * n / others for q, n in zip(queues, sizes, strict=True)]


def _tree(totals: DataFrame, tail: int, fan: int) -> list[DataFrame]:
    """For each level of the tree of small sources, from below, (child, parent, n, w): tokens and weights of what is in a group. totals: (queue, n, w)."""
    sizes = [max(1, -(-tail // fan))]
    while sizes[-1] > fan:
        sizes.append(-(-sizes[-1] // fan))
    out, at = [], totals.withColumnRenamed("queue", "child")
    for k, size in enumerate(sizes):
        parent = F.concat(F.lit(f"\0{k}:"), F.pmod(F.xxhash64("child"), F.lit(size)).cast("string"))
        out.append(written(at.withColumn("parent", parent)))
        at = out[-1].groupBy(F.col("parent").alias("child")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    return out


def _risen(rows: DataFrame, level: DataFrame, by_weight: bool, width: int) -> DataFrame:
    """rows (doc_id, queue, doc_tokens, ids, spans) with queue the group that holds it, and spans places in the group's stream. Groups are dealt into parts by their tokens; each
    part gets the group's children."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_TOKENS)).cast("int")
    groups = written(level.groupBy("parent").agg(F.sum("n").alias("n"), F.collect_list(F.struct("child", "n", "w")).alias("children")).withColumn("parts", parts))
    of = level.join(groups.select("parent", "parts"), "parent").select(F.col("child").alias("queue"), F.col("parent").alias("__parent"), "parts")
    dealt = rows.join(of, "queue").withColumn("part", F.pmod(F.xxhash64("doc_id", F.element_at("spans", 1)["begin"]), F.col("parts")).cast("int")).drop("parts")
    plans = groups.select(F.col("parent").alias("__of"), "children", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__part"))

    def rise(docs: pa.Table, plan: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.Table.from_pylist([], schema=_row_schema())
        children = plan.column("children")[0].as_py()
        whole = sum(c["w"] for c in children)
        stream = Plan({c["child"]: c["n"] for c in children}, {c["child"]: c["w"] / whole for c in children} if by_weight else None, width)
        spans = [[{"x": s["x"] + x - s["begin"], "begin": place, "n": n} for s in own for x, n, place in stream.placed(queue, s["begin"], s["begin"] + s["n"])] for queue, own in zip(docs.column("queue").to_pylist(), docs.column("spans").to_pylist(), strict=True)]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("__parent"), docs.column("doc_tokens"), docs.column("ids"), pa.array(spans, _row_schema().field("spans").type)], schema=_row_schema())

    return dealt.groupBy("__parent", "part").cogroup(plans.groupBy("__of", "__part")).applyInArrow(rise, ROWS)


ROWS = "doc_id long, queue string, doc_tokens int, ids binary, spans array<struct<x:long,begin:long,n:long>>"


def _row_schema() -> pa.Schema:
    span = pa.list_(pa.struct([("x", pa.int64()), ("begin", pa.int64()), ("n", pa.int64())]))
    return pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("doc_tokens", pa.int32()), ("ids", pa.binary()), ("spans", span)])


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, targets: dict | None = None, queue_column: str = "source", temperature: float = 1.0, max_queues: int = MAX_QUEUES) -> DataFrame:
    """PIECES: which tokens of which document stand where in which sequence. targets: wished shares by source (those without one
    share the rest by size); without any, shares follow from the temperature."""
    named = docs.select("doc_id", "text", F.coalesce(F.col(queue_column).cast("string"), F.lit("")).alias("queue"))
    tokens = written(tokenized(named, path or vocabulary()))
    sums = tokens.groupBy("queue", "task").agg(F.sum(F.col("doc_tokens").cast("long")).alias("n"))
    weighs = not targets and temperature != 1.0
    totals = written(sums.groupBy("queue").agg(F.sum("n").alias("n")).withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature if weighs else 1.0))))
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    bases = written(bases)
    placed = tokens.join(F.broadcast(bases) if bases.count() <= SMALL_ROWS else bases, ["queue", "task"])
    begin = (F.col("base") + F.col("start")).alias("begin")
    spans = F.array(F.struct(F.lit(0).cast("long").alias("x"), begin, F.col("doc_tokens").cast("long").alias("n"))).alias("spans")
    rows, tail = placed.select("doc_id", "queue", "doc_tokens", "ids", spans), max(0, totals.count() - max_queues)
    if tail:
        wished = F.col("queue").isin(list(targets or {}))
        own = totals.where(~wished).orderBy(F.desc("n"), "queue").limit(max_queues).unionByName(totals.where(wished))
        heads = written(own)
        few = F.broadcast(heads.select("queue"))  # max_queues, and those with targets
        levels = _tree(totals.join(few, "queue", "left_anti"), tail, max_queues)
        small = rows.join(few, "queue", "left_anti")
        for level in levels:
            small = _risen(small, level, weighs, width)
        rows = rows.join(few, "queue", "left_semi").select(*small.columns).unionByName(small)
        totals = heads.unionByName(levels[-1].groupBy(F.col("parent").alias("queue")).agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    known = totals.collect()
    if weighs:
        whole = sum(r["w"] for r in known) or 1.0
        targets = {r["queue"]: r["w"] / whole for r in known}
    plan = Plan({r["queue"]: r["n"] for r in known}, targets, width)

    def run(batches):
        types = [pa.int64()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out = [[] for _ in names]
            flat = batch.column("spans").flatten()
            at = iter(zip(*(pc.struct_field(flat, c).to_pylist() for c in ("x", "begin", "n")), strict=True))
            counts = pc.list_value_length(batch.column("spans")).to_pylist()
            for doc_id, queue, n, coded, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "doc_tokens")), batch.column("ids"), counts, strict=True):
                data = coded.as_buffer()
                ids = memoryview(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4"))
                for past, first, size in islice(at, spans):
                    for x, length, window, offset in plan.cut(queue, first, first + size):
                        k = past + x - first
                        for column, value in zip(out, (doc_id, k, length, zlib.crc32(ids[k : k + length]), n, window, offset), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(thrifty(run), PIECES)
