import zlib
from collections import defaultdict

import numpy as np
import pytest

from wirespan.llm import packing


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3}, {"a": 0.98}])
@pytest.mark.parametrize("totals", [{"a": 10}, {"a": 9000, "b": 17, "c": 123_456}, {"a": 40_000, "b": 1, "c": 40_001, "d": 4096}])
def test_plan_fills_every_window(targets, totals):
    plan = packing.Plan(totals, targets, 512)
    windows = defaultdict(list)
    for q, n in totals.items():
        x = 0
        for lo in range(0, n, 777):
            for first, length, window, offset in plan.cut(q, lo, min(n, lo + 777)):
                assert first == x and length > 0
                x += length
                windows[window].append((offset, length, q))
        assert x == n
    total = sum(totals.values())
    assert sorted(windows) == list(range(-(-total // 512)))
    for w, pieces in windows.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == min(512, total - 512 * w)
    if not targets:  # each window holds each queue's share, but for a token or two
        for w, pieces in windows.items():
            size = min(512, total - 512 * w)
            for q, n in totals.items():
                assert abs(sum(k for _, k, p in pieces if p == q) - size * n / total) < 4


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.1, "b": 0.1, "c": 0.8}])
def test_windows_hold_the_targets_and_deficits_are_carried(targets):
    totals = {"a": 40_000, "b": 30_011, "c": 90_000}
    plan = packing.Plan(totals, targets, 512)
    given, held = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for q, n in totals.items():
        for _, length, window, _ in plan.cut(q, 0, n):
            held[window][q] += length
    first_epoch = plan.epochs[0][1] // 512
    assert first_epoch > 80
    for w in range(first_epoch):
        for q, share in targets.items():
            # round-robin: a window's share, and what the queue was short of before it
            assert held[w][q] == pytest.approx(512 * share + plan.deficit(q, 512 * w) - plan.deficit(q, 512 * (w + 1)), abs=0.1)
            given[q] += held[w][q]
            assert abs(512 * (w + 1) * share - given[q]) < 3 and abs(plan.deficit(q, 512 * (w + 1))) < 3


def test_temperature_lifts_small_sources(spark):
    docs = spark.createDataFrame([(i, "word " * 400, "big" if i % 5 else "small") for i in range(200)], "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(docs, temperature=0.5).collect()
    big = sum(r.length for r in rows if r.doc_id % 5 and r.sequence_id < 5)
    assert big / (5 * 4096) == pytest.approx(2 / 3, abs=0.01)


def parts_of_windows(spark, tokens, weight, queues, width):
    """For each source, what it may be behind: its part of one window of each group above it, and a token for each halving."""
    names = sorted(tokens, key=lambda i: (-tokens[i], f"s{i}"))
    tail = names[queues:]
    frame = spark.createDataFrame([(f"s{i}", tokens[i], float(weight[i])) for i in tail], "queue string, n long, w double")
    levels = [{r.child: r for r in level.collect()} for level in packing._tree(frame, len(tail), queues)]
    out = np.full(len(tokens), 12.0)
    for i in tail:
        child = f"s{i}"
        for level in levels:
            parent = level[child].parent
            whole = level.setdefault(("whole", parent), None) or sum(r.w for k, r in level.items() if isinstance(k, str) and r.parent == parent)
            level["whole", parent] = whole
            out[i] += width * weight[i] / whole + 12
            child = parent
    return out


@pytest.mark.parametrize(("temperature", "queues"), [(1.0, 100), (0.5, 100), (1.0, 20)])
def test_each_of_5000_sources_keeps_its_share(spark, temperature, queues):
    """Two kinds of sources, of 40 and of 160 tokens, more of them than queues (and, of 20, than groups): at each window's end a source has its share, but for
    its part of one window of its group."""
    from pyspark.sql import functions as F

    n, width = 5000, 512
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(F.col("id") % 5 == 0, 159).otherwise(39).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    rows = packing.pack(docs.repartition(4), width=width, temperature=temperature, max_queues=queues).select("doc_id", "start", "length", "sequence_id", "offset", "doc_tokens").collect()
    tokens = {i: 160 if i % 5 == 0 else 40 for i in range(n)}
    total = sum(tokens.values())
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
    for i, own in spans.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == tokens[i]
    filled = np.zeros(-(-total // width), np.int64)
    np.add.at(filled, [r.sequence_id for r in rows], [r.length for r in rows])
    assert (filled[:-1] == width).all() and filled.sum() == total
    given = np.zeros((n, len(filled)), np.int64)
    np.add.at(given, ([r.doc_id for r in rows], [r.sequence_id for r in rows]), [r.length for r in rows])
    given = given.cumsum(1)
    weight = np.array([tokens[i] ** temperature for i in range(n)])
    most = parts_of_windows(spark, tokens, weight, queues, width)
    reach = 1.0 if temperature == 1.0 else 0.2  # the tempered mix holds until the first source is empty
    for w in range(len(filled)):
        t = min(total, (w + 1) * width)
        if t <= reach * total:
            behind = t * weight / weight.sum() - given[:, w]
            assert (np.abs(behind) <= most).all()
    assert np.median(most) < width / 8


def test_a_tail_of_small_sources_keeps_all_tokens(spark):
    docs = spark.createDataFrame([(i, "x " * (1000 - i), f"s{i}", i) for i in range(40)] + [(99, "y", None, 1), (None, "z z", "s39", 1), (7, "again", "s7", 1), (7, "again", "s7", 1)], "doc_id long, text string, source string, spans int")
    rows = packing.pack(docs, targets={"s39": 0.1}, max_queues=3).collect()
    assert sum(r.length for r in rows if r.doc_id == 99) == 2 and sum(r.length for r in rows) == sum(1001 - i for i in range(40)) + 2 + 3 + 4
    taken = defaultdict(int)
    for r in rows:
        taken[r.sequence_id] += r.length
    assert sorted(taken) == list(range(len(taken))) and all(taken[k] == 4096 for k in range(len(taken) - 1))


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(packing.vocabulary()).to_str())
    assert packing.WordTokenizer._cuts_parts(spec)
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    tok, texts = packing.WordTokenizer(str(path)), ["Hello THERE's 42", None, "", "É x"]
    assert not tok.by_parts
    whole = Tokenizer.from_file(str(path))
    assert [np.frombuffer(x, "<u4").tolist() for x in tok(pa.array(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("kept", "kept_bytes"), [(400_000, 32 << 20), (40, 32 << 20), (400_000, 600), (0, 0)])
def test_words_are_encoded_when_first_met(monkeypatch, kept, kept_bytes):
    """However few words are kept, ids are those of whole texts; and a word that is kept is not encoded again, in later slices or tasks."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing._Known, "KEPT", kept)
    monkeypatch.setattr(packing._Known, "KEPT_BYTES", kept_bytes)
    tok, whole, rng = packing.WordTokenizer(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary()), np.random.default_rng(5)
    words = ["The", "the,", "don't", "DON'T", "x's's", "''s", "été", "ÉTÉ!!", "a1b22", "3.14", "...", "e\u0301te\u0301", "日本語テキスト", "ΣΑΣ", "\u0130x", "<|endoftext|>", "a<|b", "\u00a0", "x" * 70, "\x1c", "ſß", "'", "'LL", "½"]
    slices = [[None, ""] + [" \n".join(rng.choice(words[: 11 if k % 2 else None], rng.integers(1, 30)).tolist() + [f"w{k}{j}"]) for j in range(20)] for k in range(12)]
    for texts in slices:
        assert [np.frombuffer(x, "<u4").tolist() for x in tok(pa.array(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        for store in (tok.lowered, tok.any):
            assert len(store.words) == len(store.ids) == len(store.uses) and len(store.words) <= kept and store.words.nbytes + store.ids.nbytes <= kept_bytes
    assert packing.tokenizer(packing.vocabulary()) is packing.tokenizer(packing.vocabulary())
    if kept > 1000 < kept_bytes:
        tok.lowered.encode = tok.any.encode = None
        for texts in slices:
            tok(pa.array(texts))


def test_ids_take_two_bytes(spark):
    docs = spark.createDataFrame([(1, "Hello there, world", "a"), (2, None, "a"), (3, "日本 x", "b")], "doc_id long, text string, queue string")
    rows = packing.tokenized(docs, packing.vocabulary()).collect()
    assert len(rows) == 3 and all(len(r.ids) == 2 * r.doc_tokens for r in rows)
    large = {r.doc_id: r for r in packing.tokenized(docs, packing.vocabulary(), end_id=70_000).collect()}
    for r in rows:
        want = np.frombuffer(r.ids, "<u2").tolist()
        assert want[-1] == packing.END_ID and np.frombuffer(large[r.doc_id].ids, "<u4").tolist() == want[:-1] + [70_000]


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_a_run_of_windows_is_found_once(monkeypatch, targets):
    """Each further window of a run takes one count, not a search."""
    plan = packing.Plan({"a": 400_000, "b": 30_011, "c": 90_000}, targets, 512)
    calls, taken = [], packing.Plan.taken
    monkeypatch.setattr(packing.Plan, "taken", lambda *a: calls.append(a) or taken(*a))
    pieces = list(plan.cut("a", 1000, 399_000))
    assert sum(p[1] for p in pieces) == 398_000 and len(pieces) > 800
    assert len(calls) < 1.1 * len(pieces)


def test_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, World's end 42", None, "", " \t\n", "a" * 5000, "Ünïcödé «quotes» don't 3.14\x0b\x85x y " * 300, "<|endoftext|> x<|startoftext|>", "Σίσυφος ΟΔΟΣ", "İstanbul I'LL's 'tis éÉ½²x <|x ŉ ſß ĿÀ\u0301 a\u00a0b\u001cc\x7f", "é ́x", "it 's"] * 3
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)], "doc_id long, text string, source string, task int").repartition(3)
    docs = docs.withColumn("queue", docs["task"]).withColumn("ids", docs["task"])
    tok = Tokenizer.from_file(packing.vocabulary())
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = packing.pack(docs, targets={"s1": 0.6}).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(sum(r.length for r in s) < 4096 for s in seqs.values()) <= 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
