import hashlib
import random

import pytest

from wirespan.llm import substring_dedup


def brute(rows, width=20):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, sha256)}"""
    docs = sorted((i, [w for w in (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, t in rows)
    seen, out = set(), {}
    for i, words in docs:
        gone = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone.update(range(k, k + width))
            seen.add(window)
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 37, 60, 200)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 100), (4, "b c\x0b" * 60), (-7, " ".join(passages[4]))]
    for i in range(5, 120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            text += p if rng.random() < 0.7 else p[rng.randrange(0, 10) :]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(1000 + k, rows[40][1]) for k in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, places string, slice binary").repartition(7)
    want = brute(rows)
    docs = docs.withColumn("range", docs["doc_id"]).withColumn("batch", docs["doc_id"]).withColumn("kind", docs["text"])
    for range_words, fan_bits, slice_bytes in ((3_000_000, 8, 1 << 22), (600, 1, 2000), (300, 8, 9000)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs, range_words=range_words, fan_bits=fan_bits, slice_bytes=slice_bytes).collect()}
        assert got == want, (range_words, fan_bits)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (6, text + " end"), (None, None)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.digest(docs).collect())
    assert got == [(False, 5, 30, 30), (False, 5, 30, 30), (False, 6, 31, 30), (True, 0, 0, 0), (True, 0, 30, 0)]
    assert substring_dedup.digest(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect() if r.doc_id}
    assert kept == {5: "", 6: "end"}


def test_a_repeated_task_cuts_the_same_slices_from_other_row_orders(spark, monkeypatch):
    """Entries of both rounds, of a task whose rows come in two orders, and the digests."""
    made, run = [], substring_dedup._round

    def spied(docs, make, merge, width, *sizes):
        rows = docs.coalesce(1).sortWithinPartitions("doc_id", "text_hash").mapInArrow(make(2, width), substring_dedup.PACKED)
        made.append([tuple(r) for r in rows.collect()])
        return run(docs, make, merge, width, *sizes)

    monkeypatch.setattr(substring_dedup, "_round", spied)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join([f"w{rng.randrange(99)}" for _ in range(60)] + passage + [f"e{i}"])) for i in range(60)] + [(7, "again")]
    digests = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        digests.append(sorted(map(tuple, substring_dedup.digest(docs).collect())))
    assert made[0] == made[2] and made[1] == made[3] and len(made[1]) > 1
    assert digests[0] == digests[1]


def test_rows_grow_with_the_input_and_not_with_its_square(spark, monkeypatch):
    """Twice the documents, with twice the slices and ranges: about twice the rows."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(1200)], "doc_id long, text string").repartition(2)
    counts, run = [], substring_dedup._dealt
    monkeypatch.setattr(substring_dedup, "_dealt", lambda rows, *more: (counts.append(rows.count()), run(rows, *more))[1])
    most = []
    for n in (600, 1200):
        counts.clear()
        substring_dedup.later_windows(docs.where(f"doc_id < {n}"), range_words=400, fan_bits=2, slice_bytes=8000)
        most.append(max(counts))
    assert most[1] < 2.6 * most[0]


@pytest.mark.parametrize("size", [1 << 30, 1 << 40, 100 << 40])
def test_partitions_stay_few_at_any_input(spark, monkeypatch, size):
    """The partitions of a pretended input, by the numbers of groups that _round() asks for."""
    asked = []
    monkeypatch.setattr(substring_dedup, "_dealt", lambda rows, groups, usual, *by: (asked.append(substring_dedup.partitions(groups, usual)), rows)[1])
    docs = spark.createDataFrame([(1, 1, "a")], "doc_id long, text_hash long, text string")
    monkeypatch.setattr(substring_dedup, "written", lambda df: df)
    substring_dedup._round(docs, substring_dedup._anchor_rows, substring_dedup._merged_blocks, 20, size, substring_dedup.RANGE_WORDS, substring_dedup.FAN_BITS, substring_dedup.HASH_BYTES)
    assert asked and max(asked) <= substring_dedup.MOST
