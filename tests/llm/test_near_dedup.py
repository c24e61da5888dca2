import random
from collections import Counter

import numpy as np
import pytest

from wirespan.llm import near_dedup


def bag(text):
    w = (text or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def brute(rows):
    """(doc_id, text) -> {doc_id: least doc_id of its class}"""
    bags = [(i, bag(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(bags):
        for j, b in bags[:x]:
            both = sum((a & b).values())
            if both and both >= 0.8 * sum((a | b).values()):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows, made = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not made:
            text = [word() for _ in range(rng.randrange(1, 120))] + (passage if rng.random() < 0.4 else [])
        else:
            text = list(rng.choice(made))
            if kind < 0.8:
                for _ in range(rng.randrange(0, 4)):
                    text[rng.randrange(len(text))] = word()
        made.append(text)
        rows.append((i, " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a " * 50), (n + 4, "a " * 52), (n + 5, "a " * 80), (n + 6, "a")]
    rng.shuffle(rows)
    return rows


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 300, dtype=np.uint64)
    h.sort()
    for wa, wb in [(np.ones(300, int), np.where(np.arange(300) < 200, 1, 3)), (rng.integers(1, 40, 300), rng.integers(1, 40, 300))]:
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        sig = near_dedup.signatures([(h, wa), (h, wb), (h[:0], wa[:0])], 4096)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03
        assert not sig[2].any()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id long, text string, node long, rep string").repartition(5)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == want
    kept = sorted(r.doc_id for r in near_dedup.keep_first(docs).collect())
    assert kept == sorted(set(want.values()))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs, few=3, block=4).collect()} == want


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.class_id) for r in near_dedup.classes(docs).collect()) == ["4", "4", "4", "None"]
    assert near_dedup.keep_first(docs).count() == 2
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_unrelated_texts_of_null_or_repeated_ids_stay(spark):
    rows = [(None, "a b c"), (None, "d e f"), (None, "d e f"), (7, "g h i"), (7, "j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in near_dedup.keep_first(docs).collect()) == ["a b c", "d e f", "g h i", "j k l"]


def test_a_large_class_a_chain_and_a_very_long_text(spark):
    """150 texts all alike, a chain of 40 whose ends share nothing, and a text of a million words with a near copy, amid copies."""
    rng = random.Random(11)
    body = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        rows.append(" ".join(body[: i % 10] + [f"x{i}"] + body[i % 10 :]))
    for i in range(40):
        rows.append(" ".join(f"c{k}" for k in range(10 * i, 10 * i + 104)))
    rows += [rows[3]] * 50
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(i, rows[k]) for i, k in enumerate(order)]
    want = brute(rows)
    assert len(set(want.values())) == 2
    long = " ".join(f"v{k % 7919}x{k % 13}" for k in range(1_000_000))
    rows += [(1000, long), (1001, long + " end"), (1002, None), (1003, "")]
    want |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1003}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == want


def test_template_documents_against_brute_force(spark):
    """Documents of one long template, cross similarity just under 0.8, with planted near-copies among them."""
    rng = random.Random(7)
    template, rows = [f"t{k}" for k in range(220)], []
    for i in range(1500):
        own = [f"o{i}_{k}" for k in range(40)]
        rows.append(template + own)
        rows.append(template + own[: rng.choice([20, 25, 30])] + [f"p{i}_{k}" for k in range(20)])
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(i, " ".join(rows[k])) for i, k in enumerate(order)]
    bags = [bag(t) for _, t in rows]
    column = {}
    for b in bags:
        for s in b:
            column.setdefault(s, len(column))
    holders = np.bincount([column[s] for b in bags for s in b])
    dense = {c: k for k, c in enumerate(np.flatnonzero(holders > 2))}
    matrix = np.zeros((len(bags), len(dense)), np.float32)
    pairs = {}
    for d, b in enumerate(bags):
        for s in b:
            c = column[s]
            if c in dense:
                matrix[d, dense[c]] = 1
            elif holders[c] == 2:
                pairs.setdefault(c, []).append(d)
    both = matrix @ matrix.T
    for d, e in pairs.values():
        both[d, e] += 1
        both[e, d] += 1
    sizes = np.array([len(b) for b in bags])
    linked = both >= 0.8 * (sizes[:, None] + sizes[None, :] - both)
    root = list(range(len(bags)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, e in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        p, q = find(int(d)), find(int(e))
        root[max(p, q)] = min(p, q)
    want = {i: find(i) for i, _ in rows}
    assert len(set(want.values())) == 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs, block=400).collect()} == want
