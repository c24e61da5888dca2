"""Quality rules as a short-circuit cascade.

Every rule is a condition that a good text meets. On a sample (`sample_rows` documents at most, those
with the least hashes, without those that fail the base and so never reach the rules) each rule is timed and its
rejections are counted; rules then run in the order of rejections per second, and a text that one of them
rejects is not shown to the others. What several rules ask for (NEEDS: the split into words) is made once a text; it has a cost of its own, which
counts for the first rule of the order that needs it and for none after. Costs are CPU time, the least of `REPEATS` runs on fresh texts. They are
measured, so two runs may order rules of like worth differently. The order changes the cost alone, never the outcome: which rule rejected
a text depends on it, so that is not told.

Defined cases: a null or empty text has no words and fails the base. Repeated rows and null doc_ids are judged as others.
Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import hashed, rolling, slices, words_of

SAMPLE_ROWS, REPEATS = 2_000, 3
SYMBOLS = "#*$%&|<>"
BLANK = re.compile("[ \t-\r]*")


class Facts:
    """What the rules may ask of one text."""

    def __init__(self, text: str, n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int):
        self.text, self.n_words, self.word_chars = text, n_words, word_chars
        self.n_symbols, self.n_dup_lines, self.n_repeat_words = n_symbols, n_dup_lines, n_repeat_words

    def fresh(self) -> Facts:
        """The same text, of which nothing has been asked."""
        return Facts(self.text, self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words)

    @cached_property
    def words(self) -> list[str]:
        """As counted: runs without the white space of ASCII."""
        return [w.decode("utf-8", "surrogatepass") for w in self.text.encode("utf-8", "surrogatepass").split()]


#: Letters with their marks (vowel signs, accents, joiners), as words of all scripts are written.
LETTERS = regex.compile(r"[\p{L}\p{M}\u200c\u200d]*\p{L}[\p{L}\p{M}\u200c\u200d]*")


def _lettered(word: str) -> bool:
    bare = word.strip(".,;:!?\"'()\u0964\u0965\u3001\u3002\uff0c")
    return bare.isalpha() or (not bare.isascii() and LETTERS.fullmatch(bare) is not None)


def _letters(f: Facts) -> bool:
    return sum(map(_lettered, f.words)) >= 0.5 * f.n_words


#: name -> condition of a good text
RULES: dict[str, Callable[[Facts], bool]] = {
    "few symbols": lambda f: 10 * f.n_symbols <= 3 * f.n_words,
    "usual word length": lambda f: 2 * f.n_words <= f.word_chars <= 15 * f.n_words,
    "few repeated lines": lambda f: 2 * f.n_dup_lines <= f.text.count("\n") + 1,
    "no word dominates": lambda f: f.n_words < 20 or max(Counter(f.words).values()) <= 0.4 * f.n_words,
    "mostly letters": _letters,
}

#: name -> what it asks of Facts that others may have asked for
NEEDS: dict[str, tuple[str, ...]] = {"no word dominates": ("words",), "mostly letters": ("words",)}


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def facts(texts: pa.Array) -> list[Facts]:
    words, at = words_of(texts)
    h = hashed(words)
    lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))])
    windows = rolling(h, 5)
    out = []
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        text = texts[k].as_py() or ""
        repeat = 0
        if b - a >= 6:
            own = windows[a : b - 4]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(len(own) + 1, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                hit = np.zeros(b - a, bool)
                for j in range(5):
                    hit[j : j + len(own)] |= twice[:-1]
                repeat = int(hit.sum())
        out.append(Facts(text, int(b - a), int(lengths[b] - lengths[a]), sum(map(text.count, SYMBOLS)), _dup_lines(text), repeat))
    return out


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += BLANK.fullmatch(line) is None
        else:
            seen.add(line)
    return n


def _spent(seen: list[Facts], ask: tuple[str, ...], run: Callable[[Facts], object]) -> float:
    """CPU seconds of run over fresh texts of which `ask` has been asked."""
    best = float("inf")
    for _ in range(REPEATS):
        texts = [f.fresh() for f in seen]
        for f in texts:
            for name in ask:
                getattr(f, name)
        began = time.thread_time()
        for f in texts:
            run(f)
        best = min(best, time.thread_time() - began)
    return best


def by_worth(rules: list[str], rejected: dict[str, int], own: dict[str, float], shared: dict[str, float], needs: dict[str, tuple[str, ...]]) -> list[str]:
    """The rules by rejections per second; what a rule shares with those chosen before it costs nothing more. Equal ones keep their order."""
    left, out, paid = list(rules), [], set()
    while left:
        cost = {name: own[name] + sum(shared[x] for x in needs.get(name, ()) if x not in paid) for name in left}
        best = max(left, key=lambda name: (rejected[name] / max(cost[name], 1e-9), -rules.index(name)))
        out.append(best)
        left.remove(best)
        paid.update(needs.get(best, ()))
    return out


def cascade_order(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS, needs: dict = NEEDS) -> list[str]:
    """The rules' names in the order to run them; a task times the rules, and what they share, on its own rows of the sample."""
    by_hash = F.xxhash64("doc_id").alias("h")
    chosen = docs.select(by_hash).orderBy("h").limit(sample_rows)
    sample = docs.select("text", by_hash).join(chosen, "h", "left_semi").select("text")
    facts_of = sorted({x for name in rules for x in needs.get(name, ())})

    def run(batches):
        for batch in batches:
            seen = [f for f in facts(batch.column("text")) if not base_failed(f.n_words, f.n_repeat_words)]
            names = [*rules, *facts_of]
            rejected = [sum(not rules[name](f) for f in seen) for name in rules] + [0] * len(facts_of)
            spent = [_spent(seen, needs.get(name, ()), rules[name]) for name in rules] + [_spent(seen, (), attrgetter(x)) for x in facts_of]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rejected, pa.int64()), pa.array(spent, pa.float64())], names=["name", "rejected", "seconds"])

    found = {r["name"]: r for r in sample.mapInArrow(run, "name string, rejected long, seconds double").groupBy("name").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()}
    value = lambda name, column: found[name][column] if name in found else 0
    return by_worth(list(rules), {n: value(n, "rejected") for n in rules}, {n: value(n, "seconds") for n in rules}, {x: value(x, "seconds") for x in facts_of}, needs)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """COLUMNS for every document."""
    order = cascade_order(docs, rules, sample_rows)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for f in facts(batch.column("text")):
                    failed = base_failed(f.n_words, f.n_repeat_words)
                    kept = not failed and all(rules[name](f) for name in order)
                    rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=[x.split()[0] for x in COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)
