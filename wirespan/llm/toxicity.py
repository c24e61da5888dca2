"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, drops zero-width characters and combining accents, maps look-alike letters of other
scripts and digits or signs that stand for letters (1d10t, $cum) to Latin letters, and turns what is no letter
into single blanks. Digits stand for letters only next to one: 455 is a number. Scripts that put no blanks between words are cut into
characters, each of which counts as a word. Entries are whole words, word beginnings and, in such scripts, runs of two to four characters; each has a weight. An occurrence inside an
exception phrase does not count. The sum of weights over the number of words, and the sum itself, give a score
through a logistic curve.

Weights are learned from labelled documents, at most `max_rows` of them (the least hashes of
doc_id): log-odds of an entry among toxic and other documents. Copies would make chance words look
toxic, so training documents that share a minimum hash of word triples count once. An entry must
pass a test against chance that takes the number of candidates into account, and of entries that
begin with one another the best one stays. Exceptions are learned too: phrases of two words, one of them with
an entry, that are no more frequent in toxic documents than in others, though documents with the entry
are mostly toxic; a test against chance decides. Phrases known beforehand can be given. A lexicon has
no cap: it grows with the bounded training sample alone, since every entry is in three of its documents.

Defined cases: a null or empty text has score `empty`, that of a text without matches. With no
usable labels the lexicon is empty and every score is that of no match. Repeated documents are
scored one by one. Labels with a null doc_id or mark are left out; a document with several
labels counts with the greatest. An empty table of documents gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.llm.common import hashed, rolling, thrifty, words_of, written

MAX_ROWS = 20_000
PREFIXES = range(3, 11)
# Letters of other scripts that look like Latin ones, and digits that stand for letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһӏкмтвнαορτυνκιеАВЕКМНОРСТХІЈЅΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aeopcyxijsdhlkmtbhaoptuvkieabekmhopctxijsabehikmnoptyxz", strict=True))
DIGITS = dict(zip("01345789", "oieastbg", strict=True))
_TABLE = str.maketrans(LOOK_ALIKE | {"ı": "i"})
_DIGITS = str.maketrans(DIGITS)
#: A run of letters and digits with both.
_MIXED = re.compile(r"(?<![^\W_])(?:[^\W\d_]++\d|\d++[^\W\d_])[^\W_]*+")
_DIGIT = re.compile(r"\d")
# Letters and signs of scripts without blanks: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0e4f\u0e80-\u0ecf\u1000-\u103f\u1780-\u17d3\u3041-\u3096\u30a1-\u30fa\u30fc\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_PIECES = re.compile(f"{_UNSPACED.pattern}|[^{_UNSPACED.pattern[1:-1]}]+")
_SPACES = re.compile(" +")
RUNS = range(2, 5)
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])|\B[@$](?=[^\W\d_])")
_SIGNS = {"@": "a", "$": "s", "!": "i"}
_GAP = re.compile(r"[\W\d_]+")
#: Combining accents, and characters of no width.
_UNSEEN = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]+")


def fold(text: str | None) -> str:
    """Folded words, with a blank before and after each."""
    t = text or ""
    plain = t.isascii()
    if not plain:
        t = unicodedata.normalize("NFKC", _UNSEEN.sub("", unicodedata.normalize("NFKD", t))).translate(_TABLE)
        t = _UNSEEN.sub("", t.lower())
    else:
        t = t.lower()
    if _DIGIT.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_DIGITS), t)
    if "@" in t or "$" in t or "!" in t:
        t = _SIGN.sub(lambda m: _SIGNS[m[0]], t)
    if plain or not _UNSPACED.search(t):
        return f" {_GAP.sub(' ', t).strip()} "
    return f" {_SPACES.sub(' ', ''.join(f' {x} ' if _UNSPACED.match(x) else _GAP.sub(' ', x) for x in _PIECES.findall(t))).strip()} "


def runs(words: list[str]) -> set[str]:
    """Runs of two to four characters of scripts without blanks, as entries."""
    out = set()
    if not any(_UNSPACED.match(w) for w in words):
        return out
    single = [len(w) == 1 and _UNSPACED.match(w) is not None for w in words]
    for n in RUNS:
        out.update(f" {' '.join(words[k : k + n])} " for k in range(len(words) - n + 1) if all(single[k : k + n]))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)  # constant, of the rate, of the sum

    def __post_init__(self):
        self.machine = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            self.machine.add_word(entry, (len(entry), w))
        if self.weights:
            for phrase in self.exceptions:
                key = fold(phrase)
                self.machine.add_word(key, (len(key), None))
            self.machine.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """Where a word with an entry begins, and its weight: the greatest of its entries, if no exception covers it."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []  # in the order of their ends
        if self.weights:
            for end, (n, w) in self.machine.iter(folded):
                if w is None:
                    spared.append((end + 1 - n, end))
                else:
                    at = end + 1 - n
                    best[at] = max(best.get(at, 0.0), w)
        if not spared:
            return sorted(best.items())
        spared.sort()
        out, k, reach = [], 0, -1
        for at, w in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= at:
                reach = max(reach, spared[k][1])
                k += 1
            if at >= reach:
                out.append((at, w))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w in self.matches(folded))
        return np.log1p(100.0 * total / max(10, folded.count(" ") - 1)), np.log1p(total)

    def score(self, text: str | None) -> float:
        rate, total = self.features(text)
        c, a, b = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(c + a * rate + b * total, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of the labelled documents, those with the least hashes."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) of which none share a minimum hash over word triples; of those that do, the least hash of the text stays."""

    def run(batches):
        for batch in batches:
            words, at = words_of(batch.column("text"))
            h = hashed(words)
            groups = [[], [], []]
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = rolling(h[a:b], 3) if b - a >= 3 else h[a:b]
                for k, g in enumerate(groups):
                    g.append(int(np.min(own * np.uint64(2 * k + 0x9E3779B97F4A7C15) ^ own >> np.uint64(11 * k))) >> 1 if len(own) else -1)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), *(pa.array(g, pa.int64()) for g in groups)], names=["text", "toxic", "g0", "g1", "g2"])

    out = rows.mapInArrow(thrifty(run), "text string, toxic int, g0 long, g1 long, g2 long")
    for g in ("g0", "g1", "g2"):
        least = F.min(F.struct(F.xxhash64("text"), "text", *(x for x in ("g1", "g2") if x > g))).alias("r")
        out = out.groupBy(g, "toxic").agg(least).select("toxic", "r.*")
    return out.select("text", "toxic")


def _counts(rows: DataFrame) -> DataFrame:
    """feature, n_toxic, n_other: documents with it, counted within a batch first."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set()
                words = fold(text).split()
                own.update(runs(words))
                for w in set(words):
                    own.add(f" {w} ")
                    own.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
                counts[toxic > 0].update(own)
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], names=["feature", "t", "o"])

    return rows.mapInArrow(thrifty(run), "feature string, t long, o long").groupBy("feature").agg(F.sum("t").alias("n_toxic"), F.sum("o").alias("n_other"))


def _gain(n_toxic: Column, n_other: Column, base: Column) -> Column:
    """Log-likelihood ratio of a share of toxic documents against a base share."""
    n = n_toxic + n_other
    p = n_toxic / n
    return n * (F.when(p > 0, p * F.log(p / base)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    rows = written(training_rows(docs, labels, max_rows))
    distinct = written(_distinct(rows))
    sizes = {bool(r[0]): r[1] for r in distinct.groupBy(F.col("toxic") > 0).count().collect()}
    n_t, n_o = sizes.get(True, 0), sizes.get(False, 0)
    if not n_t or not n_o:
        return Lexicon(exceptions=exceptions)
    counts = written(_counts(distinct))
    n_features = counts.count()
    base = F.lit(n_t / (n_t + n_o))
    weight = F.log((F.col("n_toxic") + 0.5) / (n_t + 1.0)) - F.log((F.col("n_other") + 0.5) / (n_o + 1.0))
    strong = (
        counts.where((F.col("n_toxic") >= 3) & (F.col("n_toxic") / (F.col("n_toxic") + F.col("n_other")) > base)).select("feature", weight.alias("weight"), _gain(F.col("n_toxic"), F.col("n_other"), base).alias("gain"))
        .where((F.col("gain") >= float(np.log(n_features) + 2)) & (F.col("weight") >= 2.0)).orderBy(F.desc("gain"), F.col("feature").endswith(" "), F.desc(F.length("feature")), "feature")
    )
    weights: dict[str, float] = {}
    nested: set[str] = set()  # beginnings of the entries
    for r in strong.toLocalIterator():
        own = [r["feature"][:k] for k in range(2, len(r["feature"]) + 1)]
        if own[-1] not in nested and not any(x in weights for x in own):
            weights[own[-1]] = r["weight"]
            nested.update(own)
    lexicon = Lexicon(weights, (*exceptions, *_harmless(distinct, Lexicon(weights), n_t, n_o)))
    lexicon.curve = _fit(rows, lexicon)
    return lexicon


def _harmless(rows: DataFrame, lexicon: Lexicon, n_t: int, n_o: int) -> list[str]:
    """Two-word phrases with an entry which, unlike the entry, are not toxic: found in three other documents or more, with a share of
    toxic ones not above that of all documents, and below the entry's own share by more than chance gives."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, own = fold(text), set()
                for at, _ in lexicon.matches(folded):
                    end = folded.index(" ", at + 1)
                    word = folded[at + 1 : end]
                    own.add((word, ""))
                    if at:
                        own.add((word, f"{folded[folded.rindex(' ', 0, at) + 1 : at]} {word}"))
                    if end + 1 < len(folded):
                        own.add((word, f"{word} {folded[end + 1 : folded.index(' ', end + 1)]}"))
                counts[toxic > 0].update(own)
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["word", "phrase", "t", "o"])

    if not lexicon.weights:
        return []
    found = written(rows.mapInArrow(thrifty(run), "word string, phrase string, t long, o long").groupBy("word", "phrase").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    alone = found.where("phrase = ''").select("word", ((F.col("t") + 0.5) / (F.col("t") + F.col("o") + 1.0)).alias("share"))
    both = found.where("phrase <> ''").join(alone, "word")
    rare = (F.col("o") >= 3) & (F.col("t") * (n_t + n_o) <= F.col("o") * n_t) & (F.col("share") > n_t / (n_t + n_o))
    sure = _gain(F.col("t"), F.col("o"), F.col("share")) >= float(np.log(found.count() + 1) + 2)
    return [r["phrase"] for r in both.where(rare & sure).select("phrase").distinct().orderBy("phrase").toLocalIterator()]


def _fit(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """The logistic curve over both features, from counts of rounded features (few of them, however many rows)."""

    def run(batches):
        for batch in batches:
            found = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                rate, total = lexicon.features(text)
                found[round(10 * rate), round(10 * total), int(toxic > 0)] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.int32()) for j in range(3)] + [pa.array([found[k] for k in keys], pa.int64())], names=["rate", "total", "toxic", "n"])

    cells = rows.mapInArrow(thrifty(run), "rate int, total int, toxic int, n long").groupBy("rate", "total", "toxic").agg(F.sum("n").alias("n")).collect()
    x = np.array([[1.0, r["rate"] / 10, r["total"] / 10] for r in cells])
    y, n = np.array([r["toxic"] for r in cells], float), np.array([r["n"] for r in cells], float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score, and what counted: the number of matches and the sum of their weights."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))

    def run(batches):
        own = Lexicon(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """docs that score under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))
    at = docs.columns.index("text")

    def run(batches):
        own = Lexicon(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)


def explain(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """The words of one text that count, with their weights."""
    folded = fold(text)
    return [(folded[at:].split(" ", 2)[1], w) for at, w in lexicon.matches(folded)]
