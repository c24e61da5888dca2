"""Language identification by compression.

For each language a zstandard dictionary of raw text is made from a bounded sample of labelled
documents. A text, brought to lower-case words without marks, digits and immediate repetitions, is
encoded with each dictionary in blocks, so that what counts is likeness to the dictionary and not
to the rest of the text. The language whose dictionary gives the fewest bytes is the prediction.
It is trusted only if the margin over the second is wide enough. Labels can be wrong: half of the
sample judges the other half first, and documents that come out as another language leave it, as
do those whose text is in the sample for two languages.

Every label value is learned. Training takes at most `sample_docs` documents of each language, those with the least
hashes of doc_id, and stops where those taken have `dictionary_bytes` of text; a document that is taken is taken whole. So all
languages have dictionaries of like size, however many there are; what is collected and broadcast is as much for each, and one document more.

Defined cases: a null text, or one without letters, is `und` with score 0. At equal size the
language with more training documents wins, then the first by name. With one language, or none, the
margin is 0. Labelled rows with a null doc_id or text are not learned from; of training rows with one doc_id and
language that with the least hash of the text counts. Repeated rows are judged alike. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS, DICTIONARY_BYTES = 192, 256 << 10
BLOCK, LEVEL, MARGIN = 512, 3, 0.02
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, raw dictionary), most frequent first, from rows (doc_id, text, lang)."""
    known = labelled.where("lang is not null")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not langs:
        return []
    usable = known.where("text is not null and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("digest")]
    # ids and sizes first: a window that ends early is cut before it is shuffled, and texts are read for the chosen rows alone
    sized = usable.select("doc_id", "lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("digest"))
    first = sized.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= 2 * sample_docs)
    one = first.groupBy("doc_id", "lang").agg(F.min(F.struct("digest", "size")).alias("row")).select("doc_id", "lang", "row.digest", "row.size")
    ahead = Window.partitionBy("lang").orderBy(*order)
    taken = one.withColumns({"rank": F.row_number().over(ahead), "before": F.sum("size").over(ahead) - F.col("size")}).where((F.col("rank") <= sample_docs) & (F.col("before") < dictionary_bytes))
    chosen = F.broadcast(taken.select("doc_id", "lang", "digest"))
    rows = usable.withColumn("digest", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "digest"], "left_semi").select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"]).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").collect()
    texts: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in rows:
        texts[r["lang"]].append(normal(r["text"]))
    seen = Counter(t for own in texts.values() for t in set(own))
    texts = {lang: [t for t in dict.fromkeys(own) if seen[t] == 1] for lang, own in texts.items()}
    halves = [Classifier(_dictionaries({lang: own[k::2] for lang, own in texts.items()})) for k in (0, 1)]
    sound = {lang: [t for k, t in enumerate(own) if halves[1 - k % 2].best(t)[0] == lang] for lang, own in texts.items()}
    return _dictionaries({lang: sound[lang] or own for lang, own in texts.items()})


def _dictionaries(texts: dict[str, list[str]]) -> list[tuple[str, bytes]]:
    """Texts of a language in a row."""
    return [(lang, b"\n".join(t.encode("utf-8", "replace") for t in own) or b"\n") for lang, own in texts.items()]


def normal(text: str) -> str:
    words = LETTERS.findall(text.lower())
    return " ".join([w for w, before in zip(words, [None, *words], strict=False) if w != before])


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        self.langs = [lang for lang, _ in dictionaries]
        self.coders = []
        for _, raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw.rjust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace")
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders])

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language, and the margin: by how much the second best is larger, as a share of it."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        return self.best(normal(text))

    def best(self, plain: str) -> tuple[str, float]:
        sizes = self.sizes(plain)
        order = np.argsort(sizes, kind="stable")
        margin = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 and sizes[order[1]] else 0.0
        return self.langs[order[0]], float(margin)


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], min_margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1; 0.5 at the margin asked for) and trusted (whether the margin is that wide)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        classify = Classifier(shared.value)
        for batch in batches:
            made = [classify(t.as_py()) for t in batch.column("text")]
            margins = np.array([m for _, m in made], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in made], pa.string()), pa.array(margins / (margins + min_margin), pa.float64()), pa.array(margins >= min_margin, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "trusted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, trusted boolean")
