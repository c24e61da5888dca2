"""The pipeline against its stages done by hand, on the smallest tables."""

import gc
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wirespan.llm import common, decontaminate, near_dedup, packing, toxicity
from wirespan.llm.common import table
from wirespan.llm.queries import fold_of

SF = "/root/testdata/sf0.001"


def bag(text):
    w = (text or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def test_pipeline_by_hand(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = duckdb.sql(f"SELECT CAST(item_id AS VARCHAR), text FROM '{SF}/benchmark.parquet'").fetchall()
    lexicon = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels").where(fold_of(4) != 2))
    docs = {i: t for i, t in docs.items() if lexicon.score(t) < 0.3}
    owners = defaultdict(set)
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs.items():
        for x in t.split("\n"):
            owners[key(x)].add(i)
    docs = {i: "\n".join(x for x in t.split("\n") if not key(x) or len(owners[key(x)]) < 10) for i, t in docs.items()}
    root, bags = {i: i for i in docs}, {i: bag(t) for i, t in docs.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = {i: t for i, t in docs.items() if find(i) == i}
    machine = decontaminate.Automaton(items)

    def dirty(t):
        words = decontaminate.words_of(t)
        return decontaminate.is_contaminated(sum(b - a for a, b in machine.scan(words)[0]), len(words))

    docs = {i: t for i, t in docs.items() if not dirty(t)}
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    got, sequences = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want
    assert sum(n < 4096 for n in sequences.values()) <= 1


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.schema == docs.schema, name


CLEAN = " ".join(f"word{k}" for k in range(60))
ODD = [
    (None, None, None, None, None), (None, CLEAN, "en", None, 3), (1, "", None, "s", None), (2, " \n\t", "en", "s", 0), (3, CLEAN, "en", "s", 1), (3, CLEAN, "en", "s", 1), (4, CLEAN + " more", None, None, 1),
    (5, " ".join(f"w{k % 9973}" for k in range(300_000)), "en", "s", 9), (6, "x" * 200_000, "en", "s", 9), (7, "Ünï\u200b çödé \ud7ff", "de", "", 1), (None, "only text of a null id", None, None, None),
]


def odd_documents(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ids and texts, and columns with names that operators use."""
    rows = [(i, t, lang, source, n, "k", 5, "h", b"n", 1.0, "q", 2) for i, t, lang, source, n in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string, n int, text_hash string, node binary, score double, queue string, task int").repartition(3)


def test_stages_with_odd_documents(spark):
    docs = odd_documents(spark)
    blank = sum(not (t or "").strip() for _, t, *_ in ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert sum(not (r.text or "").strip() for r in rows) == blank, name
        if name == "near dedup":  # the plain text three times under 3 and null, and the longer one, are one class
            assert sorted(str(r.doc_id) for r in rows if r.text and r.text.startswith("word0")) == ["3"] and len(rows) == len(ODD) - 3
        else:
            assert len(rows) == len(ODD), name
            assert Counter(r.text for r in rows) == Counter(t for _, t, *_ in ODD), name
    tokens, tokenizer = Counter(), Tokenizer.from_file(packing.vocabulary())
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        tokens[r.doc_id] += r.length
    want = Counter()
    for i, t, *_ in ODD:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert tokens == want


def test_stages_with_empty_tables(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_repeated_lines_of_odd_rows_go(spark):
    """Ten rows, some repeated and some without ids, have one line; an eleventh has another."""
    rows = [(None if k < 3 else 4 if k < 6 else k, f"common line\nown {k}" if k != 4 else "Common LINE \nown 3", "z") for k in range(10)] + [(99, "other", "z")]
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string, keep string"), SF)
    assert sorted(r.text for r in out.collect()) == sorted([f"own {k}" if k != 4 else "own 3" for k in range(10)] + ["other"])


def test_decontamination_holds_the_words_of_one_text(spark, monkeypatch):
    """Those of a whole batch are several times its bytes, in each worker of an executor."""
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(400)) for i in range(2000)]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append(f) or self)
    decontaminate.clean(docs, spark.createDataFrame([("x", " ".join(texts[3].split()[:13]))], "item_id string, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    kept = [out.num_rows for out in tasks[0]([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(kept) == len(texts), "13 words are no twentieth of 400"
    assert peak < batch.nbytes


def test_idle_workers_hold_no_free_memory(spark, tmp_path):
    """Workers stay for later stages; what they have freed goes back to the system when a task ends."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda j: F.concat(F.lit("w"), ((F.col("id") * j) % 7919).cast("string"))), " ")
    spark.range(16_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source")).repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def spare(batches):
        for batch in batches:
            gc.collect()
            held = []
            for _ in range(2):
                held.append(sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))))
                common.give_back()
            yield pa.RecordBatch.from_arrays([pa.array([held[0] - held[1]], pa.int64())], names=["kb"])

    for made in (near_dedup.signed(docs), decontaminate.clean(docs, spark.createDataFrame([("x", "a b c")], "item_id string, text string")), packing.tokenized(docs.withColumnRenamed("source", "queue"), packing.vocabulary())):
        made.write.format("noop").mode("overwrite").save()
        kb = [r.kb for r in spark.range(0, 8, 1, 8).mapInArrow(spare, "kb long").collect()]
        assert max(kb) < 16_000, kb


def test_stages_run_in_small_batches(spark):
    """By bytes, so that long texts do not fill a worker: with Spark's own setting the rows here are one batch of 9 MB."""
    corpus_pipeline.STAGES[1][1](spark, table(spark, SF, "documents"), SF)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    made = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text")).mapInArrow(sizes, "n long").collect()
    assert len(made) > 1 and max(r.n for r in made) < 5 << 20
