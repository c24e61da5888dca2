"""Fill-in-the-middle, token files and ranked search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wirespan.llm import codec, fim, queries, search, token_files

WHITE = r"[\x20\x09-\x0D]"
ODD = [None, "", " ", "\n\n", "\t\x0b\n \r", "x" * 50_000, "é" * 3, "a", "a\0b  c\n\n日本 x  ", "one <P> two", "no <S", "<M>", "a< b<S c<M d<P e", "  lead and trail \n", "<|endoftext|> in text", "͸ \U0001f600 　x\x1c y\x85z", "A-b_C Ωmega ａ１ 1.5", "I'm we'll  can't 'S 's\n\n\n x"]


def frame(spark, rows, schema="doc_id long, text string"):
    """rows with columns whose names operators use inside."""
    extra = "lang string, text_hash string, start int, score int, shard int, form int, n int, ids string, batch int"
    return spark.createDataFrame([(*r, "en", "h", 1, 2, 3, 4, 5, "i", 6) for r in rows], f"{schema}, {extra}").repartition(3)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["été", "日本語", "don't", "X-1", "don"]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t", ", "]) for _ in range(int(rng.expovariate(1 / 40)))) for _ in range(n)]


# --- fill in the middle ------------------------------------------------------------------------
def fim_by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(f"{WHITE}*[^\\x20\\x09-\\x0D]+|{WHITE}+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (100, 50)])
def test_fim(spark, rate, spm):
    rows = list(enumerate(texts(150))) + [(None, "a text without id and more"), (7, "repeated row x y"), (7, "repeated row x y")]
    made = fim.transform(frame(spark, rows), rate=rate, spm_rate=spm)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert got == Counter((i, *fim_by_hand(i, t, rate=rate, spm=spm)) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in fim.restore(made).collect()) == Counter((i, t or "") for i, t in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digest(frame(spark, rows), rate=rate, spm_rate=spm).collect())
    assert digests == Counter((i, sha(fim_by_hand(i, t, rate=rate, spm=spm)[-1]), sha(t or "")) for i, t in rows)


def test_fim_empty(spark):
    assert fim.digest(frame(spark, [])).collect() == []


# --- token files -------------------------------------------------------------------------------
def test_codec():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000, 70_001):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = codec.pack(v)
        assert len(control) == -(-n // 4)
        assert np.array_equal(np.concatenate([*codec.unpack(control, data, n, block=97), np.empty(0, np.uint32)]), v)
        wide = rng.integers(0, 1 << 62, n, dtype=np.int64) >> rng.integers(0, 62, n)
        made, ends = codec.varbytes(wide)
        assert np.array_equal(codec.from_varbytes(made.tobytes()), wide) and (n == 0 or ends[-1] == len(made))
    assert codec.pack(np.array([255, 256, 65_535, 65_536]))[1].tolist() == [255, 0, 1, 255, 255, 0, 0, 1]


def test_parts_are_as_the_tokenizer_cuts_them():
    """Every character that is trusted to the pattern, between letters, blanks, digits and signs."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    own = token_files.tokenizer(token_files.vocabulary())
    for c in token_files._steady():
        s = f"a{c}b {c}{c} {c}1\n{c}!{c}  '{c}\n\n{c}s"
        expected = [s[a:b] for _, (a, b) in level.pre_tokenize_str(s)]
        assert own.any.findall(s) == expected, hex(ord(c))
        if s.isascii():
            assert own.ascii.findall(s) == expected, hex(ord(c))


def ids_by_hand(path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_tokens", [300, 1 << 24])
def test_token_files(spark, tmp_path, file_tokens):
    path = token_files.vocabulary()
    rows = [*enumerate(texts(200)), (None, "no id"), (-5, "before all"), (10_000, None)]
    folder = f"file://{tmp_path}/out"
    got = token_files.digest(frame(spark, rows), path, folder=folder, file_tokens=file_tokens)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=lambda r: r[1]) == ids_by_hand(path, rows)
    for r in token_files.read(spark, folder, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    names = {p.name for p in (tmp_path / "out" / "files").iterdir()}
    assert {r.name for r in manifest} == names and sum(r.n_docs for r in manifest) == len(rows)
    (tmp_path / "out" / "files" / "000000-000000-dead.ids").write_bytes(b"left by a lost attempt")
    assert token_files.read(spark, folder).count() == len(rows)
    ranks = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    from tokenizers import Tokenizer

    counts = Counter(i for _, x in rows for i in [*Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids, 0])
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))


def test_changed_file_is_told(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    token_files.write(frame(spark, [(1, "some text"), (2, "more of it")]), token_files.vocabulary(), folder)
    for p in (tmp_path / "out" / "files").glob("*.ids"):
        raw = bytearray(p.read_bytes())
        raw[-6] ^= 1
        p.write_bytes(raw)
    for p in (tmp_path / "out" / "files").glob(".*.crc"):
        p.unlink()
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, folder).collect()


def test_repeated_and_equal_ids(spark, tmp_path):
    """Rows that share a doc_id keep one order and gapless starts."""
    rows = [(1, "b b"), (1, "a"), (1, "a"), (2, "c")]
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.digest(frame(spark, rows), token_files.vocabulary()).collect())
    assert [r[2] for r in got] == [1, 1, 1, 2] and got[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert token_files.digest(frame(spark, []), token_files.vocabulary()).collect() == []


def test_forgotten_parts_are_encoded_again():
    from tokenizers import Tokenizer

    path = token_files.vocabulary()
    own, whole = token_files.ByteTokenizer(path), Tokenizer.from_file(path)
    own.known.kept = 5
    for t in texts(60) * 2:
        assert np.frombuffer(own(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(spark):
    own = token_files.tokenizer(token_files.vocabulary("word_bpe_49k.json"))
    assert not own.by_parts
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(own("Some Text, 12 words"), "<u4").tolist() == whole.encode("Some Text, 12 words", add_special_tokens=False).ids


# --- search ------------------------------------------------------------------------------------
def ranks_by_hand(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n_all, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(terms(t))
    out = Counter()
    for item, wanted in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 90 + 90 * n * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out.update((item, k + 1, None if not there else i, -s) for k, (s, there, i) in enumerate(sorted(scores)[:k]))
    return out


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_bytes,block_items,salt_shards", [(16 << 20, 256, 256), (2_000, 5, 3), (60, 7, 2)])
def test_search(spark, shard_bytes, block_items, salt_shards):
    rng = random.Random(3)
    base = texts(250, 5)
    rows = [*enumerate(base), (7, base[40]), (7, base[40]), (None, base[41]), (None, base[42]), (-3, base[41])]
    full = [t for t in base if t and t.split()]
    items = [(k, " ".join(rng.choice(rng.choice(full).split()) for _ in range(rng.randrange(1, 30)))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "nothinghasthis"), (103, "w1 W1 w1"), (3, "W2 w3"), (None, "w5 w6 été")]
    made = search.index(frame(spark, rows), shard_bytes=shard_bytes)
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, rank int, shard int").repartition(2)
    got = found(search.search(made, asked, block_items=block_items, salt_shards=salt_shards))
    expected = ranks_by_hand(rows, items)
    # documents of equal score and equal doc_id (or none) may stand for one another; the rows are the same
    assert got == expected


def test_merge_is_exact():
    """The merge with its look-ups and its bound against sums over all documents."""
    rng = random.Random(8)
    for _ in range(300):
        lists, sums = [], Counter()
        for _ in range(rng.randrange(1, 9)):
            docs = sorted(rng.sample(range(60), rng.randrange(1, 50)))
            own = search.Postings.__new__(search.Postings)
            own.docs, own.gains = docs, [rng.choice([1, 2, 2, 5, 100]) for _ in docs]
            own.bound = max(own.gains)
            lists.append(own)
            for d, g in zip(docs, own.gains, strict=True):
                sums[d] += g
        k = rng.randrange(1, 12)
        assert sorted(search.best(lists, k), key=lambda x: (-x[0], x[1])) == sorted(((s, d) for d, s in sums.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_search_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.index(frame(spark, [])), some).collect() == []
    assert search.search(search.index(frame(spark, [(1, "a")])), none).collect() == []
    assert search.search(search.index(frame(spark, [(1, None), (2, "--")])), some).collect() == []


def test_text_item_ids(spark):
    asked = spark.createDataFrame([("q", "b")], "item_id string, text string")
    assert [(r.item_id, r.doc_id) for r in search.search(search.index(frame(spark, [(1, "b c"), (2, "c"), (3, "c d"), (4, "e")])), asked).collect()] == [("q", 1)]


# --- the queries -------------------------------------------------------------------------------
def test_queries_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_fim", "op13_search"):
        got = queries.QUERIES[name](spark, sf)
        expected = con.sql(queries.SQL[name])
        assert set(got.columns) == set(expected.columns)
        assert Counter(map(tuple, got.select(*expected.columns).collect())) == Counter(expected.fetchall()), name


def test_token_query_against_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == ids_by_hand(token_files.vocabulary(), rows)
