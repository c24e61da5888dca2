"""The queries op1 to op13 over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm import decontaminate, fim, language, licenses, line_dedup, near_dedup, packing, quality, search, substring_dedup, token_files, toxicity, url_filter
from wirespan.llm.common import table


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), min_docs=10, keep="none", min_chars=1)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs.where(fold_of(5) != 0).select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold_of(5) == 0).alias("held_out"), "lang_pred", "score", "trusted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def fold_of(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(fold_of(4) != 2))
    return toxicity.score(docs, lexicon).select("doc_id", (fold_of(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), temperature=packing.TEMPERATURE)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), token_files.vocabulary("byte_bpe_50k.json"), end_id=0)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {"op11_fim": op11_fim, "op12_token_files": op12_token_files, "op13_search": op13_search, "op6_near_dedup": op6_near_dedup, "op4_substring_dedup": op4_substring_dedup, "op8_licenses": op8_licenses, "op9_language": op9_language, "op1_url_filter": op1_url_filter, "op2_quality": op2_quality, "op3_toxicity": op3_toxicity, "op5_packing": op5_packing, "op7_line_dedup": op7_line_dedup, "op10_decontaminate": op10_decontaminate}

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + 12], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
hits AS (SELECT doc_id, k, x.n, item_id FROM (
           SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)) x JOIN bw ON x.n = bw.n AND x.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    ends = "chr(13) || chr(133) || chr(8232) || chr(8233)"
    made = f"translate(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {ends}, repeat(chr(10), 4))"
    for pattern, by in ((licenses.OWNER, ""), (licenses.MARKER, r"\1"), (licenses.GAP, " ")):
        made = f"regexp_replace({made}, {_quoted(pattern)}, '{by}', 'g')"
    equal = ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items())
    made = f"array_to_string(list_transform(list_filter(string_split({made}, ' '), lambda w: w <> ''), lambda w: coalesce(MAP {{{equal}}}[w], w)), ' ')"
    for pattern, by in licenses.FILLED:
        made = f"regexp_replace({made}, {_quoted(pattern)}, '{by}', 'g')"
    return made


OP8_SQL = f"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}),
digests AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_canonical_sql("text")}) AS digest, license FROM known UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{n}')" for n, d in licenses.DIGESTS)}) z(digest, license)) GROUP BY 1)
SELECT doc_id, d.digest, license FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN digests k ON d.digest = k.digest
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')) AS unit, generate_subscripts(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), 1) AS k FROM d),
c AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
x AS (SELECT d.doc_id, t, coalesce(n, 0) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (coalesce(n, 0) + 1) AS p, ('0x' || substr(h, 9, 8))::BIGINT % (coalesce(n, 0) + 1) AS q,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4 FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
y AS (SELECT doc_id, t, n, least(p, q) AS a, greatest(p, q) AS b, CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR r3 >= 50 THEN 'plain' WHEN r4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT y.doc_id, any_value(t) AS t, any_value(n) AS n, any_value(form) AS form, coalesce(string_agg(unit, '' ORDER BY k) FILTER (WHERE k <= a), '') AS pre,
             coalesce(string_agg(unit, '' ORDER BY k) FILTER (WHERE k > a AND k <= b), '') AS mid, coalesce(string_agg(unit, '' ORDER BY k) FILTER (WHERE k > b), '') AS suf
      FROM y LEFT JOIN u ON u.doc_id = y.doc_id GROUP BY y.doc_id)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256
FROM z
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
stats AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM sizes),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stats GROUP BY term),
s AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // l))))) AS BIGINT) AS score
      FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN sizes ON sizes.doc_id = tf.doc_id, stats GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10
"""

SQL = {"op11_fim": OP11_SQL, "op13_search": OP13_SQL, "op4_substring_dedup": OP4_SQL, "op8_licenses": OP8_SQL, "op7_line_dedup": OP7_SQL, "op10_decontaminate": OP10_SQL}
