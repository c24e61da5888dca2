"""Fill-in-the-middle, by DuckDB inside mapInArrow.

Spark deals the documents; each Arrow batch is registered with the task's own DuckDB connection and one SELECT cuts,
rearranges and digests all its rows, so Python sees batches and never a row. Nothing is shuffled.

A text is cut into units (white space and the run after it; white space at the end is a unit of its own). Two draws from the sha256
of seed and doc_id choose where the prefix and the middle end, a third whether the text is changed at all, a fourth
the order of the parts. So a repeated task, or the same document in another table, gives the same output.

Defined cases: a null text is an empty one, and stays plain, as does a text that holds a marker. A null doc_id draws as
an empty one. Repeated rows are transformed one by one and alike. A prefix, middle or suffix may be empty. Empty tables give empty tables. Other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from wirespan.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

#: From batch(doc_id, text): each document with its form and output.
MADE = """
WITH drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
         CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{unit}') AS units,
               sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM batch)),
cut AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {rate} THEN 'plain'
              WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
         array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM cut),
made AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM parts)
"""
#: The text again, of output and form alone: no part holds a marker.
RESTORED = """CASE form WHEN 'plain' THEN output
 WHEN 'psm' THEN split_part(split_part(output, '{p}', 2), '{s}', 1) || split_part(output, '{m}', 2) || split_part(split_part(output, '{s}', 2), '{m}', 1)
 ELSE split_part(split_part(output, '{p}', 2), '{m}', 1) || split_part(output, '{m}', 2) || split_part(split_part(output, '{s}', 2), '{p}', 1) END"""
MARKERS = {"p": PREFIX, "s": SUFFIX, "m": MIDDLE}


def _queried(df: DataFrame, columns: list[str], sql: str, schema: str) -> DataFrame:
    """sql over each slice of df's batches, which it knows as `batch`."""

    def run(batches):
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for whole in batches:
                for batch in slices(whole, column=columns[-1]):
                    con.register("batch", pa.Table.from_batches([batch]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    return df.select(*columns).mapInArrow(run, schema)


def _made(seed: int, rate: int, spm_rate: int) -> str:
    return MADE.format(unit=UNIT, seed=int(seed), rate=int(rate), spm=int(spm_rate), **MARKERS)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output. rate: how many in a hundred texts are changed; spm_rate: how
    many of those put the suffix first."""
    return _queried(docs, ["doc_id", "text"], _made(seed, rate, spm_rate) + "SELECT * FROM made", "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """doc_id and text, from the form and output of transform()."""
    return _queried(made, ["doc_id", "form", "output"], f"SELECT doc_id, {RESTORED.format(**MARKERS)} AS text FROM batch", "doc_id long, text string")


def digest(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """transform() with sha256 digests of the output and of the text restored from it."""
    sql = _made(seed, rate, spm_rate) + f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED.format(**MARKERS)}) AS restored_sha256 FROM made"
    return _queried(docs, ["doc_id", "text"], sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
