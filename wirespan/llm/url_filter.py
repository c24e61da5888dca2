"""URL filter: rules first, then a ratio of two character language models.

Rules name a host and a path; one fits its host and all subdomains where the url's path starts with
the rule's, and the longest fitting rule wins (at equal length, allow before block). Urls that a
rule allows or blocks train two Markov models over bytes. Each blends orders 0 to `order`: an order's
estimate is smoothed towards that of the next shorter context. Counts come from every such url and are
a table with a row for each context and each context with a byte (by 64-bit hashes), which grows with the
urls and is joined, not broadcast. The score is the difference of the log-likelihoods under both models by
length. A tenth of the labelled urls calibrates the threshold by models counted without it: the score that
separates best, but not above 0 nor above one that would reject more than `loss` of the accepted. The
final scores count that tenth too.

Defined cases: a null url, or one without ://, has an empty host and path. A null or empty url has
score 0. Without urls of either kind every url not ruled is allowed. Repeated urls count as often as
they occur. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespan.llm.common import mixed, salted_join, slices, written
from wirespan.llm.line_dedup import LOWER, UPPER

ORDER, LOSS, SMOOTH = 5, 0.02, 4.0
#: Bytes of urls that are counted or scored together.
SLICE = 1 << 18


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule and ruling (allow or block), the latter two null where no rule fits. rules: (verdict, rule)."""
    out = pages.withColumns({"host": host(url), "path": path(url)})
    fits, ruling = [F.lit(None).cast("string")], [F.lit(None).cast("string")]
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))
    for verdict, rule in reversed(ordered):
        name, slash, rest = rule.partition("/")
        on = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        fits.append(F.when(on, F.lit(rule)).otherwise(fits[-1]))
        ruling.append(F.when(on, F.lit(verdict)).otherwise(ruling[-1]))
    return out.withColumns({"rule": fits[-1], "ruling": ruling[-1]})


def _keys(urls: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte of the urls: its url's row, and for each order 64-bit keys of its context and of the context with it."""
    raw = [b"\0" * order + (u or "").encode("utf-8", "surrogatepass") for u in urls.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    row = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.flatnonzero(at >= order)
    context, pairs, alone = np.zeros(len(own), np.uint64), [], []
    for k in range(order + 1):
        if k:
            context = mixed(context * np.uint64(257) + data[own - k] + np.uint64(1))
        tagged = mixed(context + np.uint64(k + 1))
        alone.append(tagged.view(np.int64))
        pairs.append(mixed(tagged + data[own] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3)).view(np.int64))
    return row[own], np.array(alone), np.array(pairs)


def _blended(urls: pa.Array, known: pa.Table, order: int, smooth: float) -> np.ndarray:
    """Scores of urls by the counts (key, n0, n1) that are known of their keys."""
    row, alone, pairs = _keys(urls, order)
    own, first = np.unique(known.column("key").to_numpy().astype(np.int64), return_index=True)
    logs = []
    for name in ("n0", "n1"):
        n = np.append(known.column(name).to_numpy().astype(np.float64)[first], 0.0)

        def of(keys, n=n):
            at = np.searchsorted(own, keys)
            return n[np.where(np.append(own, 0)[at] == keys, at, len(own))]

        p = np.full(row.shape, 1 / 256)
        for k in range(order + 1):
            p = (of(pairs[k]) + smooth * p) / (of(alone[k]) + smooth)
        logs.append(np.log(p))
    total = np.bincount(row, logs[1] - logs[0], len(urls))
    return total / np.maximum(1, np.bincount(row, minlength=len(urls)))


@dataclass
class Models:
    """table: (key, n0, n1), how often rejected (0) and accepted (1) urls have a context, or a context with a byte."""

    table: DataFrame
    threshold: float
    order: int = ORDER
    smooth: float = SMOOTH

    def scores(self, urls: pa.Array) -> np.ndarray:
        """Of a few urls, on the driver."""
        _, alone, pairs = _keys(urls, self.order)
        keys = np.unique(np.concatenate([alone.ravel(), pairs.ravel()])).tolist()
        wanted = self.table.sparkSession.createDataFrame([(k,) for k in keys], "key long")
        return _blended(urls, self.table.join(wanted, "key").toArrow(), self.order, self.smooth)


def _counted(labelled: DataFrame, order: int) -> DataFrame:
    """(key, n0, n1, a0, a1): counts of each key in rejected and accepted urls, and in those of them kept aside."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "url", SLICE):
                row, alone, pairs = _keys(batch.column("url"), order)
                kind = np.array(batch.column("kind").to_pylist(), np.int64)[row]
                for which in np.unique(kind):
                    u, n = np.unique(np.concatenate([alone[:, kind == which].ravel(), pairs[:, kind == which].ravel()]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(np.full(len(u), which), pa.int32()), pa.array(n, pa.int64())], names=["key", "kind", "n"])

    kinds = labelled.select("url", (F.col("good") + F.when(_aside(), 2).otherwise(0)).cast("int").alias("kind"))
    of = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in range(4)]
    counts = kinds.mapInArrow(run, "key long, kind int, n long").groupBy("key")
    return written(counts.agg((of[0] + of[2]).alias("n0"), (of[1] + of[3]).alias("n1"), of[2].alias("a0"), of[3].alias("a1")))


def _aside() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(10)) == 0


def _scored(pages: DataFrame, table: DataFrame, order: int, smooth: float, name: str) -> DataFrame:
    """pages (with url) and a score. Slices of distinct urls ask the table for their distinct keys."""
    urls = pages.where("url <> ''").select("url").distinct()
    size = urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    dealt = written(urls.withColumn("slice", F.pmod(F.xxhash64("url"), F.lit(max(1, -(-size // SLICE)))).cast("long")))

    def ask(rows: pa.Table) -> pa.Table:
        _, alone, pairs = _keys(rows.column("url"), order)
        keys = np.unique(np.concatenate([alone.ravel(), pairs.ravel()]))
        return pa.table([pa.array(np.full(len(keys), rows.column("slice")[0].as_py()), pa.int64()), pa.array(keys, pa.int64())], names=["slice", "key"])

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        made = _blended(rows.column("url"), known, order, smooth) if len(rows) else np.empty(0)
        return pa.table([rows.column("url"), pa.array(made, pa.float64())], names=["__url", name])

    asked = dealt.groupBy("slice").applyInArrow(ask, "slice long, key long")
    # Short contexts are in every slice: a key that is counted often is dealt by slice into parts.
    known = salted_join(asked, table.withColumn("n", F.col("n0") + F.col("n1")), ["key"], "slice", "inner").select("slice", "key", "n0", "n1")
    made = dealt.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(score, f"__url string, {name} double")
    return pages.join(made, pages["url"] == made["__url"], "left").drop("__url").withColumn(name, F.coalesce(name, F.lit(0.0)))


def learn(labelled: DataFrame, order: int = ORDER, loss: float = LOSS) -> Models:
    """From rows (url, good): good is 1 for accepted, 0 for rejected urls."""
    counts = _counted(labelled, order)
    models = Models(counts.select("key", "n0", "n1"), 0.0, order)
    without = counts.select("key", (F.col("n0") - F.col("a0")).alias("n0"), (F.col("n1") - F.col("a1")).alias("n1"))
    if not all(without.agg(F.max("n0"), F.max("n1")).first()):
        models.threshold = -np.inf
        return models
    cells = _scored(labelled.where(_aside()).select("url", "good"), without, order, models.smooth, "score")
    cells = cells.groupBy("good", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")), 2).alias("s")).count().collect()
    good = sorted((r["s"], r["count"]) for r in cells if r["good"] == 1)
    bad = sorted((r["s"], r["count"]) for r in cells if r["good"] == 0)
    n_good, n_bad = sum(n for _, n in good), sum(n for _, n in bad)
    best, best_gain = -np.inf, -np.inf
    for t in sorted({s for s, _ in good + bad}):
        lost = sum(n for s, n in good if s < t) / max(1, n_good)
        if lost > loss:
            break
        gain = sum(n for s, n in bad if s < t) / max(1, n_bad) - lost
        if gain >= best_gain + 1e-12:
            best, best_gain = t, gain
    models.threshold = min(0.0, float(best))
    return models


def judge(pages: DataFrame, rules: list[tuple[str, str]], **params) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every page."""
    ruled = with_rules(pages.select("page_id", "url"), rules)
    labelled = ruled.where(F.col("ruling").isNotNull() & F.col("url").isNotNull()).select("url", (F.col("ruling") == "allow").cast("int").alias("good"))
    models = learn(labelled, **params)
    out = _scored(ruled, models.table, models.order, models.smooth, "score")
    method = F.when(F.col("score") >= float(models.threshold), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "score")
