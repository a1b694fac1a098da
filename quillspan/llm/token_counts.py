"""Exact length histogram of encoded documents (operator 3).

Documents are encoded once and aggregated by length at the map side, so what moves is one row per distinct
length and task. Suffix sums over the histogram then answer, for every context limit, how many documents
fit, how many tokens a cut at that limit keeps, and which length any quantile falls on. Between two
distinct lengths the truncated total is linear in the limit, so a row per distinct length is the whole
answer (`truncated_total`, `quantile`).

The suffix sums run per block of `BLOCK` consecutive lengths in parallel; only the blocks' own totals
(longest document / BLOCK rows) are summed in one place.

Defined results: null or empty text has length 0 plus the end id, if one is counted; rows count as often as
they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import cut, mapped, texts, vocabulary, word_ids

BLOCK = 128


def lengths(docs: DataFrame, path: str | None = None, extra: int = 1) -> DataFrame:
    """(length, docs): a row per distinct encoded length and task. `extra`: ids added to each document."""
    path = path or vocabulary()

    def run(it):
        words, count = word_ids(path), {}
        for b in it:
            for t in texts(b.column(0)):
                n = len(words.text(t)) // 4 + extra
                count[n] = count.get(n, 0) + 1
        if count:
            k = np.fromiter(count.keys(), np.int64, len(count))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.fromiter(count.values(), np.int64, len(count)))], ["length", "docs"])

    return docs.select("text").transform(mapped, run, "length long, docs long")


def histogram(docs: DataFrame, path: str | None = None, extra: int = 1) -> DataFrame:
    """A row per distinct length L: docs of length L, docs of at least L, all tokens in documents up to L,
    and the tokens that a context limit of L keeps: sum(min(length, L))."""
    h = lengths(docs, path, extra).groupBy("length").agg(F.sum("docs").alias("n_docs"))
    return suffix_sums(cut(h))  # read twice


def suffix_sums(h: DataFrame) -> DataFrame:
    h = h.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    up, down = Window.orderBy("block"), Window.orderBy(F.desc("block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "block",
        F.coalesce(F.sum("b_docs").over(before(down)), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(before(up)), F.lit(0)).alias("tokens_below"),
    )
    up, down = Window.partitionBy("block").orderBy("length"), Window.partitionBy("block").orderBy(F.desc("length"))
    out = h.join(per, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.col("docs_above")).alias("n_docs_at_least"),
        (F.sum("tokens").over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("tokens_below")).alias("tokens_up_to"),
    )
    return out.withColumn("truncated_total", F.col("tokens_up_to") + F.col("length") * (F.col("n_docs_at_least") - F.col("n_docs")))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept if each document is cut at `limit`."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length with at least a share q of the documents at or below it."""
    total = hist.agg(F.max("n_docs_at_least")).first()[0] or 0
    return hist.where(total - F.col("n_docs_at_least") + F.col("n_docs") >= q * total).agg(F.min("length").alias("length"))
