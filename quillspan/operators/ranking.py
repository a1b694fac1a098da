"""Candidates, fielded BM25, rank fusion and top-k, for many queries at once (column query_id)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.scoring import Bm25, bm25, field_norm, rrf
from quillspan.functions.text import title_terms
from quillspan.operators.index import Slice, over_slices


def ranked(df: DataFrame, limit: int, *order, by: str = "query_id") -> DataFrame:
    """The first `limit` rows of each query, with `rank` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def candidates(posts: DataFrame, terms: DataFrame, per_term: int = 10_000, total: int = 10_000) -> DataFrame:
    """(query_id, doc_id): of each candidate term the first `per_term` documents by id, terms in the order of
    term_rank, until `total`. terms: (query_id, term, term_rank), a few rows per query."""
    own = posts.select("term", "doc_id").join(F.broadcast(terms), "term")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "term").orderBy("doc_id"))).where(F.col("n") <= per_term)
    first = own.groupBy("query_id", "doc_id").agg(F.min("term_rank").alias("term_rank"))
    return ranked(first, total, "term_rank", "doc_id").select("query_id", "doc_id")


def title_counts(docs: DataFrame, terms: DataFrame, analyzer: str = "raw") -> DataFrame:
    """(query_id, doc_id, term, title_tf) of terms (query_id, term) in titles of docs (query_id, doc_id, title)."""
    found = docs.select("query_id", "doc_id", F.explode(title_terms(F.col("title"), analyzer)).alias("term"))
    return found.join(F.broadcast(terms.select("query_id", "term")), ["query_id", "term"]).groupBy("query_id", "doc_id", "term").agg(F.count("*").alias("title_tf"))


def score_bm25(matched: DataFrame, posts: DataFrame, terms: DataFrame, lengths: DataFrame, stats: DataFrame, titles: DataFrame | None, p: Bm25 = Bm25(), analyzer: str = "raw") -> DataFrame:
    """(query_id, doc_id, score) of matched (query_id, doc_id); documents without a scoring term get 0.

    terms: (query_id, term, idf, weight) with weight the times that a term counts; titles: (doc_id, title) or None."""
    own = posts.select("term", "doc_id", "tf").join(F.broadcast(terms), "term").join(matched, ["query_id", "doc_id"])
    own = own.join(lengths, "doc_id", "left").crossJoin(F.broadcast(stats.select("avg_title_len", "avg_body_len")))  # one row
    if titles is not None and p.title_boost:
        named = matched.join(titles, "doc_id")
        own = own.join(title_counts(named, terms, analyzer), ["query_id", "doc_id", "term"], "left")
    else:
        own = own.withColumn("title_tf", F.lit(0))
    length = lambda c: F.coalesce(F.col(c), F.lit(0))
    weight = p.title_boost * field_norm(F.coalesce(F.col("title_tf"), F.lit(0)), length("title_len"), F.col("avg_title_len"), p.b_title)
    weight = weight + p.body_boost * field_norm(F.col("tf"), length("body_len"), F.col("avg_body_len"), p.b_body)
    shares = own.select("query_id", "doc_id", (bm25(weight, F.col("idf"), p.k1) * F.col("weight")).alias("share"))
    zero = matched.select("query_id", "doc_id", F.lit(0.0).alias("share"))
    return shares.unionByName(zero).groupBy("query_id", "doc_id").agg(F.sum("share").alias("score"))


def best_bm25(docs: DataFrame, weights: list[tuple[int, str, float]], average: float, limit: int, p: Bm25 = Bm25(title_boost=0.0), digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): what `score_bm25` gives by the body alone for documents with a term of weights
    (query_id, term, idf), each weighing 1, less rows that can't be among a query's first `limit` by score rounded to
    `digits` and doc_id. Documents are scored where they are read: a task keeps the best of each query alone.

    doc_ids: unique and not null, see `by_repetition`."""
    terms = {t for _, t, _ in weights}

    def run(slices: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
        best = None
        for s in slices:
            if best is None or best.terms != s.terms:
                best = Best(weights, s.terms, average, limit, p, digits, best and best.held)
            on = best.n[s.term] > 0
            key, tf = np.unique(s.row[on] * len(s.terms) + s.term[on], return_counts=True)
            best.add(s.ids.to_numpy(zero_copy_only=False), s.n_kept, *np.divmod(key, len(s.terms)), tf)
        yield (best or Best(weights, [], average, limit, p, digits)).batch()

    return over_slices(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), run, SCORES, wanted=terms)


SCORES = "query_id bigint, doc_id bigint, score double"
#: Rows that `Best` takes up at once.
ROWS = 512


class Best:
    """The best rows of each query among those added, by weights (query_id, term, idf); terms: by number."""

    def __init__(self, weights: list[tuple], terms: Iterable, average: float, limit: int, p: Bm25, digits: int = 6, held: tuple | None = None):
        self.asked = sorted({q for q, _, _ in weights})
        number = {q: i for i, q in enumerate(self.asked)}
        of: dict = {}
        for q, t, w in sorted(weights):
            of.setdefault(t, []).append((number[q], w))
        self.terms, self.average, self.limit, self.p, self.slack = terms, average if average > 0 else 1.0, limit, p, 1.5 * 10.0**-digits
        own = [of.get(t, ()) for t in terms]
        #: queries of a term, by number, and where they begin
        self.n = np.array([len(q) for q in own], int)
        self.begin = np.cumsum(self.n) - self.n
        self.query, self.idf = np.array([q for qs in own for q, _ in qs], int), np.array([w for qs in own for _, w in qs], float)
        self.held = held or (np.empty(0, int), np.empty(0), np.empty(0, np.int64))
        self.floor = np.full(len(self.asked), -np.inf)

    def add(self, ids: np.ndarray, n_kept: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with their number of kept words, and of each pair of row (ascending) and term how often it occurs."""
        if len(ids) > ROWS:
            for k in range(0, len(ids), ROWS):
                lo, hi = np.searchsorted(row, [k, k + ROWS])
                self.add(ids[k : k + ROWS], n_kept[k : k + ROWS], row[lo:hi] - k, term[lo:hi], tf[lo:hi])
            return
        p, each = self.p, self.n[term]
        if not each.sum():
            return
        denom = (1.0 - p.b_body) + p.b_body * np.maximum(n_kept[row], 1) / self.average
        weight = p.body_boost * (tf / denom if p.b_body < 1 or denom.min() > 0 else tf)
        at = np.repeat(self.begin[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
        w = np.repeat(weight, each)
        share = self.idf[at] * w * (p.k1 + 1) / (w + p.k1)
        size = len(self.asked)
        pair = np.repeat(row, each) * size + self.query[at]
        seen = np.flatnonzero(np.bincount(pair, minlength=len(ids) * size))
        score = np.bincount(pair, share, len(ids) * size)[seen]
        row, q = np.divmod(seen, size)
        on = score >= self.floor[q]
        new = q[on], score[on], ids[row[on]]
        self.held = _first(*(np.concatenate(c) for c in zip(self.held, new, strict=True)), self.limit, self.slack)
        first = np.searchsorted(self.held[0], np.arange(size + 1))
        full = np.flatnonzero(np.diff(first) >= self.limit)
        self.floor[full] = self.held[1][first[full] + self.limit - 1] - self.slack

    def batch(self) -> pa.RecordBatch:
        q, score, ids = self.held
        return pa.RecordBatch.from_arrays([pa.array(np.array([*self.asked, 0])[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "doc_id", "score"])


def _first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, limit: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows but those that have `limit` rows of their query ahead: by more than `slack`, or by id at the same score."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    new = np.append(True, np.diff(q) != 0)[: len(q)]
    tie = new | np.append(True, np.diff(score) != 0)[: len(q)]
    count = np.arange(len(q))
    start = np.maximum.accumulate(np.where(new, count, 0))
    last = np.minimum(start + limit, np.append(np.flatnonzero(new)[1:], len(q))[np.cumsum(new) - 1]) - 1
    full = count - start >= limit
    kept = (~full | (score >= score[last] - slack)) & (count - np.maximum.accumulate(np.where(tie, count, 0)) < limit)
    return q[kept], score[kept], ids[kept]


def fuse(lists: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank) by reciprocal rank fusion of lists (query_id, source, doc_id, rank). Ties:
    best rank in the source "semantic" first, then the smaller doc_id."""
    semantic = F.min(F.when(F.col("source") == "semantic", F.col("rank"))).alias("semantic_rank")
    rows = lists.groupBy("query_id", "doc_id").agg(F.sum(rrf(F.col("rank"), k)).alias("score"), semantic)
    return ranked(rows, limit, F.desc("score"), F.asc_nulls_last("semantic_rank"), "doc_id").drop("semantic_rank")
