"""Boolean and positional matching over postings (doc_id, tf, positions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.index import Slice, over_slices


def posting_list(posts: DataFrame, term: str) -> DataFrame:
    """One term's (doc_id, tf, positions)."""
    return posts.where(F.col("term") == term).drop("term")


def restrict(posts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Postings of the documents in `allowed` (doc_id)."""
    return posts.join(allowed.select("doc_id"), "doc_id", "left_semi")


def find_docs(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """(doc_id, tf) of `a op b`: frequencies add up for AND and OR, NOT keeps those of a."""
    if op == "AND":
        return a.select("doc_id", "tf").join(b.select("doc_id", F.col("tf").alias("tf_b")), "doc_id").select("doc_id", (F.col("tf") + F.col("tf_b")).alias("tf"))
    if op == "OR":
        return a.select("doc_id", "tf").unionByName(b.select("doc_id", "tf")).groupBy("doc_id").agg(F.sum("tf").cast("int").alias("tf"))
    if op == "NOT":
        return a.select("doc_id", "tf").join(b.select("doc_id"), "doc_id", "left_anti")
    raise ValueError(f"unknown operator: {op}")


def positional_intersect(a: DataFrame, b: DataFrame, distance: int = 1) -> DataFrame:
    """(doc_id, tf, positions): positions of a that b follows at `distance`. One equi-join, no position product."""
    left = a.select("doc_id", F.explode("positions").alias("pos"))
    right = b.select("doc_id", F.explode(F.transform("positions", lambda p: p - F.lit(distance))).alias("pos"))
    both = left.join(right, ["doc_id", "pos"], "left_semi")
    return both.groupBy("doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def phrase(posts: DataFrame, terms: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, tf, positions of the first term) where `terms` stand one behind the other.

    One aggregation over (doc_id, position less offset), whatever the phrase's length. A term without postings
    means no match, and no terms none."""
    spark = posts.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id bigint, tf int, positions array<int>")
    offsets = spark.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), "term string, off int")
    rows = posts.where(F.col("term").isin(list(dict.fromkeys(terms))))
    rows = rows if allowed is None else restrict(rows, allowed)
    places = rows.join(F.broadcast(offsets), "term").select("doc_id", "off", F.explode("positions").alias("pos"))
    starts = places.groupBy("doc_id", (F.col("pos") - F.col("off")).alias("pos")).agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
    return starts.groupBy("doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


class Phrases:
    """Phrases of three words each, for queries of asked (query_id: words), and where they stand in a slice."""

    def __init__(self, asked: dict[int, list[str]]):
        of: dict[tuple[str, ...], list[int]] = {}
        for q, own in asked.items():
            of.setdefault(tuple(own), []).append(q)
        self.number = {t: i for i, t in enumerate(sorted({t for own in of for t in own}))}
        self.base = m = len(self.number) + 1
        queries = {(self.number[a] * m + self.number[b]) * m + self.number[c]: q for (a, b, c), q in of.items()}
        self.keys = np.array(sorted(queries), np.int64)
        self.queries = [queries[k] for k in self.keys.tolist()]

    def named(self) -> list[tuple[int, int]]:
        """(number of a phrase, query_id)."""
        return [(i, q) for i, own in enumerate(self.queries) for q in own]

    def __call__(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of the phrase) of each place, by row."""
        if not len(self.keys) or len(s.term) < 3:
            return np.empty(0, int), np.empty(0, int)
        own = np.array([self.number.get(t, -1) for t in s.terms], np.int64)[s.term]
        a, b, c = own[:-2], own[1:-1], own[2:]
        next_ = (s.row[2:] == s.row[:-2]) & (s.pos[2:] - s.pos[:-2] == 2)
        at = np.flatnonzero(next_ & (a >= 0) & (b >= 0) & (c >= 0))
        key = (a[at] * self.base + b[at]) * self.base + c[at]
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[near] == key
        return s.row[at[hit]], near[hit]


def find_phrases(docs: DataFrame, asked: dict[int, list[str]]) -> DataFrame:
    """(query_id, doc_id, tf) of documents where the words of asked (query_id: words, three each) stand one behind
    the other, for all queries in one pass over docs (doc_id, body). doc_ids: unique, see `by_repetition`."""
    phrases = Phrases(asked)

    def run(slices: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
        for s in slices:
            at, number = phrases(s)
            pair, tf = np.unique(number * len(s.ids) + at, return_counts=True)
            found = [(q, r, n) for k, r, n in zip((pair // len(s.ids)).tolist(), (pair % len(s.ids)).tolist(), tf.tolist(), strict=True) for q in phrases.queries[k]]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in found], pa.int64()), s.ids.take(pa.array([r for _, r, _ in found], pa.int64())), pa.array([n for _, _, n in found], pa.int64())], ["query_id", "doc_id", "tf"])

    return over_slices(docs, run, f"query_id bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tf bigint", wanted=phrases.number)
