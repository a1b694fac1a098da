"""Isolation forest over rule statistics (operator 9).

One pass computes the statistics of every whole text. The forest's trees are grown on `trees` x `sample`
rows, those with the smallest hash of (doc_id, statistics): the subsampling that the method itself consists of,
a fixed number of rows for any corpus. Every row gets its mean path length, thus an anomaly score in 0..1.
The threshold comes from labelled rows, all of them: of the score's histogram by label, the cut with the
best balanced accuracy among those that keep at least `keep_good` of the good rows. Without labels of both
kinds nothing is rejected by the forest.

Defined results: null or empty text has no words and fails the base rules; a null doc_id is a row like any
other, without a label; repeated rows are judged alike; of a doc_id's several labels the smallest counts;
an empty table gives no rows. Input columns are carried along by `judge`, but those it adds are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import cut, mapped, texts

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 1000


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that the text has twice or more."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = h[:m].copy()
    for k in range(1, n):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        g += h[k : k + m]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.isin(g, twice)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(at), 1)
    np.add.at(cover, np.flatnonzero(at) + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(t: bytes) -> tuple[int, int, int, int]:
    """(words, symbols, repeated lines, repeated words) of a text."""
    words = t.split()
    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
    return len(words), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` without `text`, with a column per statistic."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", *STATS)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keep] + [T.StructField(n, T.LongType()) for n in STATS])
    names = [f.name for f in schema.fields]

    def run(it):
        for b in it:
            column = b.column(b.schema.names.index("text"))
            own = texts(column)
            points = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            rows = np.array([text_stats(t) for t in own], np.int64).reshape(-1, 4)
            space = np.fromiter((sum(map(t.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))) for t in own), np.int64, len(own))
            cols = {n: b.column(b.schema.names.index(n)) for n in names if n in b.schema.names and n not in STATS}
            cols |= {"n_words": rows[:, 0], "word_chars": points - space, "n_symbols": rows[:, 1], "n_dup_lines": rows[:, 2], "n_repeat_words": rows[:, 3]}
            yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[n], pa.Array) else pa.array(x, pa.int64()) for n in names], names)

    return docs.select(*[f.name for f in keep], "text").transform(mapped, run, schema)


def features(stats: np.ndarray) -> np.ndarray:
    """Of rows in the order of STATS: length, word length, and symbols and repetition per word."""
    n = np.maximum(stats[:, 0], 1).astype(float)
    return np.column_stack([np.log1p(stats[:, 0]), stats[:, 1] / n, stats[:, 2] / n, stats[:, 3] / n * 10, stats[:, 4] / n])


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: feature (-1: leaf), split value, left child (right is next), depth plus leaf norm."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        order = rng.permutation(len(rows))
        self.trees = [self._grow(rows[np.take(order, range(k * sample, (k + 1) * sample), mode="wrap")[: self.sample]], rng) for k in range(trees if len(rows) > 1 else 0)]

    def _grow(self, rows: np.ndarray, rng) -> tuple:
        limit = math.ceil(math.log2(max(len(rows), 2)))
        f, v, child, out = [], [], [], []

        def add(own: np.ndarray, depth: int, k: int) -> None:
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            if depth >= limit or not len(wide):
                out[k] = depth + float(path_norm(len(own)))
                return
            f[k] = int(rng.choice(wide))
            lo, hi = own[:, f[k]].min(), own[:, f[k]].max()
            v[k] = float(rng.uniform(lo, hi))
            left = own[:, f[k]] <= v[k]
            child[k] = len(f)
            for x in (f, v, child, out):
                x.extend([-1 if x is f else 0] * 2)
            add(own[left], depth + 1, child[k])
            add(own[~left], depth + 1, child[k] + 1)

        for x in (f, v, child, out):
            x.append(-1 if x is f else 0)
        add(rows, 0, 0)
        return np.array(f), np.array(v, float), np.array(child), np.array(out, float), limit

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ^ -(mean path / norm): near 1 for rows that few splits isolate."""
        if not self.trees:
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for f, v, child, out, limit in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(limit):
                feature = f[node]
                node = np.where(feature < 0, node, child[node] + (rows[at, feature] > v[node]))
            total += out[node]
        return np.exp2(-total / len(self.trees) / max(float(path_norm(self.sample)), 1e-9))


def fit_forest(stats: DataFrame, trees: int = 128, sample: int = 256) -> IsolationForest:
    """Grown on trees x sample rows at most."""
    rows = stats.withColumn("_h", F.xxhash64("doc_id", *STATS)).orderBy("_h", *STATS).limit(trees * sample).select(*STATS).toArrow()
    cols = [rows.column(n).to_numpy() for n in STATS]
    return IsolationForest(features(np.column_stack(cols) if rows.num_rows else np.empty((0, 5))), trees, sample)


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """`stats` with `anomaly`, in steps of 1 / BINS."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    stats = stats.drop("anomaly")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stats.schema.fields] + [T.StructField("anomaly", T.DoubleType())])

    def run(it):
        for b in it:
            rows = np.column_stack([b.column(b.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in STATS])
            a = np.round(held.value.score(features(rows)) * BINS) / BINS
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a)], [*b.schema.names, "anomaly"])

    return stats.transform(mapped, run, schema)


def threshold(rows: DataFrame, labels: DataFrame, keep_good: float = 0.99) -> float:
    """Scores above it are rejected. Reads a histogram of BINS + 1 bins by label."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    h = rows.where("not base_failed").join(own, "doc_id").groupBy("anomaly", "quality").count().collect()
    n = np.zeros((2, BINS + 1))
    for r in h:
        n[int(r.quality > 0), round(r.anomaly * BINS)] += r["count"]
    bad, good = n
    if not bad.sum() or not good.sum():
        return 1.0
    kept_good, kept_bad = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    gain = np.where(kept_good >= keep_good, kept_good - kept_bad, -1)
    best = gain.max()
    if best <= 0:
        return 1.0
    own = np.flatnonzero(gain >= best - 1e-12)
    return float(own[len(own) // 2] / BINS)


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 10, max_repeat: int = 20, keep_good: float = 0.99, trees: int = 128, sample: int = 256) -> DataFrame:
    """`docs` without text, with statistics, base_failed, anomaly and kept."""
    stats = cut(statistics(docs.drop("base_failed", "anomaly", "kept")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = scored(stats.withColumn("base_failed", failed), fit_forest(stats, trees, sample))
    t = threshold(rows, labels, keep_good)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= t))
