"""What the statistics, BM25 scores and phrases of a query set need, from one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.scoring import Bm25, idf
from quillspan.operators import ranking
from quillspan.operators.index import Slice, over_slices, repeated
from quillspan.operators.matching import Phrases


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values of ascending rows as a list for each of n rows."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


@dataclass
class Survey:
    """Of docs (doc_id, body), kept until `release`: a row per document with its number of kept words, the wanted
    terms that it has (numbers in `terms`, ascending) and how often each, and a number in `phrases` for each place
    of a phrase. Rows that share a doc_id or have none (`shared`) have their places of wanted terms instead of those
    of phrases, as one phrase may be spread over several of them."""

    rows: DataFrame
    terms: list[str]
    phrases: Phrases

    @classmethod
    def make(cls, docs: DataFrame, terms: Iterable[str], asked: dict[int, list[str]]) -> Survey:
        """asked: phrases of three words by query_id, see `matching.find_phrases`."""
        phrases = Phrases(asked)
        own = sorted({*terms, *phrases.number})
        number, m = {t: i for i, t in enumerate(own)}, max(len(own), 1)

        def run(slices: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
            for s in slices:
                n, shared = len(s.ids), s.ids.field("shared").to_numpy(zero_copy_only=False).astype(bool)
                term = np.array([number.get(t, -1) for t in s.terms], int)[s.term]
                on = term >= 0
                row, pos, term = s.row[on], s.pos[on], term[on]
                key, tf = np.unique(row * m + term, return_counts=True)
                at, phrase = phrases(s)
                whole, apart = ~shared[at], shared[row]
                columns = [_lists(key // m, key % m, n), _lists(key // m, tf, n), _lists(at[whole], phrase[whole], n), _lists(row[apart], term[apart], n), _lists(row[apart], pos[apart], n)]
                yield pa.RecordBatch.from_arrays([s.ids, pa.array(s.n_kept, pa.int32()), *columns], ["id", "n_kept", "terms", "tfs", "phrases", "words", "pos"])

        twice = F.broadcast(repeated(docs).withColumn("shared", F.lit(True)))
        marked = docs.join(twice, F.col("doc_id").eqNullSafe(F.col("_twice")), "left")
        ids = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("shared", F.lit(False)).alias("shared"))
        lists = ", ".join(f"{c} array<int>" for c in ("terms", "tfs", "phrases", "words", "pos"))
        rows = over_slices(marked.select(ids.alias("doc_id"), "body"), run, f"id struct<doc_id: bigint, shared: boolean>, n_kept int, {lists}", wanted=number)
        return cls(rows.select("id.*", "n_kept", "terms", "tfs", "phrases", "words", "pos").persist(StorageLevel.MEMORY_AND_DISK), own, phrases)

    def release(self) -> None:
        self.rows.unpersist()

    @property
    def once(self) -> DataFrame:
        return self.rows.where("not shared")

    @property
    def shared(self) -> DataFrame:
        return self.rows.where("shared")

    def scores(self, asked: list[tuple[int, str]], limit: int, p: Bm25) -> DataFrame:
        """(query_id, doc_id, score) by the body alone of asked (query_id, term): all rows that can be among a query's
        first `limit`, see `ranking.best_bm25`."""
        spark, kept = self.rows.sparkSession, F.when(F.col("n_kept") > 0, F.col("n_kept"))
        n, average, n_shared = self.rows.agg(F.count(kept), F.coalesce(F.avg(kept), F.lit(0.0)), F.count_if("shared")).first()
        df = self.once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        posts = self.shared.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term"), "doc_id").agg(F.sum("x.tfs").cast("int").alias("tf"))
        if n_shared:
            df = df.unionByName(posts.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        known = {r.term: r.idf for r in df.select("term", idf(F.lit(n), F.col("df"), p.clamp_idf).alias("idf")).collect()}
        number = {t: i for i, t in enumerate(self.terms)}
        weights = [(q, number[t], known[number[t]]) for q, t in asked if q is not None and number.get(t) in known]
        found = self._best(weights, average, limit, p)
        if n_shared:
            every = spark.createDataFrame([(*w, 1) for w in weights], "query_id bigint, term int, idf double, weight int")
            matched = posts.select("term", "doc_id").join(F.broadcast(every.select("query_id", "term")), "term").select("query_id", "doc_id").distinct()
            lengths = self.shared.select("doc_id", F.lit(0).alias("title_len"), F.col("n_kept").alias("body_len"))
            stats = spark.createDataFrame([(n, 0.0, average)], "num_docs bigint, avg_title_len double, avg_body_len double")
            found = found.unionByName(ranking.score_bm25(matched, posts, every, lengths, stats, None, p))
        return found

    def _best(self, weights: list[tuple[int, int, float]], average: float, limit: int, p: Bm25) -> DataFrame:
        n_terms = len(self.terms)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = ranking.Best(weights, range(n_terms), average, limit, p)
            for b in it:
                terms, tfs = b.column("terms"), b.column("tfs")
                row = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy())
                best.add(b.column("doc_id").to_numpy(), b.column("n_kept").to_numpy(), row, terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            yield best.batch()

        return self.once.select("doc_id", "n_kept", "terms", "tfs").mapInArrow(run, ranking.SCORES)

    def found(self, asked: DataFrame) -> DataFrame:
        """(query_id, doc_id) of documents with a phrase; asked (query_id, off, term), three each: the phrases of rows
        that share a doc_id."""
        spark = self.rows.sparkSession
        names = spark.createDataFrame(self.phrases.named(), "phrase int, query_id bigint")
        once = self.once.select("doc_id", F.explode("phrases").alias("phrase")).join(F.broadcast(names), "phrase").select("query_id", "doc_id")
        coded = asked.join(F.broadcast(spark.createDataFrame(list(enumerate(self.terms)), "word int, term string")), "term").select("query_id", "off", "word")
        places = self.shared.select("doc_id", F.explode(F.arrays_zip("words", "pos")).alias("x")).select("doc_id", "x.*").join(F.broadcast(coded), F.col("words") == F.col("word"))
        starts = places.groupBy("query_id", "doc_id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n")).where("n = 3")
        return once.unionByName(starts.select("query_id", "doc_id"))
