"""Vector search: exact, and by an inverted file with product quantisation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quillspan.operators.ranking import ranked


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def truncate(v: Column, dim: int = 64) -> Column:
    """The first `dim` components, scaled to unit length."""
    return l2_normalize(F.slice(v, 1, dim))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    mean = _sum(F.transform(v, lambda x: x.cast("double"))) / F.size(v)
    variance = _sum(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.size(v)
    return F.transform(v, lambda x: (x - mean) / F.sqrt(variance + eps))


def mean_pool(token_vectors: Column) -> Column:
    """The mean of an array of equally long vectors."""
    total = F.aggregate(F.slice(token_vectors, 2, F.size(token_vectors)), F.transform(token_vectors[0], lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(token_vectors))


def embed(docs: DataFrame, model: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """(doc_id, embedding) of docs (doc_id, text) by any model from texts to rows of vectors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for a in range(0, len(part), batch):
                own = part.iloc[a : a + batch]
                yield pd.DataFrame({"doc_id": own.doc_id, "embedding": list(np.asarray(model(own.text.tolist()), np.float32))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, embedding array<float>")


#: Rows of a tile of vectors and of queries, the queries of one matrix product, and the most queries that meet every
#: vector in place.
TILE_VECTORS, TILE_QUERIES, CHUNK, FEW = 1 << 15, 1 << 13, 128, 8


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, doc_id, score, rank): exact nearest vectors of queries (query_id, vector); score is the inner
    product, or the squared distance. Every query meets every vector: more than a few in tiles of both, each of
    which gives the best k of its queries. Rows with an odd vector (null, of another length, not finite) meet the
    others pair by pair; a pair without a score ranks last."""
    product = metric == "ip"
    own, asked = vectors.select("doc_id", "embedding"), queries.select("query_id", "vector")
    n_asked, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n_asked <= FEW:
        return _best(_pairs(own, asked, product), k, product)
    even = lambda i, v: F.coalesce(F.col(i).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: F.abs(x) < F.lit(1e100)), F.lit(False))
    good, fit = even("doc_id", "embedding"), even("query_id", "vector")
    n, n_odd = own.agg(F.count("*"), F.count_if(~good)).first()
    n_unfit = asked.agg(F.count_if(~fit)).first()[0]
    v, q = max(-(-n // TILE_VECTORS), min(32, n // 1024), 1), -(-n_asked // TILE_QUERIES)

    def run(left, right):
        x, ids = _matrix(left, "embedding"), left.column("doc_id").to_numpy()
        row, at, score = _top(_matrix(right, "vector"), x, ids, k, product)
        return pa.table({"query_id": right.column("query_id").to_numpy()[row], "doc_id": ids[at], "score": score})

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c, df in (("query_id", asked), ("doc_id", own))] + [T.StructField("score", T.DoubleType())])
    found = _tiles(own.where(good), asked.where(fit), v, q).applyInArrow(run, schema)
    if n_odd:
        found = found.unionByName(_pairs(own.where(~good), asked, product))
    if n_unfit:
        found = found.unionByName(_pairs(own.where(good), asked.where(~fit), product))
    return _best(found, k, product)


def _pairs(vectors: DataFrame, queries: DataFrame, product: bool) -> DataFrame:
    score = dot(F.col("embedding"), F.col("vector")) if product else squared_distance(F.col("embedding"), F.col("vector"))
    return vectors.crossJoin(F.broadcast(queries)).select("query_id", "doc_id", score.alias("score"))


def _best(scores: DataFrame, k: int, product: bool) -> DataFrame:
    return ranked(scores, k, F.desc_nulls_last("score") if product else F.asc_nulls_last("score"), "doc_id")


def _tiles(vectors: DataFrame, queries: DataFrame, v: int, q: int) -> PandasCogroupedOps:
    """Both sides dealt out by a hash of their id to v and q groups, and cogrouped by pair of groups."""
    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.withColumn("tv", group("doc_id", v)).withColumn("tq", every(q))
    b = queries.withColumn("tq", group("query_id", q)).withColumn("tv", every(v))
    a, b = (df.repartition(v * q, "tv", "tq").groupBy("tv", "tq") for df in (a, b))
    return a.cogroup(b)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    own = table.column(column).combine_chunks()
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1) if len(own) else np.empty((0, 0))


def _top(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, product: bool = False, barred: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, row of x, score) of the best k for each row of asked; equal scores by id. A matrix product
    picks the rows that can be among them, within its rounding; their scores are then summed one component after the
    other, as SQL does. barred(rows of asked): a mask of rows of x that are left out."""
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    xt = np.ascontiguousarray(x.T)
    size = (xt**2).sum(0)
    for a in range(0, len(asked) if len(x) else 0, CHUNK):
        own = asked[a : a + CHUNK]
        near = own @ xt
        near *= -1 if product else -2
        if not product:
            near += size
        if barred is not None:
            near[barred(slice(a, a + len(own)))] = np.inf
        cut = np.full(len(own), np.finfo(float).max)
        if len(x) > k:
            slack = 1e-12 * (np.sqrt((own**2).sum(1)) + math.sqrt(size.max())) ** 2
            cut = np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1] + slack, cut)
        row, at = np.nonzero(near <= cut[:, None])
        score = np.zeros(len(row))
        for q, c in zip(np.ascontiguousarray(own.T), xt, strict=True):
            score += q[row] * c[at] if product else (c[at] - q[row]) ** 2
        order = np.lexsort((ids[at], -score if product else score, row))
        row, at, score = row[order], at[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[kept] + a, at[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
        for e in np.flatnonzero(count == 0):
            centers[e] = x[rng.integers(len(x))]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    size = (centers**2).sum(1)
    return np.concatenate([np.empty(0, int)] + [(size - 2 * x[a : a + 4096] @ centers.T).argmin(1) for a in range(0, len(x), 4096)])


#: Rows of a tile of codes and of queries.
CODE_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 12


@dataclass
class IvfPq:
    """Coarse centroids and codebooks. Codes are of a vector's difference from its centroid."""

    centroids: np.ndarray  # nlist x dim
    codebooks: np.ndarray  # m x codes x dim / m

    @classmethod
    def train(cls, vectors: DataFrame, nlist: int | None = None, m: int = 8, bits: int = 8, train_per_cell: int = 39, rounds: int = 12, seed: int = 1) -> IvfPq:
        """From at most max(train_per_cell * nlist, 2 ** bits) vectors, those with the smallest hash of their id;
        nlist is the root of the number of vectors by default."""
        nlist = nlist or max(1, int(math.sqrt(vectors.count())))
        sample = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(train_per_cell * nlist, 1 << bits)).select("embedding").toArrow()
        x = np.array(sample.column("embedding").to_pylist(), float)
        rng = np.random.default_rng(seed)
        centroids = _kmeans(x, nlist, rounds, rng)
        rest = x - centroids[_nearest(x, centroids)]
        parts = np.split(rest, m, axis=1)
        books = [_kmeans(p, 1 << bits, rounds, rng) for p in parts]
        return cls(centroids, np.stack(books))

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(doc_id, cell, codes): every vector, a byte per part."""
        held = vectors.sparkSession.sparkContext.broadcast(self)

        def run(it):
            own = held.value
            for part in it:
                x = np.stack(part.embedding.to_numpy()).astype(float) if len(part) else np.empty((0, own.centroids.shape[1]))
                cell = _nearest(x, own.centroids)
                rest = np.split(x - own.centroids[cell], len(own.codebooks), axis=1)
                codes = np.stack([_nearest(p, b) for p, b in zip(rest, own.codebooks, strict=True)], 1).astype(np.uint8)
                yield pd.DataFrame({"doc_id": part.doc_id, "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

        return vectors.select("doc_id", "embedding").mapInPandas(run, "doc_id bigint, cell int, codes binary")

    def save(self, spark: SparkSession, path: str, codes: DataFrame, mode: str = "error") -> None:
        """Checkpoint: codes partitioned by cell, so that a search reads only the cells that it probes."""
        flat = lambda a: [(i, [float(x) for x in np.ravel(r)]) for i, r in enumerate(a)]
        spark.createDataFrame(flat(self.centroids), "i int, v array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/centroids")
        spark.createDataFrame(flat(self.codebooks), "i int, v array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/codebooks")
        codes.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[IvfPq, DataFrame]:
        c, b = ([r.v for r in spark.read.parquet(f"{path}/{t}").orderBy("i").collect()] for t in ("centroids", "codebooks"))
        centroids = np.array(c)
        return cls(centroids, np.array(b).reshape(len(b), -1, centroids.shape[1] // len(b))), spark.read.parquet(f"{path}/codes")

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centroids[cell] + np.concatenate([b[c] for b, c in zip(self.codebooks, codes.T, strict=True)], axis=1)

    def search(self, codes: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, nprobe: int = 5, vectors: DataFrame | None = None, rescore: int = 8) -> DataFrame:
        """(query_id, doc_id, score, rank): nearest by squared distance. Distances come from the codes; with
        `vectors` the best rescore * k are measured again exactly.

        Codes and queries meet in tiles, so neither the queries nor a cell has to fit in one task. A tile gives the
        best rows of each of its queries over all cells that the query probes."""
        spark = codes.sparkSession
        if isinstance(queries, list):
            queries = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id bigint, vector array<double>")
        limit = k * (rescore if vectors is not None else 1)
        n, n_asked = codes.count(), queries.count()
        v, q = max(-(-n // CODE_BLOCK), 1), max(-(-n_asked // QUERY_BLOCK), min(16, n_asked // CHUNK), 1)
        held = spark.sparkContext.broadcast(self)

        def run(left, right):
            own, asked = held.value, _matrix(right, "vector")
            if not (len(left) and len(right)):
                return pa.table({"query_id": np.empty(0, int), "doc_id": np.empty(0, int), "score": np.empty(0)})
            ids, cell = left.column("doc_id").to_numpy(), left.column("cell").to_numpy()
            code = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            x, query_id = own.decode(cell, code), right.column("query_id").to_numpy()
            near = np.argsort((own.centroids**2).sum(1) - 2 * asked @ own.centroids.T, axis=1, kind="stable")[:, :nprobe]

            def barred(rows: slice) -> np.ndarray:
                out = np.ones((len(near[rows]), len(own.centroids)), bool)
                np.put_along_axis(out, near[rows], False, axis=1)
                return out[:, cell]

            row, at, score = _top(asked, x, ids, limit, barred=barred)
            return pa.table({"query_id": query_id[row], "doc_id": ids[at], "score": score})

        near = _tiles(codes.select("doc_id", F.col("cell").cast("int").alias("cell"), "codes"), queries.select("query_id", "vector"), v, q)
        near = ranked(near.applyInArrow(run, "query_id bigint, doc_id bigint, score double"), limit, "score", "doc_id")
        if vectors is None:
            return near
        exact = near.select("query_id", "doc_id").join(vectors, "doc_id").join(queries, "query_id")
        return ranked(exact.select("query_id", "doc_id", squared_distance(F.col("embedding"), F.col("vector")).alias("score")), k, "score", "doc_id")


def write_embeddings(docs: DataFrame, model: Callable[[list[str]], np.ndarray], path: str, batch: int = 32) -> DataFrame:
    """Embeddings of docs (doc_id, text) at `path`, made only if none are there."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        embed(docs, model, batch).write.mode("overwrite").parquet(path)
    return read_embeddings(spark, path)


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(doc_id, embedding); raises ValueError unless both have their types and, if `dim` is given, every vector has that many components."""
    own = spark.read.parquet(path)
    types = dict(own.dtypes)
    if types.get("doc_id") not in ("int", "bigint") or types.get("embedding") not in ("array<float>", "array<double>"):
        raise ValueError(f"no embeddings: {types}")
    if dim is not None:
        odd = own.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).limit(1).count()
        if odd:
            raise ValueError(f"vectors that don't have {dim} components")
    return own.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding")


def load_or_train(spark: SparkSession, path: str, vectors: DataFrame, **options) -> tuple[IvfPq, DataFrame]:
    """(model, codes) of the checkpoint at `path`; without one it is trained from `vectors` and saved. Codes are
    written last, so that a checkpoint cut short counts as none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/codes/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        model = IvfPq.train(vectors, **options)
        model.save(spark, path, model.encode(vectors), "overwrite")
    return IvfPq.load(spark, path)
