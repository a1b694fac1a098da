"""Steps whose work grew faster than their input: same results as brute force, and plans without the costly step."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan import queries
from quillspan.functions.scoring import Bm25
from quillspan.operators import index, matching, ranking, vectors
from quillspan.operators.index import by_repetition, corpus_stats, doc_lengths, postings, tokens
from quillspan.queries import QUERIES
from quillspan.sql import ORACLE_SQL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_knn_in_tiles(spark, monkeypatch, metric):
    """Many queries meet the vectors in tiles, not pair by pair: ties and copies by id, odd vectors last."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-2, 3, (300, 6)).astype(float), np.ones((150, 6)), rng.normal(0, 1, (150, 6))])
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "doc_id bigint, embedding array<double>")
    asked = own.where("doc_id % 5 = 0 and doc_id < 600").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(vectors, "TILE_VECTORS", 100)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 50)
    got = vectors.knn(own, asked, 7, metric)
    assert "FlatMapCoGroupsInArrow" in plan(got)
    want = []
    for q in range(0, 600, 5):
        score = [-float(v @ x[q]) if metric == "ip" else float(((v - x[q]) ** 2).sum()) for v in x]
        want += [(q, r + 1, i) for r, i in enumerate(sorted(range(600), key=lambda i: (round(score[i], 9), i))[:7])]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == want
    least = vectors.knn(own.where("doc_id >= 595"), asked, 7, metric).where("query_id = 0").orderBy("rank").collect()
    assert len(least) == 6 and (least[-1].doc_id, least[-1].score) == (900, None)


def test_ivf_rows_of_a_tile(spark):
    """A tile gives the best rows of a query over all cells, not those of each cell."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2000, 8))
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, embedding array<double>")
    asked = own.where("doc_id < 60").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    model = vectors.IvfPq.train(own, nlist=20, m=8)
    codes = model.encode(own)
    got = model.search(codes, asked, 5, 12)
    assert "FlatMapCoGroupsInArrow" in plan(got)
    rows = codes.orderBy("doc_id").collect()
    cell, code = np.array([r.cell for r in rows]), np.array([list(r.codes) for r in rows])
    seen = np.array([model.centroids[c] + np.concatenate([b[k] for b, k in zip(model.codebooks, o, strict=True)]) for c, o in zip(cell, code, strict=True)])
    want = []
    for q in range(60):
        near = np.argsort(((model.centroids - x[q]) ** 2).sum(1), kind="stable")[:12]
        score = np.where(np.isin(cell, near), ((seen - x[q]) ** 2).sum(1).round(9), np.inf)
        want += [(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(2000), score))[:5])]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == want


DOCS = [(i, " ".join(("Alpha the beta gamma", "gamma alpha alpha beta", "THE delta extraordinary beta", "alpha beta gamma alpha beta gamma")[(i + k) % 4] for k in range(1 + i % 5))) for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, None, None, t) for i, t in [*DOCS, (50, None), (51, ""), (52, "Ünd älpha béta alpha!extraordinary2 extraordinary"), (7, "alpha beta again"), (None, "beta")]]
    return spark.createDataFrame(rows, "doc_id bigint, url string, title string, body string")


@pytest.mark.parametrize("terms", [None, ("alpha", "extraordinary", "extraordinary2", "the", "none")])
def test_postings_without_shuffle(spark, corpus, terms):
    """As a grouping of all words gives them, also for a doc_id that several rows have or none has."""
    got = postings(corpus, terms=terms)
    assert "collect_list(pos#" not in plan(got) and "MapInArrow" in plan(got)
    want = tokens(corpus).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    want = want if terms is None else want.where(F.col("term").isin(*terms))
    key = lambda df: sorted(((r.term, r.doc_id, r.tf, r.positions) for r in df.collect()), key=str)
    assert key(got) == key(want)


def test_best_bm25_keeps_ties(spark, corpus):
    """A task's best rows hold all that can be first after rounding, and whole scores."""
    docs = by_repetition(corpus)[0].repartition(3)
    weights = [(1, "alpha", 0.7), (1, "beta", 0.4), (2, "gamma", -0.3), (3, "none", 1.0)]
    lengths, stats = doc_lengths(docs), corpus_stats(doc_lengths(docs))
    own = postings(docs, terms=[t for _, t, _ in weights])
    terms = spark.createDataFrame([(*w, 1) for w in weights], "query_id bigint, term string, idf double, weight int")
    matched = own.join(F.broadcast(terms), "term").select("query_id", "doc_id").distinct()
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in ranking.ranked(df.withColumn("score", F.round("score", 6)), 4, F.desc("score"), "doc_id").collect())
    whole = ranking.score_bm25(matched, own, terms, lengths, stats, None, Bm25(title_boost=0.0))
    assert rows(ranking.best_bm25(docs, weights, stats.first().avg_body_len, 4)) == rows(whole)


def test_find_phrases(spark, corpus):
    docs = by_repetition(corpus)[0]
    asked = {1: ["alpha", "beta", "gamma"], 2: ["gamma", "alpha", "alpha"], 3: ["alpha", "the", "beta"], 4: ["alpha", "beta", "gamma"]}
    got = sorted((r.query_id, r.doc_id, r.tf) for r in matching.find_phrases(docs, asked).collect())
    want = [(q, r.doc_id, r.tf) for q, own in asked.items() for r in matching.phrase(postings(docs), own).collect()]
    assert got == sorted(want) and got


RUN_QUERIES = ("metric_means", "ndcg_at_10", "mrr_at_10", "softmax_loss", "negatives_hard", "negatives_soft")


@pytest.mark.parametrize("name", [*RUN_QUERIES, "bm25_body_topk", "rrf_fusion"])
def test_run_reads_texts_once(spark, monkeypatch, name):
    """Statistics, scores and judgments come from one pass over the texts."""
    read, whole = spark.sparkContext.accumulator(0), queries.documents

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    monkeypatch.setattr(queries, "documents", lambda *a: whole(*a).withColumn("body", counted("body")))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert read.value == whole(spark, "/root/testdata/sf0.001").count()


def test_run_of_odd_rows(spark, save):
    """As SQL: documents and items that share an id or have none, a phrase over two rows of an id, one in a row
    without an id only, null and empty texts, stop words, words over eight letters, rare characters."""
    texts = ["alpha beta gamma", "Alpha the beta gamma delta", "extraordinary extraordinarily delta beta", "beta gamma delta alpha beta gamma", "", None, "the and of", "ünd alpha béta\0gamma alpha.beta-gamma"]
    docs = [(i, " ".join(str(texts[(i * k) % 8] or "") for k in range(1 + i % 4)) if i % 9 else texts[i % 8]) for i in range(150)]
    docs += [(500, "omega"), (500, "x psi"), (500, "x x chi"), (7, "alpha beta gamma"), (7, "alpha beta gamma"), (None, "sole sigma tau"), (None, "sole alpha"), (501, "sole sigma")]
    items = [(1, "Alpha beta gamma more"), (2, "extraordinary extraordinarily delta"), (3, "omega psi chi"), (4, "sole sigma tau"), (5, "beta gamma"), (6, None), (7, "alpha the beta"), (8, "none of these"), (9, "beta beta gamma"), (9, "delta alpha"), (10, "alpha beta gamma"), (None, "alpha beta gamma"), (12, "gamma delta alpha")]
    d = save(documents=spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    for name in RUN_QUERIES:
        got = QUERIES[name](spark, d)
        rows = sorted((tuple(r) for r in got.collect()), key=str)
        assert rows == sorted(con.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall(), key=str) and rows, name


def test_best_rows_in_parts():
    """Rows added in many parts leave the same rows as all at once, whatever falls under a query's limit on the way."""
    rng = np.random.default_rng(3)
    n, terms = 3000, list("abcdef")
    weights = [(q, t, float(rng.normal())) for q in range(5) for t in terms if rng.random() < 0.5]
    kept, tf = rng.integers(1, 60, n), rng.integers(0, 4, (n, 6))
    parts = []
    for size in (n, 100, 7):
        best = ranking.Best(weights, terms, 30.0, 20, Bm25(title_boost=0.0))
        for k in range(0, n, size):
            row, term = np.nonzero(tf[k : k + size])
            best.add(np.arange(k, min(k + size, n)), kept[k : k + size], row, term, tf[k : k + size][row, term])
        parts.append(best.batch().to_pylist())
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) >= 20


def test_stems_of_wanted_terms_alone(monkeypatch):
    """A worker stems only words that can give a wanted term, with the same postings and lengths, and keeps few stems."""
    words = [a + b for a in ("thon", "dy", "skie", "y", "ies", "general", "s", "elle", "0", "in", "e", "eed", "ell") for b in ("", "ing", "s", "ed", "ies", "ly", "ational", "y", "e", "eed", "ying")]
    assert all(index.stem(w)[0] == w[0] for w in words)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [" ".join(words).encode(), b"thons the dying", None]})
    called, real = [], index.stem
    monkeypatch.setattr(index, "stem", lambda w: called.append(w) or real(w))
    wanted = {"thon", "die", "none"}

    def found():
        s = next(index._slices(iter([batch]), "english", whole))
        return sorted((r, p, s.terms[t]) for r, p, t in zip(s.row.tolist(), s.pos.tolist(), s.term.tolist(), strict=True) if s.terms[t] in wanted), s.n_kept.tolist()

    whole = None
    want, n_all = found(), len(called)
    called.clear()
    whole = wanted
    assert found() == want and want[0] and 0 < len(called) < n_all / 3
    assert real.cache_info().maxsize <= 1 << 15
