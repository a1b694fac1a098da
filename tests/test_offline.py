"""The offline way: readers, embeddings, vector checkpoints, examples, training and the command line."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import cli
from quillspan.operators import learning, vectors
from quillspan.operators.index import Index
from quillspan.sources import corpus


def test_readers(spark, tmp_path):
    def file(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    rows = lambda df: sorted(map(tuple, df.collect()))
    docs = file("docs.tsv", b"D1\tu\tt\tone\ttab\nD2\tu\tcaf\xe9\ttwo\nbad\nD3\tu\t\t\n")
    assert rows(corpus.read_corpus(spark, docs)) == [(1, "u", "t", "one\ttab"), (2, "u", "café", "two"), (3, "u", "", "")]
    assert rows(corpus.read_corpus(spark, docs, 2).select("doc_id")) == [(1,), (2,)]  # skipped lines count
    assert rows(corpus.read_queries(spark, file("q.tsv", b"7\t pale moon \nx\ty\n8\n9\ta\tb\n"))) == [(7, "pale moon")]
    assert rows(corpus.read_qrels(spark, file("qrels", b"7 0 D4 1\n7 0 D5 1\n8 0 X 1\nshort\n"))) == [(7, 5)]
    run = file("run", b"7 Q0 D4 1 9.5 me\n7 Q0 D6 101 1 me\n7 Q0 D7 0 1 me\n8 Q0 bad 1 1 me\n")
    assert rows(corpus.read_run(spark, run)) == [(7, 4, 1)]
    lines = {"qid": 1, "query": "m", "docs": [{"doc_id": 3, "label": 1, "features": {"bm25_body": 2.5}}, {"doc_id": 4, "label": 0, "features": {}}]}
    first = corpus.read_examples(spark, file("ex.json", json.dumps(lines).encode()), 1).first()
    assert [(d.doc_id, d.label, tuple(d.features)) for d in first.docs] == [(3, 1, (2.5, 0.0, 0.0, 0.0, 0.0))]


def test_embeddings_are_made_once(spark, tmp_path):
    docs = corpus.embedding_input(spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "bbb")], "doc_id bigint, body string"))
    model = lambda texts: np.array([[len(t), 1.0] for t in texts])
    path = str(tmp_path / "e")
    got = {r.doc_id: r.embedding for r in vectors.write_embeddings(docs, model, path).collect()}
    assert got == {1: [len("search_document: a"), 1.0], 4: [len("search_document: bbb"), 1.0]}
    again = vectors.write_embeddings(docs, None, path)  # not called
    assert {r.doc_id: r.embedding for r in again.collect()} == got and vectors.read_embeddings(spark, path, 2).count() == 2
    with pytest.raises(ValueError, match="3 components"):
        vectors.read_embeddings(spark, path, 3)
    spark.createDataFrame([("x", 1.0)], "doc_id string, embedding double").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="no embeddings"):
        vectors.read_embeddings(spark, str(tmp_path / "odd"))


def test_vector_columns(spark):
    v = spark.createDataFrame([([1.0, 2.0, 6.0], [[1.0, 3.0], [3.0, 5.0]])], "v array<double>, m array<array<double>>")
    r = v.select(vectors.layer_norm(F.col("v")).alias("n"), vectors.mean_pool(F.col("m")).alias("p")).first()
    x = np.array([1.0, 2.0, 6.0])
    assert r.n == pytest.approx((x - x.mean()) / np.sqrt(x.var() + 1e-5)) and r.p == [2.0, 4.0]


def test_checkpoint_and_blocks(spark, tmp_path, monkeypatch):
    """A hot cell over many blocks, ties and repeated vectors: with all cells probed and all rows measured again the search is exact."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.01, (300, 8)), rng.normal(3, 1, (100, 8)), np.ones((20, 8))]).round(3)
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, embedding array<double>")
    monkeypatch.setattr(vectors, "CODE_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    path = str(tmp_path / "ivf")
    model, codes = vectors.load_or_train(spark, path, own, nlist=6, m=4, bits=4)
    again, _ = vectors.load_or_train(spark, path, own.limit(0))  # the checkpoint is there: nothing is trained
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.codebooks, again.codebooks) and codes.count() == len(x)
    asked = [(int(i), x[i].tolist()) for i in rng.choice(len(x), 30, replace=False)]
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    exact = key(vectors.knn(own, spark.createDataFrame(asked, "query_id bigint, vector array<double>"), 5))
    assert key(model.search(codes, asked, 5, 6, own, 100)) == exact
    near = key(model.search(codes, asked, 5, 6))
    assert len(near) == len(exact) and near == key(model.search(codes.repartition(7), asked, 5, 6))


def test_split_counts_and_order(spark):
    own = spark.createDataFrame([(i,) for i in (*range(1003), 5, 5)], "qid bigint")
    got = learning.split_queries(own).groupBy("split").agg(F.count_distinct("qid").alias("n"))
    assert {r.split: r.n for r in got.collect()} == {"train": 802, "val": 100, "test": 101}
    ends = learning.split_queries(own).groupBy("split").agg(F.min(F.xxhash64(F.lit(42), "qid")).alias("a"), F.max(F.xxhash64(F.lit(42), "qid")).alias("b")).collect()
    order = {r.split: r for r in ends}
    assert order["train"].b < order["val"].a and order["val"].b < order["test"].a
    assert learning.split_queries(own.limit(0)).count() == 0


def test_mean_metrics(spark):
    rows = [(1, 1, 3.0, 0), (1, 2, 2.0, 1), (2, 1, 1.0, 1), (2, 2, 0.0, 0)]
    r = learning.mean_metrics(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, label int")).first()
    loss = np.mean([np.log(np.exp(3) + np.exp(2)) - 2, np.log(np.e + 1) - 1])
    assert (r.n_queries, r.mrr, r.ndcg, r.loss) == pytest.approx((2, 0.75, (1 + 1 / np.log2(3)) / 2, loss))


def test_training_learns_what_tells():
    """One feature of five marks the document that is right; it does so in other queries too."""
    rng = np.random.default_rng(0)

    def lists(n):
        x, y = rng.random((n, 11, 5)), np.eye(11)[rng.integers(0, 11, n)]
        x[:, :, 3] = y
        return list(zip(x, y, strict=True))

    model, losses = learning.train(lists(60), lists(30), hidden=32, epochs=40)
    assert losses[-1] < losses[0] / 2 and np.mean([model(a).argmax() == y.argmax() for a, y in lists(50)]) > 0.8


def test_command_line(spark, tmp_path, capsys):
    """Build, search, make examples, train and load a model."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    write = lambda name, rows: (tmp_path / name).write_text("".join(f"{r}\n" for r in rows))
    write("docs", [f"D{i}\thttps://pages.test/{i}\tSheet {i}\t{t}" for i, t in enumerate(texts)])
    asked = {q: " ".join(texts[q].split()[:3]) for q in range(20)}
    write("queries", [f"{q}\t{t}" for q, t in asked.items()])
    write("qrels", [f"{q} 0 D{q} 1" for q in asked])
    write("run", [f"{q} Q0 D{(q + n * 7) % 60} {n} {100 - n} me" for q in asked for n in range(1, 30)])
    at = lambda name: str(tmp_path / name)
    cli.main(["build", "--corpus", at("docs"), "--index", at("index")])
    cli.main(["query", "--index", at("index"), "--query", texts[3].split()[0]])
    assert set(json.loads(capsys.readouterr().out)) == {"search_results", "correction"}
    cli.main(["examples", "--index", at("index"), "--queries", at("queries"), "--qrels", at("qrels"), "--run", at("run"), "--out", at("examples")])
    rows = spark.read.json(at("examples"))
    assert {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 16, "val": 2, "test": 2}
    for r in rows.collect():
        assert [d.label for d in r.docs] == [1] + [0] * 10 and r.docs[0].doc_id == r.qid and r.docs[0].features.phrase_match == 1.0
    cli.main(["train", "--examples", at("examples"), "--model", at("model"), "--epochs", "30"])
    assert json.loads(capsys.readouterr().out)["loss"] < np.log(11)
    model = learning.Scorer.load(spark, at("model"))
    for x, y in cli.arrays(corpus.read_examples(spark, at("examples/split=val"))):
        assert model(x).argmax() == y.argmax() == 0  # the epoch that is kept is the best one on these
    assert Index.load(spark, at("index")).docs.count() == 60
