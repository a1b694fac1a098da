"""Held-out accuracy of the toxicity scores, and that nothing but text is their input."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest_rows import as_rows
from pyspark.sql import functions as F

from quillspan.llm import queries, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, d).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in got.doc_id]).all()
    y = duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").df().merge(got[got.held_out], on="doc_id")
    assert auc(y.score.to_numpy(), y.toxic.to_numpy()) > 0.95
    assert (y.predicted == y.toxic).mean() > 0.95


def test_ids_are_no_input(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twin = docs.limit(50).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")
    got = toxicity.score(docs.select("doc_id", "text").unionByName(twin), labels).toPandas().set_index("doc_id")
    for i in got.index[got.index >= 10**9]:
        assert got.loc[i].score == got.loc[i - 10**9].score


def test_odd_rows(spark, docs, no_docs, clashing):
    labels = spark.createDataFrame([(60 + i, i % 2) for i in range(40)] + [(None, 1), (61, None), (1, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert toxicity.score(no_docs, labels).collect() == []
    assert as_rows(toxicity.score(clashing, labels).select("doc_id", "score")) == as_rows(got.select("doc_id", "score"))
    none = toxicity.score(docs, labels.limit(0))
    assert none.where("score <> 0 or predicted <> 0").count() == 0 and none.count() == docs.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_invented_vocabularies(spark, seed):
    """Insults are stems with varied endings; copies of documents must not decide what the dictionaries hold."""
    rng = random.Random(seed)
    syllables = ["".join(rng.sample("bcdfghklmnprstvw", 1) + rng.sample("aeiou", 1) + rng.choice([[], ["n"], ["r"], ["st"]])) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 2, 3))))
    stems = ["".join(rng.choice("qxzjyvk") + rng.choice("aeiou") for _ in range(3)) for _ in range(6)]
    rows, labels = [], []
    for i in range(1500):
        own, toxic = [word() for _ in range(rng.randint(60, 300))], i % 8 == 0
        for _ in range(rng.randint(3, 6) * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(stems) + rng.choice(syllables))
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    rows += [(2000 + k, rows[1][1]) for k in range(200)]
    labels += [(2000 + k, 0) for k in range(200)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks).where("held_out").join(marks, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.1
