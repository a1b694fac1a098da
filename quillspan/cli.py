"""Command line: build an index, search it, make and train a ranking model.

python -m quillspan.cli build --corpus docs.tsv --index DIR [--max-docs N]
python -m quillspan.cli query --index DIR --query TEXT [--limit N]
python -m quillspan.cli examples --index DIR --queries Q --qrels R --run T --out DIR [--sample N]
python -m quillspan.cli train --examples DIR --model DIR [--epochs N]
"""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import learning, spelling
from quillspan.operators.index import Index
from quillspan.plans.search import MAX_LIMIT, SearchEngine
from quillspan.sources import corpus


def build(spark: SparkSession, path: str, out: str, max_docs: int | None = None, analyzer: str = "english") -> None:
    docs = corpus.read_corpus(spark, path, max_docs)
    Index.build(docs, analyzer).save(out)


def query(spark: SparkSession, index: str, text: str, limit: int) -> dict:
    own = Index.load(spark, index)
    return SearchEngine(own, corrector=lambda q: spelling.correct(q, own.terms)).search(text, limit).to_dict()


def examples(index: Index, queries: DataFrame, qrels: DataFrame, run: DataFrame, seed: int = 42) -> DataFrame:
    """(split, qid, query, docs): the positive and its negatives with features, a row per query."""
    asked = queries.join(qrels.select("qid"), "qid", "left_semi").join(run.select("qid").distinct(), "qid", "left_semi")
    pos = asked.join(qrels, "qid").select(F.col("qid").alias("query_id"), "doc_id", F.lit(1).alias("label"), F.lit(0).alias("n"), F.lit("").alias("kind"))
    neg = learning.negatives(run, qrels).join(asked, "qid", "left_semi")
    neg = neg.select(F.col("qid").alias("query_id"), "doc_id", F.lit(0).alias("label"), "n", "kind")
    rows = learning.features(index, pos.unionByName(neg), [(r.qid, r.query) for r in asked.collect()])
    doc = F.struct("doc_id", "label", F.struct(*corpus.FEATURES).alias("features"))
    lists = rows.groupBy(F.col("query_id").alias("qid")).agg(F.sort_array(F.collect_list(F.struct(-F.col("label"), "kind", "n", doc.alias("doc")))).alias("own"))
    return learning.split_queries(asked, seed).join(lists.select("qid", F.transform("own", lambda x: x["doc"]).alias("docs")), "qid").select("split", "qid", "query", "docs")


def arrays(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    own = rows.orderBy("qid").collect()
    return [(np.array([[d.features[f] for f in corpus.FEATURES] for d in r.docs], float), np.array([d.label for d in r.docs], float)) for r in own]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--corpus", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--max-docs", type=int)
    q = sub.add_parser("query")
    q.add_argument("--index", required=True)
    q.add_argument("--query", required=True)
    q.add_argument("--limit", type=int, default=10, choices=range(1, MAX_LIMIT + 1), metavar="N")
    e = sub.add_parser("examples")
    for name in ("index", "queries", "qrels", "run", "out"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--sample", type=int, default=5000)
    t = sub.add_parser("train")
    t.add_argument("--examples", required=True)
    t.add_argument("--model", required=True)
    t.add_argument("--epochs", type=int, default=100)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    if a.command == "build":
        build(spark, a.corpus, a.index, a.max_docs)
    elif a.command == "query":
        print(json.dumps(query(spark, a.index, a.query, a.limit), ensure_ascii=False, indent=1))
    elif a.command == "examples":
        asked = learning.sample_queries(corpus.read_queries(spark, a.queries), a.sample)
        rows = examples(Index.load(spark, a.index), asked, corpus.read_qrels(spark, a.qrels), corpus.read_run(spark, a.run))
        rows.write.partitionBy("split").json(a.out)
    else:
        split = lambda s: arrays(corpus.read_examples(spark, f"{a.examples}/split={s}"))
        model, losses = learning.train(split("train"), split("val"), epochs=a.epochs)
        model.save(spark, a.model)
        print(json.dumps({"loss": losses[-1]}))


if __name__ == "__main__":
    main()
