"""Spelling suggestions from the index vocabulary.

The nearest known term by edit distance, the most frequent of equals. Any function from a query to a query can
take its place in the search engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.ranking import ranked


def suggest(words: DataFrame, terms: DataFrame, max_distance: int = 2, min_df: int = 1) -> DataFrame:
    """(word, term, distance): the suggestion for each of words (word) that isn't a term. words: those of queries."""
    new = words.select("word").distinct().join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    pool = terms.where(F.col("df") >= min_df).withColumn("n", F.length("term"))
    near = pool.join(F.broadcast(new), F.abs(F.col("n") - F.length("word")) <= max_distance)
    near = near.withColumn("distance", F.levenshtein("word", "term", max_distance)).where("distance >= 0")
    return ranked(near, 1, "distance", F.desc("df"), "term", by="word").select("word", "term", "distance")


def correct(query: str, terms: DataFrame, max_distance: int = 2) -> str | None:
    """The query with unknown words replaced; None if nothing changes."""
    own = [w.lower() for w in re.findall(r"[A-Za-z]{3,}", query) if w not in ("AND", "OR", "NOT")]
    if not own:
        return None
    spark = terms.sparkSession
    found = {r.word: r.term for r in suggest(spark.createDataFrame([(w,) for w in own], "word string"), terms, max_distance).collect()}
    fixed = re.sub(r"[A-Za-z]{3,}", lambda m: found.get(m[0].lower(), m[0]) if m[0] not in ("AND", "OR", "NOT") else m[0], query)
    return fixed if fixed != query else None
