"""Column expressions for term weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    """Parameters of fielded BM25; the defaults are those of online search."""

    k1: float = 1.2
    title_boost: float = 2.5
    body_boost: float = 1.0
    b_title: float = 0.75
    b_body: float = 0.75
    idf_threshold: float = 0.5
    min_terms: int = 1
    clamp_idf: bool = False


#: Scoring of the learning-to-rank feature: the body alone, no negative weights.
BM25_FEATURE = Bm25(title_boost=0.0, b_title=0.0, clamp_idf=True)


def idf(num_docs: Column, df: Column, clamp: bool = False) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); 0 without documents."""
    value = F.log((num_docs - df + 0.5) / (df + 0.5))
    value = F.greatest(value, F.lit(0.0)) if clamp else value
    return F.when((num_docs > 0) & (df > 0), value).otherwise(F.lit(0.0))


def field_norm(tf: Column, length: Column, average: Column, b: float) -> Column:
    """Length-normalised term frequency of one field."""
    avg = F.when(average > 0, average).otherwise(F.lit(1.0))
    denom = F.lit(1.0 - b) + F.lit(b) * F.greatest(length, F.lit(1)) / avg
    return F.when(tf <= 0, F.lit(0.0)).when(denom <= 0, tf.cast("double")).otherwise(tf / denom)


def bm25(weight: Column, term_idf: Column, k1: float) -> Column:
    """A term's share of a document's score, from its weighted frequency over fields."""
    return term_idf * weight * (k1 + 1) / (weight + k1)


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank share; ranks start at 1."""
    return F.lit(1.0) / (F.lit(k) + rank)
