"""Readers of corpora, queries, judgments and runs. Malformed lines are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import page_parts, utf8_or_latin1


def _doc_number(field: Column) -> Column:
    """The number of an id such as D123; null if it isn't one."""
    return F.when(field.rlike("^D[0-9]+$"), F.substring(field, 2, 20)).try_cast("bigint")


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(value): lines of a text file, ending at line feeds alone; not UTF-8: as Latin-1."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(utf8_or_latin1(F.col("value").cast("binary")).alias("value"))
    return raw if max_lines is None else raw.limit(max_lines)


def read_corpus(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(doc_id, url, title, body) of a headerless TSV. `max_lines` counts skipped lines too."""
    part = F.split(F.col("value"), "\t", 4)
    rows = read_lines(spark, path, max_lines).where(F.size(part) == 4)
    rows = rows.select(_doc_number(part[0]).alias("doc_id"), part[1].alias("url"), part[2].alias("title"), part[3].alias("body"))
    return rows.where("doc_id is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a TSV."""
    part = F.split(F.col("value"), "\t")
    rows = read_lines(spark, path).where(F.size(part) == 2)
    return rows.select(F.trim(part[0]).try_cast("bigint").alias("qid"), F.trim(part[1]).alias("query")).where("qid is not null")


def _fields(df: DataFrame, least: int) -> DataFrame:
    return df.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= least)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id): the positive document of each query, the last one that is listed."""
    lines = read_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(p) >= 3).select(p[0].try_cast("bigint").alias("qid"), _doc_number(p[2]).alias("doc_id"), "at")
    return rows.where("qid is not null and doc_id is not null").groupBy("qid").agg(F.max_by("doc_id", "at").alias("doc_id"))


def read_run(spark: SparkSession, path: str, max_rank: int = 100) -> DataFrame:
    """(qid, doc_id, rank) of a run file with six fields."""
    p = F.col("p")
    rows = _fields(read_lines(spark, path), 4).select(p[0].try_cast("bigint").alias("qid"), _doc_number(p[2]).alias("doc_id"), p[3].try_cast("int").alias("rank"))
    return rows.where(f"qid is not null and doc_id is not null and rank between 1 and {max_rank}")


EXAMPLE = "qid bigint, query string, docs array<struct<doc_id: bigint, label: int, features: struct<bm25_body: double, matched_terms: double, matched_frac: double, phrase_match: double, in_title: double>>>"


def read_examples(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """Learning-to-rank examples from JSON lines; a missing feature counts as 0."""
    docs = F.col("docs") if max_docs is None else F.slice("docs", 1, max_docs)
    zero = lambda d: F.struct(*(F.coalesce(d["features"][n], F.lit(0.0)).alias(n) for n in FEATURES))
    return spark.read.schema(EXAMPLE).json(path).withColumn("docs", F.transform(docs, lambda d: d.withField("features", zero(d))))


FEATURES = ("bm25_body", "matched_terms", "matched_frac", "phrase_match", "in_title")


def from_documents(documents: DataFrame) -> DataFrame:
    """A corpus from the documents table: bodies only."""
    none = F.lit(None).cast("string")
    return documents.select("doc_id", none.alias("url"), none.alias("title"), F.col("text").alias("body"))


def from_pages(pages: DataFrame) -> DataFrame:
    """A corpus from raw web pages."""
    title, body = page_parts(F.col("html"))
    return pages.select(F.col("page_id").alias("doc_id"), "url", title.alias("title"), body.alias("body"))


def embedding_input(docs: DataFrame, limit: int | None = None, prefix: str = "search_document: ") -> DataFrame:
    """(doc_id, text) for an embedding model: rows with a body, behind the task's prefix."""
    rows = docs.where("body is not null and trim(body) <> ''").select("doc_id", F.concat(F.lit(prefix), "body").alias("text"))
    return rows if limit is None else rows.limit(limit)
