"""Search: queries to one lazy plan over the index tables.

All queries of a call run together: each row carries query_id. The driver parses queries and looks up the document
frequencies of their terms; matching, scoring, fusion and top-k are one plan, and the documents' texts join behind
the limit only.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspan.functions.scoring import Bm25
from quillspan.functions.scoring import idf as term_idf
from quillspan.functions.text import INDEX_STOP_WORDS, QUERY_STOP_WORDS, normalize_query
from quillspan.operators import ranking, snippets, vectors
from quillspan.operators.index import Index, term_df
from quillspan.plans import language

MAX_QUERY, MAX_LIMIT, DEFAULT_LIMIT = 100, 500, 10
ALL = 1 << 30


@dataclass(frozen=True)
class Options:
    """Limits and habits of a search. `compat`: see plans.language; `restem`: the words of a plain query are stemmed
    once more, so some don't match; quoted stop words never match under compat, else they keep their place.
    `per_term` and `candidates` bound the documents that a query looks at, by the smallest doc_ids, as online search
    does; `whole()` looks at all."""

    bm25: Bm25 = Bm25()
    max_candidate_terms: int = 3
    candidate_idf: float = 0.5
    min_candidate_terms: int = 1
    per_term: int = 10_000
    candidates: int = 10_000
    rrf_k: int = 60
    compat: bool = True
    restem: bool = True

    def whole(self) -> Options:
        return replace(self, per_term=ALL, candidates=ALL)


@dataclass
class Prepared:
    """A query as the plan needs it."""

    query_id: int
    text: str
    kind: str  # phrase, boolean or plain
    terms: list[str]  # for candidates, scoring and snippets
    clauses: list[language.Clause] = field(default_factory=list)
    phrase: list[tuple[str, int]] = field(default_factory=list)  # (term, offset)
    warnings: list[str] = field(default_factory=list)


def is_quoted(text: str) -> bool:
    t = text.strip()
    return t[:1] in ("'", '"') and t[:1] == t[-1:]


def prepare(query_id: int, text: str, analyzer: str, o: Options = Options()) -> Prepared:
    """Parse one query; raises InvalidQueryError."""
    tokens = normalize_query(text, analyzer)
    parsed = language.parse(tokens, o.compat) if language.has_operators(tokens) else None
    own = parsed.positive if parsed else list(dict.fromkeys(tokens))
    terms = [t for t in own if t not in QUERY_STOP_WORDS]
    out = Prepared(query_id, text, "plain", terms, warnings=parsed.warnings if parsed else [])
    if is_quoted(text):
        out.kind = "phrase"
        inner = list(enumerate(normalize_query(text.strip()[1:-1], analyzer)))
        out.phrase = [(t, i) for i, t in inner if o.compat or t not in INDEX_STOP_WORDS]
    elif parsed:
        out.kind, out.clauses = "boolean", language.clauses(parsed.root)
    elif terms:
        again = normalize_query(" ".join(terms), analyzer) if o.restem else terms
        out.clauses = language.clauses(language.and_chain(again))
    return out


class SearchEngine:
    """Searches an index. vectors: (doc_id, embedding) or None; vector_search(queries, n): another search of the same
    contract as `exact`, such as an inverted file; embedder: text to vector; corrector: query to query."""

    def __init__(
        self,
        index: Index,
        vectors: DataFrame | None = None,
        embedder: Callable[[str], list[float]] | None = None,
        corrector: Callable[[str], str | None] | None = None,
        options: Options = Options(),
        vector_search: Callable[[list[tuple[int, list[float]]], int], DataFrame] | None = None,
    ):
        self.index, self.vectors, self.embedder, self.corrector, self.o = index, vectors, embedder, corrector, options
        self.spark = index.docs.sparkSession
        self.vector_search = vector_search or (self.exact if vectors is not None else None)
        self._held: list[DataFrame] = []

    def exact(self, queries: list[tuple[int, list[float]]], n: int) -> DataFrame:
        asked = self.spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id bigint, vector array<double>")
        return vectors.knn(self.vectors, asked, n)

    @cached_property
    def stats(self) -> DataFrame:
        """The row of corpus statistics, read once."""
        return self.spark.createDataFrame([tuple(self.index.stats.select("num_docs", "avg_title_len", "avg_body_len").first())], "num_docs bigint, avg_title_len double, avg_body_len double")

    def slice(self, queries: list[Prepared]) -> DataFrame:
        """Postings of the queries' terms, kept until `release` as each step of a search reads them."""
        used = {t for q in queries for t in (*q.terms, *(t for t, _ in q.phrase), *(t for c in q.clauses for s in c for t in s))}
        posts = self.index.of(used).persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(posts)
        return posts

    def release(self) -> None:
        """Let go of the postings that searches have kept."""
        while self._held:
            self._held.pop().unpersist()

    def weights(self, posts: DataFrame) -> dict[str, float]:
        """idf of the terms in a slice."""
        rows = term_df(posts).crossJoin(F.broadcast(self.stats.select("num_docs")))  # one row
        return {r.term: r.idf for r in rows.select("term", term_idf(F.col("num_docs"), F.col("df"), self.o.bm25.clamp_idf).alias("idf")).collect()}

    def matched(self, queries: list[Prepared], posts: DataFrame, idf: dict[str, float]) -> DataFrame:
        """(query_id, doc_id) that the queries match."""
        o, spark = self.o, self.spark
        cand = [(q.query_id, t, r) for q in queries for r, t in enumerate(candidate_terms(q.terms, idf, o))]
        allowed = ranking.candidates(posts, spark.createDataFrame(cand, "query_id bigint, term string, term_rank int"), o.per_term, o.candidates)
        # boolean and plain queries: the terms that a document has, as bit masks of 62 terms each, against the clauses'
        bits, masks, width = [], [], 1
        split = lambda ns: [sum(1 << n % 62 for n in ns if n // 62 == w) for w in range(width)]
        own = [(q, {t: i for i, t in enumerate(dict.fromkeys(t for c in q.clauses for s in c for t in sorted(s)))}) for q in queries if q.kind != "phrase" and q.clauses]
        width = max((len(bit) // 62 + 1 for _, bit in own), default=1)
        for q, bit in own:
            bits += [(q.query_id, t, i // 62, 1 << i % 62) for t, i in bit.items()]
            masks.append((q.query_id, [tuple(split([bit[t] for t in own]) for own in c) for c in q.clauses]))
        one = posts.select("term", "doc_id").join(F.broadcast(spark.createDataFrame(bits, "query_id bigint, term string, word int, bit bigint")), "term").join(allowed, ["query_id", "doc_id"], "left_semi")
        word = lambda w: F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"held{w}")
        held = one.groupBy("query_id", "doc_id").agg(*(word(w) for w in range(width)))
        want = spark.createDataFrame(masks, "query_id bigint, clauses array<struct<must: array<bigint>, mustnot: array<bigint>>>")

        def fit(c):
            rules = [(F.col(f"held{w}").bitwiseAND(c["must"][w]) == c["must"][w]) & (F.col(f"held{w}").bitwiseAND(c["mustnot"][w]) == 0) for w in range(width)]
            return reduce(and_, rules)

        boolean = held.join(F.broadcast(want), "query_id").where(F.exists("clauses", fit)).select("query_id", "doc_id")
        # phrases: positions less offsets
        places = [(q.query_id, t, i, len(q.phrase)) for q in queries for t, i in q.phrase]
        asked = spark.createDataFrame(places, "query_id bigint, term string, off int, n_terms int")
        at = posts.join(F.broadcast(asked), "term").join(allowed, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "off", "n_terms", F.explode("positions").alias("pos"))
        starts = at.groupBy("query_id", "doc_id", (F.col("pos") - F.col("off")).alias("start"), "n_terms").agg(F.count("*").alias("n"))
        return boolean.unionByName(starts.where("n = n_terms").select("query_id", "doc_id").distinct())

    def lexical(self, queries: list[Prepared], limit: int) -> tuple[DataFrame, DataFrame]:
        """(ranked (query_id, doc_id, score, rank), postings of the queries' terms)."""
        posts = self.slice(queries)
        idf = self.weights(posts)
        matched = self.matched(queries, posts, idf)
        scoring = [(q.query_id, t, idf[t], 1) for q in queries for t in scoring_terms(q.terms, idf, self.o.bm25)]
        terms = self.spark.createDataFrame(scoring, "query_id bigint, term string, idf double, weight int")
        scores = ranking.score_bm25(matched, posts, terms, self.index.lengths, self.stats, self.index.docs.select("doc_id", "title"), self.o.bm25, self.index.analyzer)
        return ranking.ranked(scores, limit, F.desc("score"), "doc_id"), posts

    def search_many(self, queries: list[tuple[int, str]], limit: int = DEFAULT_LIMIT, query_vectors: dict[int, list[float]] | None = None) -> DataFrame:
        """(query_id, rank, document_id, url, title, snippet, rrf_score) of queries (query_id, text)."""
        own = [prepare(q, text, self.index.analyzer, self.o) for q, text in queries]
        for q in own:
            for note in q.warnings:
                warnings.warn(note, language.QueryWarning, stacklevel=2)
        found, posts = self.lexical(own, limit)
        lists = found.select("query_id", F.lit("lexical").alias("source"), "doc_id", "rank")
        given = dict(query_vectors or {})
        if self.embedder:
            given |= {q.query_id: self.embedder(q.text) for q in own if q.query_id not in given}
        if given and self.vector_search:
            near = self.vector_search(list(given.items()), 2 * limit).where((F.col("rank") <= limit) & (F.col("doc_id") >= 0))
            lists = lists.unionByName(near.select("query_id", F.lit("semantic").alias("source"), "doc_id", "rank"))
        fused = ranking.fuse(lists, limit, self.o.rrf_k)
        docs = self.index.docs.join(F.broadcast(fused), "doc_id")  # at most `limit` rows per query
        terms = self.spark.createDataFrame([(q.query_id, t) for q in own for t in q.terms], "query_id bigint, term string")
        rows = snippets.with_snippets(docs, posts, terms)
        title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))
        rows = rows.select("query_id", "rank", F.col("doc_id").alias("document_id"), "url", title.alias("title"), "snippet", F.col("score").alias("rrf_score"))
        return rows.where(F.col("url").rlike("^https?://[^\\s/]+")).orderBy("query_id", "rank")

    def search(self, text: str, limit: int = DEFAULT_LIMIT, vector: list[float] | None = None) -> SearchResponse:
        """The response to one query. Raises ValueError for a text or limit out of bounds, InvalidQueryError for a
        query that can't be understood."""
        if not 1 <= len(text) <= MAX_QUERY:
            raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"a limit is 1 to {MAX_LIMIT}")
        rows = self.search_many([(0, text)], limit, None if vector is None else {0: vector}).drop("query_id", "rank").collect()
        self.release()
        fixed = self.corrector(text.strip()) if self.corrector else None
        return SearchResponse(rows, fixed if fixed != text.strip() else None)


@dataclass
class SearchResponse:
    search_results: list[Row]
    correction: str | None = None

    def to_dict(self) -> dict:
        return {"search_results": [r.asDict() for r in self.search_results], "correction": self.correction}

    def page(self, number: int, size: int) -> list[Row]:
        """Results of page `number`, from 1."""
        return self.search_results[(number - 1) * size : number * size]


def http_search(engine: SearchEngine, q: str, limit: int = DEFAULT_LIMIT) -> tuple[int, dict]:
    """(status, body) of the search endpoint, for any web server to serve."""
    try:
        return 200, engine.search(q, limit).to_dict()
    except language.InvalidQueryError as e:
        return 400, {"detail": str(e)}
    except ValueError as e:
        return 422, {"detail": str(e)}


def candidate_terms(terms: list[str], idf: dict[str, float], o: Options) -> list[str]:
    """The rarest terms: those over the threshold, but some at least; none that most documents have."""
    own = sorted((t for t in dict.fromkeys(terms) if idf.get(t, 0) > 0), key=lambda t: (-idf[t], t))
    over = [t for t in own if idf[t] >= o.candidate_idf]
    return (over if len(over) >= o.min_candidate_terms else own[: o.min_candidate_terms])[: o.max_candidate_terms]


def scoring_terms(terms: list[str], idf: dict[str, float], p: Bm25) -> list[str]:
    own = sorted((t for t in dict.fromkeys(terms) if t in idf), key=lambda t: (-idf[t], t))
    over = [t for t in own if idf[t] >= p.idf_threshold]
    return over if len(over) >= p.min_terms else own[: p.min_terms]
