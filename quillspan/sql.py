"""DuckDB SQL with the results of the registered queries, over the same tables."""

from __future__ import annotations

from quillspan.functions.text import INDEX_STOP_WORDS
from quillspan.queries import WORDS

_STOP = ", ".join(f"'{w}'" for w in INDEX_STOP_WORDS)
_TERMS = ", ".join(f"'{w}'" for w in WORDS)
#: regexp_replace of each pattern in turn, by a space
_STRIPPED = "html"
for _p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?is)<title.*?</title>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', ' ', 'g')"
_PAGE = f"SELECT page_id AS doc_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace({_STRIPPED}, '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages"


def _words(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '[0-9A-Za-z]+'), lambda w: lower(w))"


_DOCS = "docs AS (SELECT doc_id, NULL::VARCHAR AS title, text AS body FROM documents)"
_PAGES = f"docs AS ({_PAGE})"
_TOKENS = f"""toks AS (SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS term FROM (SELECT doc_id, {_words("body")} AS w FROM docs)),
tokens AS (SELECT * FROM toks WHERE term NOT IN ({_STOP})),
postings AS (SELECT term, doc_id, count(*)::INT AS tf, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL),
terms AS (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term),
lengths AS (SELECT doc_id, coalesce(len(list_filter({_words("title")}, lambda w: w NOT IN ({_STOP}))), 0)::INT AS title_len, coalesce(len(list_filter({_words("body")}, lambda w: w NOT IN ({_STOP}))), 0)::INT AS body_len FROM docs),
stats AS (SELECT count(*)::BIGINT AS num_docs, coalesce(avg(title_len), 0.0) AS avg_title_len, coalesce(avg(body_len), 0.0) AS avg_body_len FROM lengths WHERE title_len > 0 OR body_len > 0)"""


def _idf(clamp: bool = False) -> str:
    own = "ln((num_docs - df + 0.5) / (df + 0.5))"
    return f"greatest({own}, 0.0)" if clamp else own


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_D, _P = _with(_DOCS, _TOKENS), _with(_PAGES, _TOKENS)
_HAS = lambda w: f"doc_id IN (SELECT doc_id FROM postings WHERE term = '{w}')"
_PAIR = "a AS (SELECT doc_id, tf, positions FROM postings WHERE term = 'thon'), b AS (SELECT doc_id, tf, positions FROM postings WHERE term = 'tion')"
_TITLES = "titles AS (SELECT doc_id, lower(t) AS term, count(*)::BIGINT AS title_tf FROM (SELECT doc_id, unnest(regexp_extract_all(title, '[0-9A-Za-z]+')) AS t FROM docs) WHERE t NOT IN ('AND', 'OR', 'NOT') GROUP BY ALL)"


def _scores(terms: str, matched: str, title: bool, clamp: bool = False) -> str:
    """shares and scores of `matched` (doc_id) by the terms that `terms` selects, with idf."""
    boosted = "2.5 * coalesce(title_tf, 0) / (0.25 + 0.75 * greatest(title_len, 1) / CASE WHEN avg_title_len > 0 THEN avg_title_len ELSE 1.0 END) + " if title else ""
    weight = f"({boosted}tf / (0.25 + 0.75 * greatest(body_len, 1) / CASE WHEN avg_body_len > 0 THEN avg_body_len ELSE 1.0 END))"
    return f"""{_TITLES},
used AS ({terms}), matched AS ({matched}),
shares AS (SELECT p.doc_id, idf * {weight} * 2.2 / ({weight} + 1.2) AS share
  FROM postings p JOIN used u ON p.term = u.term JOIN matched USING (doc_id) JOIN lengths USING (doc_id) CROSS JOIN stats
  LEFT JOIN titles t ON t.doc_id = p.doc_id AND t.term = p.term),
scores AS (SELECT doc_id, round(coalesce(sum(share), 0), 6) AS score FROM (SELECT * FROM shares UNION ALL SELECT doc_id, 0.0 FROM matched) GROUP BY doc_id)"""


def _top(n: int = 20) -> str:
    return f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM scores QUALIFY rank <= {n}"


_ASKED = f"SELECT term, {_idf()} AS idf FROM terms CROSS JOIN stats WHERE term IN ({_TERMS})"
_ANY = f"SELECT DISTINCT doc_id FROM postings WHERE term IN ({_TERMS})"


def _search(words: tuple[str, ...], where: str) -> str:
    """Candidates of the rarest terms, a condition, and scores by the terms over the threshold."""
    own = ", ".join(f"'{w}'" for w in words)
    return _with(
        _PAGES, _TOKENS,
        f"asked AS (SELECT term, {_idf()} AS idf FROM terms CROSS JOIN stats WHERE term IN ({own}))",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY idf DESC, term) AS n FROM asked)",
        "cand AS (SELECT term FROM numbered WHERE idf > 0 AND (idf >= 0.5 OR n = 1) AND n <= 3)",
        "allowed AS (SELECT DISTINCT doc_id FROM postings SEMI JOIN cand USING (term))",
        _scores("SELECT term, idf FROM numbered WHERE idf >= 0.5 OR n = 1", f"SELECT doc_id FROM allowed WHERE {where}", True),
    ) + _top()


_NEXT = "doc_id IN (SELECT x.doc_id FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.term = 'eriner' AND y.term = 'thanea')"
_E = "e AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_SUM = lambda expr: f"list_sum(list_transform(range(1, len(e.v) + 1), lambda i: {expr}))"


def _knn(score: str, order: str) -> str:
    return f"""WITH {_E}, s AS (SELECT q.doc_id AS query_id, e.doc_id, {score} AS score FROM e JOIN e q ON q.doc_id % 20 = 0)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id)::INT AS rank FROM s) WHERE rank <= 10"""


_L2 = _SUM("(e.v[i] - q.v[i]) * (e.v[i] - q.v[i])")
_ITEMS = f"""firsts AS (SELECT item_id AS query_id, list_slice({_words("text")}, 1, 3) AS w FROM benchmark),
asked AS (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS off FROM firsts),
phrases AS (SELECT query_id, doc_id, count(*)::BIGINT AS tf FROM (SELECT query_id, doc_id, pos - off AS start FROM tokens JOIN asked USING (term) GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL)"""
_RUN = f"""{_DOCS}, {_TOKENS}, {_ITEMS},
known AS (SELECT DISTINCT query_id, term, {_idf()} AS idf FROM asked JOIN terms USING (term) CROSS JOIN stats),
shares AS (SELECT query_id, doc_id, idf, tf / (0.25 + 0.75 * greatest(body_len, 1) / avg_body_len) AS w FROM postings JOIN known USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats),
pairs AS (SELECT query_id AS qid, doc_id, round(sum(idf * w * 2.2 / (w + 1.2)), 6) AS score FROM shares GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 100),
qrels AS (SELECT query_id AS qid, min(doc_id) AS doc_id FROM phrases GROUP BY ALL),
labelled AS (SELECT r.*, CASE WHEN q.doc_id = r.doc_id THEN 1 ELSE 0 END AS label FROM run r JOIN qrels q USING (qid))"""
_METRICS = """metrics AS (SELECT qid, coalesce(1.0 / min(rank) FILTER (WHERE label > 0 AND rank <= 10), 0) AS mrr,
coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE label > 0 AND rank <= 10), 0) AS ndcg,
CASE WHEN sum(label) = 0 THEN 0 ELSE ln(sum(exp(score))) - sum(label * score) / sum(label) END AS loss FROM labelled GROUP BY qid)"""
_NEG = f"""WITH {_RUN}, other AS (SELECT r.* FROM run r JOIN qrels q ON r.qid = q.qid AND r.doc_id <> q.doc_id),
hard AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS n FROM other WHERE rank <= 10 QUALIFY n <= 10)"""
_FEATURE_QUERIES = "(VALUES (0, 'thon', 0), (0, 'tion', 1), (1, 'elle', 0), (1, 'pour', 1), (1, 'tion', 2), (2, 'the', 0), (2, 'thon', 1), (2, 'thon', 2))"

ORACLE_SQL = {
    "tokens_raw": _D + "SELECT doc_id, pos, term FROM tokens",
    "stopword_positions": _D + "SELECT doc_id, n_words, n_kept, last_pos FROM (SELECT doc_id, count(*)::INT AS n_words FROM toks GROUP BY doc_id) JOIN (SELECT doc_id, count(*)::BIGINT AS n_kept, max(pos)::INT AS last_pos FROM tokens GROUP BY doc_id) USING (doc_id)",
    "postings_raw": _D + "SELECT term, doc_id, tf, list_aggregate(positions, 'string_agg', ' ') AS positions FROM postings",
    "term_frequencies": _D + "SELECT term, df FROM terms",
    "doc_field_lengths": _P + "SELECT doc_id, title_len, body_len FROM lengths",
    "corpus_statistics": _P + "SELECT num_docs, round(avg_title_len, 6) AS avg_title_len, round(avg_body_len, 6) AS avg_body_len FROM stats",
    "title_term_counts": _with(_PAGES, _TITLES) + "SELECT doc_id, term, title_tf AS tf FROM titles",
    "page_text": _PAGE,
    "idf_table": _D + f"SELECT term, df, round({_idf()}, 6) AS idf, round({_idf(True)}, 6) AS idf_clamped FROM terms CROSS JOIN stats",
    "bool_and": _D + f"SELECT doc_id FROM documents WHERE {_HAS('thon')} AND {_HAS('tion')}",
    "bool_or": _D + f"SELECT doc_id FROM documents WHERE {_HAS('thon')} OR {_HAS('elle')}",
    "bool_and_not": _D + f"SELECT doc_id FROM documents WHERE {_HAS('thon')} AND NOT {_HAS('tion')}",
    "bool_nested": _D + f"SELECT doc_id FROM documents WHERE ({_HAS('thon')} OR {_HAS('elle')}) AND NOT ({_HAS('tion')} AND {_HAS('pour')})",
    "find_docs_and_tf": _with(_DOCS, _TOKENS, _PAIR) + "SELECT doc_id, a.tf + b.tf AS tf FROM a JOIN b USING (doc_id)",
    "find_docs_or_tf": _with(_DOCS, _TOKENS, _PAIR) + "SELECT doc_id, sum(tf)::INT AS tf FROM (SELECT doc_id, tf FROM a UNION ALL SELECT doc_id, tf FROM b) GROUP BY doc_id",
    "find_docs_not_tf": _with(_DOCS, _TOKENS, _PAIR) + "SELECT doc_id, tf FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)",
    "candidate_caps": _with(_DOCS, _TOKENS, "c AS (SELECT *, CASE term WHEN 'thon' THEN 0 ELSE 1 END AS t, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM postings WHERE term IN ('thon', 'tion'))") + "SELECT doc_id FROM (SELECT doc_id, min(t) AS t FROM c WHERE n <= 40 GROUP BY doc_id) ORDER BY t, doc_id LIMIT 60",
    **{f"positional_intersect_d{k}": _D + f"SELECT x.doc_id, count(*)::INT AS tf, string_agg(x.pos::VARCHAR, ' ' ORDER BY x.pos) AS positions FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND y.pos = x.pos + {k} WHERE x.term = 'de' AND y.term = 'la' GROUP BY x.doc_id" for k in (1, 3)},
    "phrases": _with(_DOCS, _TOKENS, _ITEMS) + "SELECT query_id, doc_id, tf FROM phrases",
    "phrase_search": _D + "SELECT x.doc_id, count(*)::INT AS tf FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN tokens z ON x.doc_id = z.doc_id AND z.pos = x.pos + 2 WHERE x.term = 'anea' AND y.term = 'eriner' AND z.term = 'thanea' GROUP BY x.doc_id",
    "phrase_with_stopword": _D + "SELECT x.doc_id, count(*)::INT AS tf FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.term = 'the' AND y.term = 'thon' GROUP BY x.doc_id",
    "bm25_body_topk": _with(_DOCS, _TOKENS, _scores(_ASKED, _ANY, False)) + _top(),
    "bm25_fielded_topk": _with(_PAGES, _TOKENS, _scores(_ASKED, _ANY, True)) + _top(),
    "rrf_fusion": _with(_DOCS, _TOKENS, _scores(_ASKED, _ANY, False), _E, f"near AS (SELECT e.doc_id, {_L2} AS distance FROM e CROSS JOIN (SELECT * FROM e ORDER BY doc_id LIMIT 1) q)", f"l AS ({_top()})", "s AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM near QUALIFY rank <= 20)", "f AS (SELECT doc_id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score, s.rank AS own FROM l FULL JOIN s USING (doc_id))") + "SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, own NULLS LAST, doc_id)::INT AS rank FROM f QUALIFY rank <= 20",
    "search_plain": _search(("thon", "tion"), f"{_HAS('thon')} AND {_HAS('tion')}"),
    "search_quoted": _search(("eriner", "thanea"), _NEXT),
    "search_boolean": _search(("thon", "tion"), f"({_HAS('thon')} OR {_HAS('tion')}) AND NOT {_HAS('elle')}"),
    "snippet_hits": _D + f"SELECT doc_id, string_agg(pos || ':' || term, ' ' ORDER BY pos) AS hits FROM tokens WHERE term IN ({_TERMS}) GROUP BY doc_id",
    "knn_ip": _knn(_SUM("e.v[i] * q.v[i]"), "DESC"),
    "knn_l2": _knn(_L2, "ASC"),
    "normalize_truncate": f"WITH {_E}, t AS (SELECT doc_id, v[1:16] AS v FROM e), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM t) SELECT doc_id, unnest(range(16))::INT AS i, round(unnest(v) / norm, 6) AS x FROM n",
    "negatives_hard": _NEG + "SELECT qid, doc_id, n FROM hard",
    "negatives_soft": _NEG + "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank DESC)::INT AS n FROM other ANTI JOIN hard USING (qid, doc_id) WHERE rank BETWEEN 80 AND 100 QUALIFY n = 1",
    **{name: f"WITH {_RUN}, {_METRICS} SELECT qid AS query_id, round({c}, 6) AS {c} FROM metrics" for name, c in (("mrr_at_10", "mrr"), ("ndcg_at_10", "ndcg"), ("softmax_loss", "loss"))},
    "metric_means": f"WITH {_RUN}, {_METRICS} SELECT count(*)::BIGINT AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(loss), 6) AS loss FROM metrics",
    "zscore": "WITH s AS (SELECT avg(n_chars) AS m, greatest(stddev_pop(n_chars), 1e-6) AS sd FROM documents) SELECT doc_id, round(greatest(least((n_chars - m) / sd, 8), -8), 6) AS n_chars FROM documents CROSS JOIN s",
    "split": "WITH n AS (SELECT count(*) AS n FROM documents) SELECT unnest(['train', 'val', 'test']) AS split, unnest([floor(0.8 * n)::BIGINT, floor(0.1 * n)::BIGINT, n - floor(0.8 * n)::BIGINT - floor(0.1 * n)::BIGINT]) AS n FROM n",
    "ltr_features": _with(
        _PAGES, _TOKENS, _TITLES,
        f"q AS (SELECT * FROM {_FEATURE_QUERIES} AS t(query_id, term, off))",
        "sizes AS (SELECT query_id, count(*) AS n_all, count(DISTINCT term) AS n_distinct FROM q GROUP BY query_id)",
        f"per AS (SELECT query_id, term, count(*) AS weight, greatest(ln((any_value(num_docs) - any_value(df) + 0.5) / (any_value(df) + 0.5)), 0.0) AS idf FROM q JOIN terms USING (term) CROSS JOIN stats GROUP BY query_id, term)",
        "used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS n FROM per) WHERE idf >= 0.5 OR n = 1)",
        "norm AS (SELECT p.term, p.doc_id, tf / (0.25 + 0.75 * greatest(body_len, 1) / avg_body_len) AS w FROM postings p JOIN lengths USING (doc_id) CROSS JOIN stats)",
        "score AS (SELECT query_id, doc_id, sum(weight * idf * w * 2.2 / (w + 1.2)) AS bm25_body FROM norm JOIN used USING (term) GROUP BY ALL)",
        "hit AS (SELECT query_id, doc_id, count(*) AS matched_terms FROM postings JOIN per USING (term) GROUP BY ALL)",
        "ph AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id, pos - off AS s, count(*) AS n FROM tokens JOIN q USING (term) GROUP BY ALL) JOIN sizes USING (query_id) WHERE n = n_all)",
        "ti AS (SELECT DISTINCT query_id, doc_id FROM titles JOIN (SELECT DISTINCT query_id, term FROM q) USING (term))",
    )
    + "SELECT query_id::BIGINT AS query_id, doc_id, round(coalesce(bm25_body, 0), 6) AS bm25_body, coalesce(matched_terms, 0)::DOUBLE AS matched_terms, round(coalesce(matched_terms / n_distinct, 0), 6) AS matched_frac, CASE WHEN ph.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS phrase_match, CASE WHEN ti.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS in_title FROM docs CROSS JOIN sizes LEFT JOIN score USING (query_id, doc_id) LEFT JOIN hit USING (query_id, doc_id) LEFT JOIN ph USING (query_id, doc_id) LEFT JOIN ti USING (query_id, doc_id)",
    "spell_suggest": _D + "SELECT word, term, distance FROM (SELECT word, term, levenshtein(word, term)::INT AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS n FROM (SELECT unnest(['thonx', 'tiom', 'elllle', 'thon']) AS word) w CROSS JOIN terms WHERE levenshtein(word, term) <= 2 AND word NOT IN (SELECT term FROM terms)) WHERE n = 1",
    "pagination": "SELECT doc_id, length(text)::INT AS n FROM documents ORDER BY n DESC, doc_id LIMIT 10 OFFSET 20",
}
