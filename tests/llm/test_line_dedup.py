"""Line dedup against brute force, its SQL, and the way beyond the broadcast."""

import hashlib
import re
from collections import defaultdict

import duckdb
from conftest_rows import as_rows

from quillspan.llm import line_dedup, queries

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=5, least=40):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    key = lambda x: x.strip(SPACE).translate(lower)
    at = defaultdict(set)
    rank = lambda d: -(1 << 63) if d is None else d
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= least:
                at[key(x)].add(rank(r.doc_id))
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(at.get(key(x), ())) < min_docs or max(at[key(x)]) == rank(r.doc_id)]
        out.append((r.doc_id, hashlib.sha256("\n".join(kept).encode()).hexdigest(), len(lines) - len(kept), len(lines)))
    return sorted(out, key=str)


def test_query(spark, docs, save):
    d = save(documents=docs)
    got = queries.op2_line_dedup(spark, d).select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs.collect())
    assert any(r.n_dropped for r in got)


def test_sql(spark, docs, save):
    d = save(documents=docs.where("doc_id is not null").dropDuplicates())
    duckdb.sql(f"create or replace view documents as select * from '{d}/documents.parquet/*.parquet'")
    want = sorted(duckdb.sql("select doc_id, kept_sha256, n_dropped, n_lines from (" + queries.ORACLE_SQL["op2_line_dedup"] + ")").fetchall(), key=str)
    assert sorted(map(tuple, queries.op2_line_dedup(spark, d).select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect()), key=str) == want


def test_join_instead_of_broadcast(docs):
    assert as_rows(line_dedup.dedup_lines(docs, max_broadcast=-1)) == as_rows(line_dedup.dedup_lines(docs))


def test_crowded_filter_is_exact(docs):
    assert as_rows(line_dedup.dedup_lines(docs, bits=line_dedup.BLOCK_BITS)) == as_rows(line_dedup.dedup_lines(docs))


def test_no_rows_and_clashing_columns(no_docs, clashing, docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []
    got = line_dedup.dedup_lines(clashing)
    assert as_rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == as_rows(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped"))
    assert {"lang", "source", "h", "_drops", "_key"} <= set(got.columns)


def test_key():
    assert line_dedup.key(b" \t" + b"A" * 40 + b"\r") == b"a" * 40 and line_dedup.key(b"a" * 39) is None
    assert line_dedup.key("é".encode() * 39) is None and line_dedup.key("É".encode() * 40) == "É".encode() * 40
    assert re.fullmatch("a+", line_dedup.key(b"A" * 50).decode())
