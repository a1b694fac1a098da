"""Exact round trip of packed ids, bounds on padding, and defined results of odd rows."""

import zlib
from collections import defaultdict

import numpy as np
from conftest_rows import as_rows
from tokenizers import Tokenizer

from quillspan.llm import packing, token_counts
from quillspan.llm.common import vocabulary


def ids_of(text):
    return [*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, size=2048):
    tok = Tokenizer.from_file(vocabulary())
    want = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    pieces = packing.pack(docs, size).collect()
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append(p)
    for own in held.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == own[0].sequence_length <= size and (at == size or at & (at - 1) == 0)
    by_doc, count = defaultdict(list), defaultdict(list)
    for doc, ids in want:
        count[doc].append(ids)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert by_doc.keys() == count.keys()
    for doc, own in by_doc.items():
        texts = count[doc]
        if len({tuple(t) for t in texts}) > 1:
            continue
        ids = texts[0]
        starts = defaultdict(int)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
            starts[p.start] += p.length
        assert sum(p.length for p in own) == len(ids) * len(texts)
    return pieces


def test_round_trip(docs):
    check(docs)


def test_small_windows(docs):
    check(docs, 64)


def test_special_strings_and_marks(spark):
    own = ["<|endoftext|> a", "Hello,World!! it's 1234 'tis", "ﬁ ÀÉ ʼn İstanbul", "a b c　d", "x" * 3000, "é é.", "don't DON'T we'll", "<|startoftext|>", "ẞß ǅ", "a\x0bb\x0cc\rd\te"]
    check(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"))


def test_no_rows_and_clashing_columns(no_docs, clashing, docs):
    assert packing.pack(no_docs).collect() == []
    assert as_rows(packing.pack(clashing).drop("sequence_id", "offset"), "doc_id", "start") == as_rows(packing.pack(docs).drop("sequence_id", "offset"), "doc_id", "start")


def test_sum_of_squares_rule():
    bins = packing.SumOfSquares(10)
    assert bins.place("a", 6) is None and bins.place("b", 4) == ["a", "b"]
    for x in "cde":
        bins.place(x, 3)  # N(3) would grow to 2, so the second goes on the first: levels 6, then 9
    assert bins.n.tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1] or bins.n.sum() == bins.open


def test_powers():
    assert packing.powers(13) == [8, 4, 1] and packing.powers(0) == []


def test_histogram(docs, no_docs):
    tok = Tokenizer.from_file(vocabulary())
    own = [len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    got = token_counts.histogram(docs)
    rows = {r.length: r for r in got.collect()}
    assert rows.keys() == set(own)
    for n, r in rows.items():
        assert r.n_docs == own.count(n) and r.n_docs_at_least == sum(x >= n for x in own)
        assert r.tokens_up_to == sum(x for x in own if x <= n) and r.truncated_total == sum(min(x, n) for x in own)
    for limit in (1, 7, 100, 10**6):
        assert token_counts.truncated_total(got, limit).first().tokens == sum(min(x, limit) for x in own)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert token_counts.quantile(got, q).first().length == sorted(own)[max(0, int(np.ceil(q * len(own))) - 1)]
    assert token_counts.histogram(no_docs).collect() == []


def test_windows_stay_as_the_rule_fills_them():
    bins = packing.SumOfSquares(10)
    for x, s in (("a", 3), ("b", 8), ("c", 9)):
        bins.place(x, s)
    assert [*bins.fullest(1)] == [["c"], ["b"]] and bins.open == 1 and [*bins.fullest(0)] == [["a"]] and not bins.n.any()


def test_little_is_left_open(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = None
    for n in (1, 8, 32):
        pieces = packing.pack(docs.repartition(n, "doc_id"))
        r = pieces.selectExpr("sum(length) n", "sum(if(sequence_length = 2048, length, 0)) full", "count(distinct sequence_id) sequences").first()
        total = total or r.n
        assert r.n == total  # no id is lost, and there is no padding: sequence_length is the ids' number
        assert r.full > {1: 0.55, 8: 0.35, 32: 0.3}[n] * r.n and r.sequences < 3 * r.n / 2048, (n, r)
