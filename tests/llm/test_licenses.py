"""Licence scan: base columns by brute force, the automaton by brute-force matching statistics."""

import random
import re

import numpy as np
from conftest_rows import as_rows

from quillspan.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def base(text):
    own = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for p, label in licenses.PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    return len(own), len(found), min((x for x, _ in found), default=None), max((x for x, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(2)
    full = [x for _, x in licenses.TEMPLATES.values()]
    return ["MIT License", "the mit  LICENSE; Apache-License 2. general\npublic\tlicense mit license", "GENERAL PUBLIC", *full, *(f"int main() {{}}\n// {x.replace(' ', chr(10) + '// ')}\nreturn" for x in full), "é" * 10 + "mit licenseé", "mit\x7flicense", " ".join(rng.choice("mit license apache general public the of".split()) for _ in range(3000)), "ordinary prose about a dog"]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")


def test_base_columns(spark, docs, save):
    d = save(documents=docs.select("doc_id", "text").unionByName(frame(spark)))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op8_license_scan(spark, d).collect()), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()), key=str)


def test_templates_are_found(spark):
    rows = licenses.scan(frame(spark)).orderBy("doc_id").collect()
    names = list(licenses.TEMPLATES)
    for i, n in enumerate(names):
        for r in (rows[3 + i], rows[3 + len(names) + i]):
            span = next(s for s in r.spans if s.label == n)
            assert n in r.labels.split(",") and (span.coverage > 0.95 or r.doc_id >= 3 + len(names))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
            assert 0 <= r.score <= 1
    assert rows[-1].labels == "" and rows[-1].spans == []


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(30):
        seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(3)]
        tokens = [rng.randrange(5) for _ in range(60)]
        inside = lambda own: any(s[i : i + len(own)] == own for s in seqs for i in range(len(s)))
        stat = [max(n for n in range(e + 1) if not n or inside(tokens[e - n : e])) for e in range(1, len(tokens) + 1)]
        want = [(e, n) for e, n in enumerate(stat, 1) if n >= 2 and (e == len(tokens) or stat[e] <= n)]
        auto = licenses.SuffixAutomaton(seqs)
        got = auto.matches(tokens, 2)
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            assert auto.ends[state] == [(k, i + n) for k, s in enumerate(seqs) for i in range(len(s)) if s[i : i + n] == tokens[e - n : e]]


def test_no_rows_and_clashing_columns(no_docs, clashing, docs):
    assert licenses.scan(no_docs).collect() == []
    assert as_rows(licenses.scan(clashing).drop("spans")) == as_rows(licenses.scan(docs).drop("spans"))


def test_every_place_of_a_match_counts():
    rng = random.Random(8)
    filler = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    once = "alpha beta gamma delta"
    template = f"{filler(6)} {once} {filler(8)} {once} {filler(6)}"  # 28 words
    scanner = licenses.Scanner({"own": (0.1, template)})
    own = licenses.words(f"{once} {once}".encode())
    ((label, coverage, first, end),) = scanner.spans(np.array([scanner.vocabulary.get(w, -1) for w in own], np.int32))
    assert (label, round(coverage * 28), first, end) == ("own", 8, 0, 8)


def test_chain_looks_back_beyond_many_matches():
    own = [(10, 8, 8)] + [(20, 4, 4 + k) for k in range(100)] + [(30, 8, 200)]
    assert licenses.Scanner._chain(own, 200)[0] == max(8 + 4 + 8, 16) / 200
