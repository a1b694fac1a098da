"""Rule statistics by brute force; the forest's order and the threshold's guard."""

import re
from collections import Counter

import numpy as np
from conftest_rows import as_rows

from quillspan.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if at[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_statistics(spark, docs, save):
    extra = spark.createDataFrame([(200, "a b c d e a b c d e # <|>"), (201, "x " * 50), (202, "a\na\n \n \nb\r\nb\r\n\x1c\x85 \xa0")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    d = save(documents=both, labels=spark.createDataFrame([(60, 1), (61, 0), (62, 1), (63, None)], "doc_id long, quality int"))
    got = queries.op9_quality_rules(spark, d).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key([(r.doc_id, *(r[c] for c in quality.STATS)) for r in got]) == key([(r.doc_id, *brute(r.text)) for r in both.collect()])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 3))
    forest = quality.IsolationForest(rows, 64, 128)
    s = forest.score(np.vstack([np.zeros((1, 3)), np.full((1, 3), 8.0)]))
    assert s[1] > s[0] + 0.1 and (0 < s).all() and (s < 1).all()
    assert (quality.IsolationForest(rows[:1], 8, 16).score(rows[:2]) == 0.5).all()


def test_good_rows_stay(spark):
    got = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = got.join(labels.where("quality = 1"), "doc_id")
    assert good.where("kept").count() >= 0.98 * good.count()


def test_odd_rows(spark, docs, no_docs, clashing):
    labels = spark.createDataFrame([(60, 1), (61, 0), (None, 1)], "doc_id long, quality int")
    assert quality.judge(no_docs, labels).collect() == []
    none = quality.judge(docs, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0
    names = ("doc_id", *quality.STATS, "base_failed", "kept")
    assert as_rows(quality.judge(clashing, labels.limit(0)).select(*names)) == as_rows(none.select(*names))
