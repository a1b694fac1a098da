"""Planted benchmark passages are found, clean documents are not; LCS by brute force."""

import random

from conftest import DOCS, MANY
from conftest import prose as some_prose
from conftest_rows import as_rows

from quillspan.llm import decontam

ITEM = "item_id long, text string"
ASCII = [w for w in MANY if w.isascii()]


def prose(rng, n):
    return some_prose(rng, n, ASCII)


def planted(rng):
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(40)]
    rows, want = [], set()
    for i in range(300):
        rows.append((i, prose(rng, rng.randint(20, 400)), "en", "a", 1))
    for k, (i, t) in enumerate(items):
        w = t.split()
        rows.append((1000 + k, f"{prose(rng, 100)} {t} {prose(rng, 50)}", "en", "a", 1))
        want.add((1000 + k, i))
        for _ in range(max(1, len(w) // 12)):
            w[rng.randrange(len(w))] = "paraphrased"
        rows.append((2000 + k, f"{prose(rng, 30)} {', '.join(w).upper()} {prose(rng, 900)}", "en", "a", 1))
        want.add((2000 + k, i))
    return items, rows, want


def test_planted_passages(spark):
    items, rows, want = planted(random.Random(3))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEM)).collect()}
    assert got == want


def test_decontaminate_keeps_clean_rows(spark, docs, clashing, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again says line shared"), (2, None), (3, ""), (None, "words of an item that has no id at all")], ITEM)
    kept = decontam.decontaminate(docs, items)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == set(range(40, 47))
    assert as_rows(decontam.decontaminate(clashing, items).select("doc_id", "text")) == as_rows(kept.select("doc_id", "text"))
    assert decontam.decontaminate(no_docs, items).collect() == []
    assert as_rows(decontam.decontaminate(docs, items.limit(0))) == as_rows(docs)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontam.lcs(decontam._masks(a), b, len(a)) == row[-1]


def test_each_stretch_is_judged_by_itself(spark):
    rng = random.Random(5)
    own = rng.sample(sorted(set(ASCII)), 400)
    other = sorted(set(ASCII) - set(own))  # no word of an item by chance
    prose = lambda rng, n: some_prose(rng, n, other)
    items, rows = [], [(i, prose(rng, 200), "en", "a", 1) for i in range(100)]
    for k in range(10):
        w = own[40 * k : 40 * k + 40]  # the answer is the last quarter
        items.append((k, " ".join(w)))
        question, answer = " ".join(w[:29]), " ".join(w[30:])
        both = f"{' '.join(w[:15])} {prose(rng, 8)} {answer}"
        # 0.725 without the answer in one place, 0.625 with it in another
        rows.append((1000 + k, f"{question} {prose(rng, 300)} {both} {prose(rng, 50)}", "en", "a", 1))
        rows.append((2000 + k, f"{both} {prose(rng, 300)} {question} {prose(rng, 50)}", "en", "a", 1))
        # a paraphrase of over 1.3 lengths: 0.65 without the answer first, then 0.6 with it
        rows.append((3000 + k, f"{' '.join(w[:26])} {prose(rng, 28)} {answer} {prose(rng, 200)}", "en", "a", 1))
        rows.append((4000 + k, f"{prose(rng, 50)} {question} {prose(rng, 300)}", "en", "a", 1))  # never the answer
    found = decontam.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(a + k, k) for a in (1000, 2000, 3000) for k in range(10)}
    assert all(0.6 <= r.common < 0.75 <= r.answer for r in found)


def test_results_do_not_depend_on_the_file_layout(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    one, nine = (sorted((r.doc_id, r.item_id, round(r.cosine, 4)) for r in decontam.leaks(docs.repartition(n), items).collect()) for n in (1, 9))
    assert one and one == nine


def test_item_of_two_words_is_found(spark):
    items = spark.createDataFrame([(1, "zyxw vutsr"), (2, "one long item about rivers lakes mountains valleys forests")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text of other words with zyxw vutsr in it"), (2, "some text of other words")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()] == [(1, 1)]
