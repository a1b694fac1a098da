"""Suffix dedup against a brute-force search of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from quillspan.llm import queries, suffix_dedup

SPAN = 100


def brute(rows):
    """rows: distinct (doc_id, bytes); a doc_id's texts in the order of their hash count as several documents."""
    first, gone = {}, []
    for i, (_, t) in enumerate(rows):
        for a in range(len(t) - SPAN + 1):
            first.setdefault(t[a : a + SPAN], (i, a))
    for i, (doc, t) in enumerate(rows):
        m = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - SPAN + 1):
            if first[t[a : a + SPAN]] != (i, a):
                m[a : a + SPAN] = True
        gone.append((doc, len(t), int(m.sum()), int((m[1:] < m[:-1]).sum()), hashlib.sha256(bytes(c for c, g in zip(t, m, strict=False) if not g)).hexdigest()))
    return sorted(gone, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(spark, save, rows, parts=3):
    d = save(documents=frame(spark, rows).repartition(parts))
    got = sorted(map(tuple, queries.op6_suffix_dedup(spark, d).collect()), key=str)
    want = brute(sorted(((x, (t or "").encode()) for x, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == want


def test_fixture(spark, docs, save):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").dropDuplicates().collect() if len(r.text or "") < 60_000]
    check(spark, save, rows)


def test_long_text(spark, save):
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh") for _ in range(700))
    long = "".join(rng.choice("abc é") for _ in range(200_000))
    check(spark, save, [(1, long + part), (2, part + long[:150_000]), (3, part * 3)])


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats(spark, save, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab"[: 1 + seed % 2] + "cd") for _ in range(rng.randint(60, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else "xyzé"[rng.randrange(4)] * rng.randint(1, 150) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    check(spark, save, rows)


def test_runs_of_one_byte(spark, save):
    check(spark, save, [(1, "a" * 99), (2, "a" * 100), (3, "a" * 101), (4, "a" * 5000), (5, "ab" * 300), (6, "b" * 50 + "a" * 250 + "b" * 50), (7, None), (8, "")])


@pytest.mark.parametrize("parts", [1, 6])
def test_crowded_anchors(spark, save, parts):
    rng = random.Random(7)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = own(150)
    rows = [(i, own(rng.randint(0, 130)) + (shared[rng.randint(0, 20) : 150 - rng.randint(0, 20)] if i % 4 else shared) + own(rng.randint(0, 130))) for i in range(150)]
    check(spark, save, rows + [(1000 + i, own(200)) for i in range(40)] + [(2000, rows[3][1]), (2001, shared)], parts)


def test_firsts_over_any_batches():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = 40
        h = rng.integers(1, 7, n)
        cols = [h, rng.integers(1, 4, n), rng.integers(0, 5, n), np.zeros(n, np.int64), rng.integers(0, 3, n) << 8 | 5]
        marks = np.unique(rng.integers(1, 12, rng.integers(0, 3)))
        cols = [np.concatenate([x, m]) for x, m in zip(cols, (marks, np.full(len(marks), suffix_dedup.NO_ID), *[np.zeros(len(marks), np.int64)] * 3), strict=True)]
        cols = [x[np.lexsort(cols[::-1])] for x in cols]
        got, firsts = [], suffix_dedup._Firsts(False)
        cuts = [0, *sorted(rng.integers(0, len(cols[0]), 3).tolist()), len(cols[0])]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for out in firsts.rows([x[a:b].copy() for x in cols]):
                got += list(zip(*(out.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True))
        rows = sorted({(x, y, d, at) for x, y, d, at in zip(*(cols[i].tolist() for i in (0, 1, 2, 4)), strict=True) if at & 255})
        first = {}
        for r in rows:
            first.setdefault(r[:2], r)
        several = {x for x in h.tolist() if len({k for k in first if k[0] == x}) > 1 or x in marks}
        want = [(0, 0, *r[2:]) for r in rows if first[r[:2]] != r] + [(*r[:3], r[3] | suffix_dedup.HOT * int(r[0] in marks)) for r in first.values() if r[0] in several]
        assert sorted(set(got)) == sorted(set(want))
        assert len([x for x in got if x[0]]) == len({x for x in got if x[0]})


def test_large_anchor_goes_by_window(spark, save, monkeypatch):
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefghij") for _ in range(90))
    rows = [(i, f"{rng.random()}{core}{rng.randint(0, 30)}{rng.random()}" + core[:40] * rng.randint(0, 5)) for i in range(80)]
    plain, hot = suffix_dedup.remove_repeats(frame(spark, rows)), None
    want = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(suffix_dedup, "MAX_BLOCK", 600)
    # the workers see the parameter through the closure of the module under test
    hot = list(suffix_dedup._merge(iter(_batches(rows))))
    assert hot and any((b.column(0).to_numpy() != 0).any() for b in hot)
    assert want
    check(spark, save, rows)


def _batches(rows):
    import pyarrow as pa

    own = [(7, i, 0, 0 << 8 | (len(t) - SPAN + 1), t.encode()) for i, t in rows if len(t) >= SPAN]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)], ["h", "doc", "th", "at", "context"])


def test_repeated_rows_and_shared_ids(spark, docs, no_docs, clashing):
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    got = suffix_dedup.remove_repeats(frame(spark, [(1, a), (1, a), (1, b), (2, a), (None, b)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("1", 400), ("2", 400), ("None", 0)]
    assert suffix_dedup.remove_repeats(no_docs).collect() == []
    key = lambda df: sorted((str(r.doc_id), bytes(r.kept), r.n_removed) for r in df.collect())
    assert key(suffix_dedup.remove_repeats(clashing)) == key(suffix_dedup.remove_repeats(docs))


def test_merge_repeats():
    own = [b"x" * 3 + b"q" * 120, b"q" * 130]
    order = np.arange(253)
    got = suffix_dedup.merge_repeats(own, order)
    assert got[:4].tolist() == [False] * 4 and got[4:24].all() and got[123 : 123 + 31].all() and not got[154:].any()
