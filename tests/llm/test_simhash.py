"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash
from conftest import DOCS, prose
from conftest_rows import as_rows

from quillspan.llm import graph, queries, simhash

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    own = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    rank = lambda d: -(1 << 63) if d is None else d
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), 1 << 63), rank(d))
    return [None if least[find(i)] == -(1 << 63) else least[find(i)] for i in range(len(ids))]


def test_query(spark, docs, save):
    d = save(documents=docs)
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{x:016x}" for x in fps], slow_components([r.doc_id for r in rows], fps), strict=True), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, d).collect()), key=str) == want


def test_links_of_random_fingerprints(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    node = np.array(fps, np.uint64).view(np.int64)
    frame = spark.createDataFrame([(int(n), np.uint64(f).tobytes()) for n, f in zip(node, fps, strict=True)], "node long, fp binary")
    want = slow_components(node.tolist(), fps)
    for most in (16_384, 4):  # whole groups, and groups split into tile pairs
        tree = graph.components(simhash.link(simhash._narrow_groups(frame), 3, 1, most))
        root = {r.v: r.root for r in tree.collect()}
        label = [root.get(n, n) for n in node.tolist()]
        assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(299) if i != 150] + [(5000, 5000)]
    root = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {root[n] for n in names[:151]} == {min(names[:151])} and {root[n] for n in names[151:]} == {min(names[151:])}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = prose(rng, 150).split()
        rows.append((i, " ".join(words), "en", "a", 1))
        words[rng.randrange(150)] = "changed"  # Jaccard of 5-word shingles over 0.9
        rows.append((1000 + i, " ".join(words), "en", "a", 1))
        rows.append((2000 + i, " ".join(words[:75] + prose(rng, 75).split()), "en", "a", 1))  # about a third in common
    kept = {r.doc_id for r in simhash.drop_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(60)) | set(range(2000, 2060))


def test_odd_rows(no_docs, clashing, docs):
    assert simhash.clusters(no_docs).collect() == [] and simhash.drop_duplicates(no_docs).collect() == []
    assert as_rows(simhash.clusters(clashing)) == as_rows(simhash.clusters(docs))
    assert as_rows(simhash.drop_duplicates(clashing).select("doc_id", "text")) == as_rows(simhash.drop_duplicates(docs).select("doc_id", "text"))


def test_many_hashes_and_ties():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200_001, dtype=np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert simhash._majority(h) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(h))
    assert simhash._majority(np.array([1, 2], np.uint64)) == 0


def test_repeats_do_not_part_equal_sets(spark):
    rng = random.Random(9)
    rows = []
    for i in range(20):
        head, line, tail = (prose(rng, n) for n in (90, 12, 55))
        rows += [(1000 * k + i, " ".join([head, *[line] * n, tail]), "en", "a", 1) for k, n in enumerate((2, 12))]
    kept = {r.doc_id for r in simhash.drop_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(20))


def jaccard(a, b):
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def varied(rng, s, n=160):
    """Texts whose shingle Jaccard is s at least, but hardly more, and just below s."""
    words = prose(rng, n).split()
    text, last = " ".join(words), None
    for i in range(n - 1, 0, -1):  # other words from the end on
        words[i] = f"other{i}"
        if jaccard(text, " ".join(words)) < s:
            return text, last, " ".join(words)
        last = " ".join(words)


def test_links_by_exact_similarity(spark):
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(60):
        text, enough, less = varied(rng, 0.8, 30 + 5 * i)
        other, _, far = varied(rng, 0.8, 30 + 5 * i)
        rows += [(i, text), (1000 + i, enough), (2000 + i, other), (3000 + i, far)]
        want |= {i, 2000 + i, 3000 + i}
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOCS)
    assert {r.doc_id for r in simhash.drop_duplicates(docs).collect()} == want
    # every component split into tile pairs
    kept = {r.doc_id for r in simhash.near_clusters(docs, max_shingles=100).where("doc_id <=> component_id").collect()}
    assert kept == want


def test_set_products():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(0, 900), dtype=np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:20]]
    assert (simhash.common(sets[:20], sets[20:]) == want).all()
