"""Benchmark decontamination by latent semantic retrieval (operator 7).

1. Passages are pairs of neighbouring blocks of `BLOCK` words, over whole texts. One pass over the corpus
   gives, for each word of the benchmark, its document frequency over blocks and its row of the sketch
   A'S, where A is the passage-term matrix and S a sparse random sign matrix (each block goes to one of
   `SKETCH` columns, by a hash of the text and its number): the range finder of a randomised SVD. Other words can't add to a product with an item
   and are left out. Tasks send their non-zero sums; what is merged and read has the benchmark's size.
2. The sketch, weighted by inverse document frequency, and the items' own TF-IDF rows are stacked and
   orthogonalised; the leading `rank` directions are the latent space.
3. The second pass projects every passage that holds at least `MIN_HITS` weighted words, or as many as the item with the
   fewest has, and takes each item
   whose cosine is at least `cosine` as a candidate; there is no limit on their number.
4. A candidate is confirmed by the longest common subsequence of words between the item and any stretch of
   1.3 item lengths: at least `sure` of the item, or at least `close` if the item's answer (its own column, or
   else its last quarter) is there to at least `answered` in the same way. Each stretch is judged by itself, so
   what else a document holds doesn't matter; the best accepted one is reported.

Very frequent words weigh nothing, unless an item would be left with fewer than MIN_KEPT weighted words: then
its rarest words keep their weight.

Defined results: null or empty texts and items match nothing; a null doc_id is reported as null; a very long
text is searched as a whole, in portions of passages; of equally good stretches the first counts; repeated
rows are reported once per (doc_id, item_id) with their best values; items without words are ignored; an
empty corpus or benchmark gives no rows. `decontaminate` carries all columns along.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import mapped, text_key, texts, without

BLOCK, SKETCH, MIN_HITS, MIN_KEPT = 32, 128, 3, 6

_SEPARATORS = bytes(32 if b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) else b for b in range(256))


def words(t: bytes) -> list[bytes]:
    return t.lower().translate(_SEPARATORS).split()


def lcs(masks: dict[bytes, int], own: list[bytes], n: int) -> int:
    """Length of the longest common subsequence of `own` and the n words whose places `masks` has as bits."""
    full = (1 << n) - 1
    v = full
    for w in own:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Item:
    def __init__(self, item_id: int, own: list[bytes], answer: list[bytes]):
        self.id, self.words = item_id, own
        self.answer = answer or own[-max(4, len(own) // 4) :]
        self.masks, self.answer_masks = _masks(own), _masks(self.answer)

    def best(self, region: list[bytes], hit: np.ndarray, sure: float, close: float, answered: float) -> tuple[float, float] | None:
        """(share of the item, share of the answer) in the accepted stretch of `region` with the most of the item,
        None if no stretch is accepted. hit: which words are the item's. Stretches with too few hits for the
        least share are left out."""
        n, least = len(self.words), min(sure, close)
        span, best = max(n + 2, int(1.3 * n)), None
        sums = np.concatenate([[0], np.cumsum(hit)])
        starts = np.flatnonzero(hit)
        starts = starts[sums[np.minimum(starts + span, len(region))] - sums[starts] >= least * n]
        for i in starts.tolist():
            own = region[i : i + span]
            share = lcs(self.masks, own, n) / n
            if share < least or (best and share < best[0]):
                continue
            found = share, lcs(self.answer_masks, own, len(self.answer)) / len(self.answer)
            if (share >= sure or (share >= close and found[1] >= answered)) and (best is None or found > best):
                best = found
        return best


def _masks(own: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(own):
        out[w] = out.get(w, 0) | 1 << i
    return out


def read_items(items: DataFrame) -> list[Item]:
    """The benchmark: a table whose size doesn't grow with the corpus."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None)
    rows = items.select("item_id", "text", answer.cast("string").alias("answer")).orderBy("item_id", "text").collect()
    out = [Item(r.item_id, words((r.text or "").encode()), words((r.answer or "").encode())) for r in rows]
    return [x for x in out if x.words]


def _features(items: list[Item]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}


def sketch(docs: DataFrame, feature: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(blocks, document frequency per feature, sketch: features x SKETCH)."""
    n = max(feature.values()) + 1
    width = SKETCH + 1  # the last column is the document frequency
    held = docs.sparkSession.sparkContext.broadcast(feature)

    def run(it):
        get, total, blocks = held.value.get, np.zeros(n * width, np.int64), 0
        for b in it:
            fs, at, salts = [], [], []
            for t in texts(b.column(0)):
                own = words(t)
                f = np.fromiter(map(get, own, repeat(-1)), np.int32, len(own))
                place = np.flatnonzero(f >= 0)
                fs.append(f[place])
                at.append(place // BLOCK + blocks)
                salts.append(np.full(len(place), xxhash.xxh64_intdigest(t) - blocks & (1 << 64) - 1, np.uint64))
                blocks += -(-len(own) // BLOCK)
            f, at = np.concatenate(fs).astype(np.int64), np.concatenate(at)
            # by the text and the block's number in it, whatever rows a task has
            r = (np.concatenate(salts) + at.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            r = (r ^ r >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
            column, sign = (r >> np.uint64(40)).astype(np.int64) % SKETCH, np.where(r >> np.uint64(63), 1.0, -1.0)
            total += np.bincount(f * width + column, sign, n * width).astype(np.int64)
            once = np.unique(at * n + f) % n
            total[SKETCH::width] += np.bincount(once, minlength=n)
        k = np.flatnonzero(total)
        k, v = np.concatenate([k, [n * width]]), np.concatenate([total[k], [blocks]])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["k", "v"])

    # a row per cell: what tasks send is bounded by the benchmark's vocabulary times the sketch's width
    sums = docs.select("text").transform(mapped, run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(n * width + 1, np.int64)
    total[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    cells = total[:-1].reshape(n, width)
    return int(total[-1]), cells[:, SKETCH], cells[:, :SKETCH].astype(float)


class Space:
    """Latent vectors of words and items."""

    def __init__(self, items: list[Item], feature: dict[bytes, int], blocks: int, df: np.ndarray, cells: np.ndarray, rank: int, max_share: float = 0.02):
        n = len(df)
        idf = np.log((blocks + 1) / (df + 1))
        kept = df <= max_share * max(blocks, 1)
        for x in items:
            own = sorted({feature[w] for w in x.words}, key=lambda f: (-idf[f], f))
            kept[own[:MIN_KEPT]] = True
        weight = np.where(kept, np.maximum(idf, 0.1), 0.0)
        a = np.zeros((len(items), n))
        for i, x in enumerate(items):
            np.add.at(a[i], [feature[w] for w in x.words], 1)
        a = a * weight
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        rows = a if len(items) <= 1024 else np.random.default_rng(5).choice([-1.0, 1.0], (1024, len(items))) @ a / 32
        corpus = (cells * weight[:, None]).T
        corpus *= np.linalg.norm(rows) / 4 / max(np.linalg.norm(corpus), 1e-12)
        q, r = np.linalg.qr(np.vstack([rows, corpus]).T)
        u, _, _ = np.linalg.svd(r, full_matrices=False)
        basis = q @ u[:, :rank]
        self.words = (weight[:, None] * basis).astype(np.float32)
        own = a @ basis
        self.items = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.kept = weight > 0
        self.least = min(MIN_HITS, min(len({feature[w] for w in x.words}) for x in items))
        self.has = np.zeros((len(items), n + 1), bool)  # the last column: words of no item
        for i, x in enumerate(items):
            self.has[i, [feature[w] for w in x.words]] = True


def leaks(docs: DataFrame, items: DataFrame, rank: int = 224, cosine: float = 0.5, sure: float = 0.75, close: float = 0.6, answered: float = 0.75) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): confirmed pairs."""
    found = confirmed(docs, items, rank, cosine, sure, close, answered)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answer")))


def confirmed(docs: DataFrame, items: DataFrame, rank: int = 224, cosine: float = 0.5, sure: float = 0.75, close: float = 0.6, answered: float = 0.75) -> DataFrame:
    """(doc_id, text_key, item_id, cosine, common, answer): confirmed pairs of each row."""
    schema = "doc_id long, text_key long, item_id long, cosine double, common double, answer double"
    own_items = read_items(items)
    if not own_items:
        return docs.sparkSession.createDataFrame([], schema)
    feature = _features(own_items)
    space = Space(own_items, feature, *sketch(docs, feature), rank)
    held = docs.sparkSession.sparkContext.broadcast((own_items, feature, space))

    def run(it):
        own_items, feature, space = held.value
        get = feature.get
        for b in it:
            rows: list[tuple] = []
            for doc, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                own = words(t)
                found = search(own, np.fromiter(map(get, own, repeat(-1)), np.int32, len(own)), own_items, space, cosine, sure, close, answered)
                rows += [(doc, key, own_items[i].id, c, s, a) for i, (c, s, a) in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], ["doc_id", "text_key", "item_id", "cosine", "common", "answer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").transform(mapped, run, schema)


def search(own: list[bytes], f: np.ndarray, items: list[Item], space: Space, cosine: float, sure: float, close: float, answered: float) -> dict[int, tuple[float, float, float]]:
    """item number: (cosine, common, answer) of its best accepted passage in a document. f: the words' features,
    or -1."""
    place = np.flatnonzero((f >= 0) & space.kept[f])
    if len(place) < space.least:
        return {}
    block = place // BLOCK
    blocks, first = np.unique(block, return_index=True)
    vectors = np.add.reduceat(space.words[f[place]], first, axis=0)
    count = np.diff(np.append(first, len(place)))
    # passage k: block k and the next
    nxt = np.searchsorted(blocks, blocks + 1)
    joined = nxt < len(blocks)
    joined[joined] = blocks[nxt[joined]] == blocks[joined] + 1
    total, hits = vectors.copy(), count.copy()
    total[joined] += vectors[nxt[joined]]
    hits[joined] += count[nxt[joined]]
    enough = np.flatnonzero(hits >= space.least)
    found: dict[int, tuple[float, float, float]] = {}
    for a in range(0, len(enough), 4096):
        some = enough[a : a + 4096]
        v = total[some]
        c = (v @ space.items.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        for k, i in zip(*np.nonzero(c >= cosine), strict=True):
            at, n = int(blocks[some[k]]) * BLOCK, len(items[i].words)
            own_at = slice(max(0, at - n), at + 2 * BLOCK + n)
            best = items[i].best(own[own_at], space.has[i, f[own_at]], sure, close, answered)
            if best and (i not in found or best > found[i][1:]):
                found[i] = float(c[k, i]), *best
    return found


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the rows whose text holds a benchmark item."""
    return without(docs, confirmed(docs.select("doc_id", "text"), items))
