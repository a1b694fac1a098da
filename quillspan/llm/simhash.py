"""SimHash near-duplicates by tiled exact comparison (operator 10).

Fingerprints are taken from word shingles of whole texts. Distinct fingerprints are compared in tiles with
numpy's exclusive-or and bit counts; members are sorted by population count, so a tile pair whose counts
differ by more than the radius is skipped, as is one whose members are already known to be connected.

So that tiles don't have to be all of n^2 / 2, each fingerprint goes to the groups that any partner within
the radius must share with it:
* 64 bits at a radius of 3 or less: a pair agrees in one of four 16-bit blocks, and the other 48 bits in one of
  four 12-bit blocks: 16 groups under 28-bit keys, which lose no pair.
* wide fingerprints (8 words of 64 bits, of each text's distinct shingles) for a similarity such as 0.8, where
  the radius is too large for that: groups by bands of minimum hashes of the same shingles (16 bands of 3).
  Bands and a wide radius give candidates only. The shingle sets of each component of candidates are brought
  together, and a link is accepted by the exact Jaccard similarity of two sets.
A group of over `max_group` members is split into tile pairs that are dealt out as groups of their own.
Groups report spanning links only; components come from contraction of these links, see graph.py.

Defined results: null or empty text has the fingerprint zero, which links like any other; a null doc_id is
smaller than all others (component_id is then null); repeated rows share their fingerprint and component;
an empty table gives no rows; extra columns are carried along by `drop_duplicates` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import batches, cut, mapped, text_key, texts, without
from quillspan.llm.graph import components

TILE = 512
NO_ID = -(1 << 63)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_PERM = (np.random.default_rng(11).integers(1 << 62, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(t: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter."""
    words = t.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def _majority(h: np.ndarray) -> int:
    """Bits that are 1 in over half of h."""
    n = len(h)
    total = np.zeros(64, np.int64)
    raw = h.view(np.uint8).reshape(n, 8)
    for a in range(0, n, 255 * 256):
        part = raw[a : a + 255 * 256]
        full = len(part) // 255 * 255
        if full:
            total += np.unpackbits(part[:full], axis=1, bitorder="little").reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += np.unpackbits(part[full:], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint(h: np.ndarray, words: int = 1) -> list[int]:
    """`words` 64-bit words; the first is of the hashes themselves, others of mixed ones."""
    if not len(h):
        return [0] * words
    out = [_majority(h)]
    for m in _MIX[: words - 1]:
        x = h * m
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        x ^= x >> np.uint64(29)
        out.append(_majority(x))
    return out


def bands(h: np.ndarray, n: int = 16, rows: int = 3) -> list[int]:
    """Keys of n bands, each of `rows` minimum hashes of the shingle set."""
    if not len(h):
        return [0] * n
    h = np.unique(h)
    least = np.array([np.min((h * p) ^ ((h * p) >> np.uint64(31))) for p in _PERM[: n * rows]], np.uint64).reshape(n, rows)
    return [xxhash.xxh64_intdigest(bytes([i]) + least[i].tobytes()) >> 1 for i in range(n)]


def narrow_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 16) group keys of 64-bit fingerprints."""
    out = []
    for b in range(4):
        block = (fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << (16 * b)) - 1)
        rest = low | ((fp >> np.uint64(16 * (b + 1))) << np.uint64(16 * b) if b < 3 else np.uint64(0))
        for s in range(4):
            out.append(np.uint64(4 * b + s) << np.uint64(28) | block << np.uint64(12) | ((rest >> np.uint64(12 * s)) & np.uint64(0xFFF)))
    return np.column_stack(out).astype(np.int64)


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): sizes of the intersections of sets, by products of blocks of 0 and 1."""

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)

    (ra, ha), (rb, hb) = places(a), places(b)
    both = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(both), 2048):
        block = both[k : k + 2048]
        m = []
        for n, r, h in ((len(a), ra, ha), (len(b), rb, hb)):
            at = np.minimum(np.searchsorted(block, h), len(block) - 1)
            own = block[at] == h
            x = np.zeros((n, len(block)), np.float32)
            x[r[own], at[own]] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n >= similarity * (len(a) + len(b) - n)


def connect(fps: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> np.ndarray:
    """Component label (index of a member) of each row of `fps` (n, words). With `sets`, of distinct hashes, rows
    within the radius are linked only if their sets have the Jaccard similarity."""
    n = len(fps)
    label = np.arange(n)
    count = np.bitwise_count(fps).sum(1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order]
    if sets is not None:
        sets = [sets[i] for i in order.tolist()]
        size = np.array([len(x) for x in sets], np.int64)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            i, j = slice(a, min(a + TILE, n)), slice(b, min(b + TILE, n))
            if count[b] - count[i.stop - 1] > radius:
                break
            li, lj = label[i], label[j]
            if (li == li[0]).all() and (lj == li[0]).all():
                continue
            d = np.zeros((len(li), len(lj)), np.uint16)
            for w in range(fps.shape[1]):
                d += np.bitwise_count(fps[i, w][:, None] ^ fps[j, w][None, :])
            near = (d <= radius) & (li[:, None] != lj[None, :])
            if sets is not None:
                si, sj = size[i][:, None], size[j][None, :]
                near &= np.minimum(si, sj) >= similarity * np.maximum(si, sj)
            r, c = np.nonzero(near)
            if sets is not None and len(r):
                if len(r) <= 256:
                    own = np.fromiter((similar(sets[a + x], sets[b + y], similarity) for x, y in zip(r.tolist(), c.tolist(), strict=True)), bool, len(r))
                else:
                    ur, ri = np.unique(r, return_inverse=True)
                    uc, ci = np.unique(c, return_inverse=True)
                    both = common([sets[a + x] for x in ur.tolist()], [sets[b + y] for y in uc.tolist()])[ri, ci]
                    own = both >= similarity * (size[a + r] + size[b + c] - both)
                r, c = r[own], c[own]
            if not len(r):
                continue
            for code in np.unique(li[r] * n + lj[c]).tolist():
                x, y = find(code // n), find(code % n)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            label = _flatten(parent)[label]
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _flatten(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _links(it: Iterator[pa.RecordBatch], radius: int, max_group: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, fp) sorted by key -> (a, b, key, n): spanning links of each group, or of a group
    over max_group (if that isn't 0) only its key and size. Holds one group of up to max_group members."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
    key, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint64)
    over: list[int] = []  # key and members so far of a large group that is still coming

    def large(k: int, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, k, n)], schema=schema)

    def close(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        many = ends - starts > 1
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            if max_group and e - s > max_group:
                yield large(int(key[s]), e - s)
                continue
            label = connect(fp[s:e], radius)
            own = np.flatnonzero(label != np.arange(e - s))
            links.append((node[s:e][label[own]], node[s:e][own]))
        if links:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], schema=schema)

    for batch in it:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, width))
        if over and len(new[0]):
            n = int(np.searchsorted(new[0], over[0], "right"))
            over[1] += n
            new = tuple(x[n:] for x in new)
            if not len(new[0]):
                continue
            yield large(*over)
            over = []
        key, node, fp = (np.concatenate(x) for x in zip((key, node, fp), new, strict=True))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from close(key[:last], node[:last], fp[:last])
        key, node, fp = key[last:], node[last:], fp[last:]
        if max_group and len(key) > max_group:
            over = [int(key[0]), len(key)]
            key, node, fp = key[:0], node[:0], fp[:0]
    if over:
        yield large(*over)
    if len(key):
        yield from close(key, node, fp)


def link(groups: DataFrame, radius: int, width: int = 1, max_group: int = 16_384) -> DataFrame:
    """Spanning links (a, b) between nodes of `groups` (key, node, fp) that are within the radius."""
    schema = "a long, b long, key long, n long"
    step = lambda df, most: df.repartition("key").sortWithinPartitions("key").select("key", "node", "fp").transform(mapped, lambda it: _links(it, radius, most, width), schema)
    first = cut(step(groups, max_group))
    links, large = first.where("a is not null").select("a", "b"), first.where("key is not null").select("key", "n")
    if not large.limit(1).count():
        return links
    # tiles of about max_group / 2 by a hash of the node; each pair of tiles is a group
    dealt = groups.join(large, "key").withColumn("k", F.ceil(F.col("n") * 2 / max_group).cast("int"))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")).alias("key"), "node", "fp")
    return links.unionByName(step(dealt, 0).select("a", "b"))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, node, fp): fp as little-endian bytes, and node the same as a number."""

    def run(b: pa.RecordBatch) -> dict:
        fps = [np.array(fingerprint(shingle_hashes(t, shingle, seed)), np.uint64).tobytes() for t in texts(b.column(1))]
        return {"doc_id": b.column(0), "node": np.frombuffer(b"".join(fps), "<i8"), "fp": pa.array(fps, pa.binary())}

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, node long, fp binary")


def wide_fingerprints(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, node, n, fp, keys) of each text's set of shingles: node stands for the set, n is its size."""

    def run(b: pa.RecordBatch) -> dict:
        own = [np.unique(shingle_hashes(t, shingle, seed)) for t in texts(b.column(2))]
        return {
            "doc_id": b.column(0),
            "text_key": b.column(1),
            "node": np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in own], np.uint64).view(np.int64),
            "n": np.array([len(h) for h in own], np.int64),
            "fp": pa.array([np.array(fingerprint(h, WIDE), np.uint64).tobytes() for h in own], pa.binary()),
            "keys": pa.array([bands(h) for h in own], pa.list_(pa.int64())),
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return batches(own, run, "doc_id long, text_key long, node long, n long, fp binary, keys array<long>")


def _narrow_groups(distinct: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        node = b.column(0).to_numpy()
        keys = narrow_keys(node.view(np.uint64)).ravel()
        own = np.repeat(np.arange(len(node)), 16)
        return {"key": keys, "node": node[own], "fp": b.column(1).take(pa.array(own))}

    return batches(distinct.select("node", "fp"), run, "key long, node long, fp binary")


def clusters(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, max_group: int = 16_384) -> DataFrame:
    """(doc_id, node, fp, component_id): documents linked within the radius, by chains of links."""
    if radius > 3:
        raise ValueError("64-bit fingerprints are grouped for a radius of 3 at most")
    rows = cut(fingerprints(docs, shingle, seed))
    distinct = cut(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")))
    return _named(rows, distinct, link(_narrow_groups(distinct), radius, 1, max_group)).select("doc_id", "node", "fp", "component_id")


def _named(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` (doc_id, node, ...) with component_id, the smallest doc_id that `links` (a, b) reach."""
    tree = components(links)
    own = distinct.select("node", "least").join(tree.withColumnRenamed("v", "node"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(least, "root").select("node", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))
    return rows.join(own, "node")


#: 512 bits; a pair of similarity s differs in about acos(2s / (1 + s)) / pi of them.
WIDE = 8
#: Shingles of a component that are compared in one task; larger ones are split into tile pairs.
MAX_SHINGLES = 4_000_000


def candidate_radius(similarity: float, slack: float = 0.35) -> int:
    """Bits of a wide fingerprint that differ at a shingle Jaccard similarity `slack` below the one wanted. At 0.8
    these are 146: 8 standard deviations over the mean of long texts, and 5.6 over that of sets of 5 and 4
    shingles, which differ in the most bits (3 of 16)."""
    s = max(similarity - slack, 0.0)
    return int(np.arccos(2 * s / (1 + s)) / np.pi * 64 * WIDE)


def _confirmed(it: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, fp, hashes) sorted by (key, node) -> (a, b): spanning links of each group. Holds one group."""
    key, node, fps, sets = None, [], [], []
    a, b = [], []

    def close() -> None:
        if len(node) > 1:
            label = connect(np.frombuffer(b"".join(fps), "<u8").reshape(-1, WIDE), radius, sets, similarity)
            for i in np.flatnonzero(label != np.arange(len(node))).tolist():
                a.append(node[label[i]])
                b.append(node[i])
        node.clear(), fps.clear(), sets.clear()

    for batch in it:
        for k, v, fp, h in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                close()
                key = k
            if not node or node[-1] != v:  # else a repeated row
                node.append(v), fps.append(fp), sets.append(np.frombuffer(h, "<u8"))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear(), b.clear()
    close()
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm(docs: DataFrame, distinct: DataFrame, links: DataFrame, shingle: int, similarity: float, radius: int, seed: int = 42, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """Spanning links (a, b) of nodes whose sets have the similarity. Candidates are the nodes of `distinct` (node, n,
    fp, at: a row's doc_id and text_key) that `links` connect; only their texts are read again."""
    members = cut(distinct.join(components(links).withColumnRenamed("v", "node"), "node").select("root", "node", "n", "fp", "at"))
    parts = members.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.when(F.col("total") > max_shingles, F.ceil(F.col("total") * 2 / max_shingles)).otherwise(1).cast("int").alias("k"))
    asked = members.join(parts, "root").select("root", "node", "fp", "k", F.col("at.doc").alias("doc"), F.col("at.text_key").alias("text_key"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"), "text")
    found = own.join(asked, ["doc", "text_key"]).select("root", "node", "fp", "k", "text")

    def run(b: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(t, shingle, seed)).tobytes() for t in texts(b.column(4))]
        return {"root": b.column(0), "node": b.column(1), "fp": b.column(2), "k": b.column(3), "hashes": pa.array(sets, pa.binary())}

    sets = batches(found, run, "root long, node long, fp binary, k int, hashes binary")
    # tiles by a hash of the node; each pair of tiles is a group
    dealt = sets.withColumn("t", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("root", F.least("t", "u"), F.greatest("t", "u")).alias("key"), "node", "fp", "hashes")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "node")
    return dealt.transform(mapped, lambda it: _confirmed(it, radius, similarity), "a long, b long")


def near_clusters(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_group: int = 16_384, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """(doc_id, text_key, component_id): documents linked by the similarity of their shingle sets, by chains of links."""
    rows = cut(wide_fingerprints(docs, shingle))
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key")).alias("at")
    distinct = cut(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n"), at).withColumn("least", F.col("at.doc")))
    radius = candidate_radius(similarity)
    links = link(distinct.select(F.explode("keys").alias("key"), "node", "fp"), radius, WIDE, max_group)
    sure = confirm(docs, distinct, links, shingle, similarity, radius, max_shingles=max_shingles)
    return _named(rows.select("doc_id", "text_key", "node"), distinct, sure).select("doc_id", "text_key", "component_id")


def drop_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_group: int = 16_384) -> DataFrame:
    """`docs` with one row, of the smallest doc_id, for each group of near-duplicates.

    A null doc_id is the smallest. Of repeated rows under that doc_id all stay, as no column tells them
    apart, and so do near-duplicates under that doc_id itself; of different texts under one doc_id, each stays or
    goes by its own group."""
    found = near_clusters(docs, shingle, similarity, max_group)
    return without(docs, found.where("not (doc_id <=> component_id)"))
