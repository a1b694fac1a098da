"""Removal of lines that many documents share (operator 2).

Pass 1 hashes each document's distinct line keys into two Bloom filters, once-seen and twice-seen. Tasks
send the bit positions they set, by block; merging a block keeps `twice |= once & new`. The filters have a
fixed number of bits (`bits`, 16 MB each by default), whatever the corpus: more lines only mean more
suspects. Pass 2 looks every key up in the twice-seen filter; suspects alone are shuffled, as 128-bit hashes
with their doc_id, to count documents exactly and choose the one that keeps the line. Pass 3 drops lines:
the keys to drop are broadcast up to `max_broadcast` of them (24 bytes each), and beyond that reach the
documents by a join on doc_id.

Defined results: null or empty text is one empty line; a null doc_id counts as one document, smaller than
all others; rows that repeat a doc_id count as one document but are all returned; an empty table gives no
rows. Input columns are carried along, but columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import SPACE, cut, fresh, mapped, texts

BLOCK_BITS = 1 << 17
NO_ID = -(1 << 63)


def key(line: bytes, least: int = 40) -> bytes | None:
    """The line's key; None if it has fewer than `least` code points."""
    k = line.strip(SPACE)
    if len(k) < least or (not k.isascii() and len(k.decode("utf-8", "replace")) < least):
        return None
    return k.lower()  # of bytes: A-Z only


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions per hash, shape (n, 2)."""
    return h.view(np.uint64) & np.uint64(bits - 1)


def _sets(docs: DataFrame, bits: int, least: int, flush: int = 1 << 20) -> DataFrame:
    """(block, once, twice): positions within a block that a task sets, as uint32 bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held), axis=0, return_counts=True) if len(held) else (np.empty((0, 2), np.int64), np.empty(0, int))
            sets = [np.unique(_positions(x, bits)) for x in (h, h[count > 1])]
            rows = []
            cuts = [np.searchsorted(s, np.arange(0, bits + 1, BLOCK_BITS, dtype=np.uint64)) for s in sets]
            for b in np.unique(sets[0] // np.uint64(BLOCK_BITS)).astype(int):
                rows.append((b, *((s[c[b] : c[b + 1]] - np.uint64(b * BLOCK_BITS)).astype("<u4").tobytes() for s, c in zip(sets, cuts, strict=True))))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "once", "twice"])

        for batch in it:
            keys: list[bytes] = []
            for t in texts(batch.column(0)):
                keys += {k for x in t.split(b"\n") if (k := key(x, least)) is not None}
            if keys:
                held.append(_hashes(keys))
                n += len(keys)
            if n >= flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return docs.select("text").transform(mapped, run, "block int, once binary, twice binary")


def twice_seen(docs: DataFrame, bits: int = 1 << 27, least: int = 40) -> bytes:
    """The merged twice-seen filter. Its size is `bits` / 8 for any corpus."""

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in it:
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b not in once:
                    once[b], twice[b] = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                p = np.frombuffer(x, "<u4")
                twice[b][p[once[b][p]]] = True
                once[b][p] = True
                twice[b][np.frombuffer(y, "<u4")] = True
        if once:
            k = [b for b in once if twice[b].any()]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([np.packbits(twice[b]).tobytes() for b in k], pa.binary())], ["block", "bits"])

    n = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bits // BLOCK_BITS)
    out = bytearray(bits // 8)
    for r in _sets(docs, bits, least).repartition(n, "block").transform(mapped, merge, "block int, bits binary").toLocalIterator():
        out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = r.bits
    return bytes(out)


def _line_keys(batch_texts: list[bytes], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(lines of each text, hash of each line with a key, its (text, line) numbers)."""
    lines, keys, at = [], [], []
    for i, t in enumerate(batch_texts):
        own = t.split(b"\n")
        lines.append(own)
        for j, x in enumerate(own):
            if (k := key(x, least)) is not None:
                keys.append(k)
                at.append((i, j))
    h = _hashes(keys) if keys else np.empty((0, 2), np.int64)
    return lines, h, np.asarray(at, np.int64).reshape(-1, 2)


def suspects(docs: DataFrame, bits: int = 1 << 27, least: int = 40) -> DataFrame:
    """(doc_id, k1, k2) of each line key that the twice-seen filter knows, once per document row."""
    seen = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, least))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.frombuffer(seen.value, np.uint8)
        for batch in it:
            _, h, at = _line_keys(texts(batch.column(1)), least)
            p = _positions(h, bits)
            hit = ((f[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            if hit.any():
                ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                rows = np.unique(np.column_stack([at[hit, 0], h[hit]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["doc_id", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, run, "doc_id long, k1 long, k2 long")


def dedup_lines(docs: DataFrame, min_docs: int = 5, least: int = 40, bits: int = 1 << 27, max_broadcast: int = 1_000_000) -> DataFrame:
    """`docs` with shared lines gone from `text`, plus n_lines (before) and n_dropped."""
    found = cut(suspects(docs, bits, least))
    shared = found.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    shared = cut(shared)
    docs = docs.drop("n_lines", "n_dropped")
    if shared.count() <= max_broadcast:
        return _apply(docs, _broadcast_drops(shared, least), "", least)
    key_cols = [F.col("k1"), F.col("k2")]
    drops, own = fresh(docs, "_drops"), fresh(docs, "_key")
    by_doc = found.distinct().join(shared, ["k1", "k2"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct(*key_cols)).alias(drops))
    joined = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(by_doc, own, "left").drop(own)
    return _apply(joined, None, drops, least)


def _broadcast_drops(shared: DataFrame, least: int):
    rows = shared.orderBy("k1", "k2").toArrow()
    cols = [np.ascontiguousarray(rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)) if rows.num_rows else np.empty(0, np.int64) for c in ("k1", "k2", "keeper")]
    return shared.sparkSession.sparkContext.broadcast(cols)


def _apply(docs: DataFrame, drops, column: str, least: int) -> DataFrame:
    """`drops`: sorted keys and who keeps them, broadcast; or None, and `column` has each document's keys to drop."""
    fields = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in schema.fields]

    def dropped(batch: pa.RecordBatch, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        if drops is not None:
            k1, k2, keeper = drops.value
            out = np.zeros(len(h), bool)
            if not len(k1) or not len(h):
                return out
            ids = batch.column(batch.schema.names.index("doc_id")).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            i = np.searchsorted(k1, h[:, 0])
            while True:  # further rounds only where two keys share their first half
                ok = i < len(k1)
                same = np.zeros(len(h), bool)
                same[ok] = k1[i[ok]] == h[ok, 0]
                if not same.any():
                    return out
                hit = same.copy()
                hit[same] = k2[i[same]] == h[same, 1]
                out[hit] = keeper[i[hit]] != ids[at[hit, 0]]
                i = np.where(same, i + 1, len(k1))
        own = [{(d["k1"], d["k2"]) for d in x or []} for x in batch.column(batch.schema.names.index(column)).to_pylist()]
        return np.fromiter(((int(a), int(b)) in own[i] for (a, b), i in zip(h, at[:, 0], strict=True)), bool, len(h))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lines, h, at = _line_keys(texts(batch.column(batch.schema.names.index("text"))), least)
            gone = dropped(batch, h, at)
            n_dropped = np.bincount(at[gone, 0], minlength=batch.num_rows)
            n_lines = [len(x) for x in lines]
            for i, j in at[gone]:
                lines[i][j] = None
            kept = [b"\n".join(x) if not n else b"\n".join(y for y in x if y is not None) for x, n in zip(lines, n_dropped, strict=True)]
            out = {n: batch.column(batch.schema.names.index(n)) for n in batch.schema.names if n != column}
            out |= {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return docs.transform(mapped, run, schema)
