"""Removal of repeated 100-byte strings by merged Burrows-Wheeler transforms (operator 6).

1. Anchors. Every window of SPAN bytes has an anchor: its GRAM-byte string of least hash, the leftmost of
   equals. Equal windows have equal anchors at equal offsets, so only windows of one anchor hash have to be
   compared. Neighbouring windows with the same anchor form one context (the bytes that they cover). Copies
   of a context within a task are known to be repeats at once and only its first place is shuffled, by
   anchor hash; of equal contexts from several tasks all but the first place are repeats.
2. Contexts of one anchor hash that differ may still share windows. Their bytes are fetched from the
   documents and go, grouped by anchor hash, into blocks. A block's contexts are dealt to shards; each
   shard's suffixes are sorted and give its transform, here with symbols of 8 bytes. The transforms are
   merged by iterative interleave refinement (Holt and McMillan): starting from the order of the first 4
   bytes, each round re-deals the interleave by the next symbol, which lengthens the settled prefix by 8 bytes
   without sorting suffixes anew; 12 rounds settle 100 bytes. A place where neighbours first differ in round
   r has a common prefix shorter than 4 + 8r; runs without such a place are the repeated intervals, and all
   their windows but the first are repeats.
3. An anchor in a passage that very many documents share has about as many contexts as they are. A task that
   meets many different ones of an anchor deals them out by context, not by anchor, and sends a mark; the other
   tasks' contexts of marked anchors join them. Their windows go, as 128-bit hashes, to an aggregation with partial
   sums, and so do those of a single anchor whose contexts exceed MAX_BLOCK bytes.
4. The repeats' byte ranges meet their documents, and covered bytes are removed.

Order is by doc_id, a hash of the text (only for rows that share a doc_id), and start. Comparisons of whole
contexts are by two 64-bit hashes.

Defined results: null or empty text has no bytes; a null doc_id is smaller than all others; rows with equal
doc_id and text are one document that is returned as often as it occurs; rows with equal doc_id and other
texts are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import mapped, texts, written

SPAN = 100  # bytes of a repeat
GRAM = 32  # bytes of an anchor
CHUNK = 1 << 18  # bytes that are hashed at once
BLOCK = 1 << 16  # bytes of contexts, of several anchors, that are merged together
MAX_BLOCK = 1 << 19  # bytes of one anchor's contexts
SHARDS = 4
HELD = 1 << 18  # anchors that a task holds before it sends them
CROWD = (8, 0.002, 64)  # an anchor is crowded with a share of the held contexts, within these bounds
HOT = 1 << 62  # set in `at` for contexts of crowded anchors
NO_ID = -(1 << 63)

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P, CHUNK + 1), _powers(_PI, CHUNK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple | None:
    """(anchor hash, context hash, first window, windows) of each context of texts laid end to end (uint8, at
    most CHUNK); ends: where each text ends. None if no text has a window."""
    n = len(text)
    if n < SPAN:
        return None
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=c[1:])
    h = _mix((c[GRAM:] - c[:-GRAM]) * _INV[: n - GRAM + 1])
    w = SPAN - GRAM + 1
    low = np.uint64(CHUNK - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m, size = key, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1])
    at = (m & low).astype(np.int64)  # anchor of the window at each start
    ok = np.ones(len(at), bool)
    for e in ends[:-1].tolist():  # windows that cross texts
        ok[max(0, e - SPAN + 1) : e] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        return None
    p = at[starts]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    a = starts[first]
    b = starts[np.concatenate([first[1:], [len(starts)]]) - 1]
    ctx = _mix((c[b + SPAN] - c[a]) * _INV[a] + (b - a).astype(np.uint64) * np.uint64(0x165667B19E3779F9) + (p[first]-a).astype(np.uint64))
    return h[p[first]], ctx, a, b - a + 1


def _groups(own: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, ends, (text number, its start in that text)) in portions of at most CHUNK bytes. A longer text is
    cut into overlapping parts, so that each of its windows lies in one of them."""
    part: list[bytes] = []
    at: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(own):
        if len(t) < SPAN:
            continue
        for a in range(0, max(1, len(t) - SPAN + 1), CHUNK - SPAN + 1):
            x = t[a : a + CHUNK]
            if size + len(x) > CHUNK:
                yield b"".join(part), np.cumsum([len(y) for y in part]), at
                part, at, size = [], [], 0
            part.append(x)
            at.append((i, a))
            size += len(x)
    if part:
        yield b"".join(part), np.cumsum([len(y) for y in part]), at


COLUMNS = ["h", "c", "doc", "th", "at"]  # at: first window << 8 | windows; h, c: 0, 0 for what is a repeat already
ANCHORS = "h long, c long, doc long, th int, at long"


def _batch(rows: tuple, types: tuple = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), names: list[str] = COLUMNS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)


def _repeats(h: np.ndarray, c: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of COLUMNS: (which are the first of their (h, c), which are later places of it).
    Rows of the very same place, from rows that repeat a document, are neither."""
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    f = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return first, ~((doc == doc[f]) & (th == th[f]) & (at == at[f]))


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [x[order] for x in cols]
        first, again = _repeats(*cols)
        h, c, doc, th, at = cols
        crowded, n_own = np.unique(h[first], return_counts=True)
        crowded = crowded[n_own >= np.clip(CROWD[1] * len(h), CROWD[0], CROWD[2])]
        at[first & np.isin(h, crowded)] |= HOT
        h[again] = c[again] = 0
        rows, marks = first | again, np.zeros(len(crowded), np.int64)
        marks = (crowded, np.full(len(crowded), NO_ID), marks, marks, marks)
        return _batch(tuple(np.concatenate([x[rows], m]) for x, m in zip((h, c, doc, th, at), marks, strict=True)))

    for b in it:
        docs, ths, own = b.column(0).to_numpy(), b.column(1).to_numpy(), texts(b.column(2))
        for raw, ends, at in _groups(own):
            found = anchors(np.frombuffer(raw, np.uint8), ends)
            if found is None:
                continue
            h, c, a, k = found
            which = np.searchsorted(ends, a, "right")
            starts = np.concatenate([[0], ends[:-1]])
            row, off = (np.array(x) for x in zip(*at, strict=True))
            held.append([h.view(np.int64), c.view(np.int64), docs[row[which]], ths[row[which]], (a - starts[which] + off[which]) << 8 | k])
            n += len(h)
        if n >= HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


class _Firsts:
    """Sorted rows -> the first place of each context, of anchors with several contexts; others are repeats."""

    def __init__(self, all_firsts: bool):
        self.all = all_firsts  # each anchor counts as one with several
        self.last: tuple | None = None  # the last first place so far, and whether it is sent
        self.sent = False
        self.marked = NO_ID  # the last marked anchor

    def rows(self, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mark = (cols[4] & 255) == 0
        marks = cols[0][mark]
        cols = [x[~mark] for x in cols]
        if len(marks) and self.last is not None and not len(cols[0]):
            self.marked = int(marks[-1])
        if not len(cols[0]):
            return
        if self.last is not None:
            cols = [np.concatenate([[y], x]) for x, y in zip(cols, self.last, strict=True)]
        first, again = _repeats(*cols)  # the row carried over is a first
        if again.any():
            zero = np.zeros(int(again.sum()), np.int64)
            yield _batch((zero, zero, *(x[again] for x in (*cols[2:4], cols[4] & ~HOT))))
        k = np.flatnonzero(first)
        h = cols[0][k]
        same = h[1:] == h[:-1]
        hot = np.isin(h, np.append(marks, self.marked)) if len(marks) or self.marked != NO_ID else np.zeros(len(k), bool)
        send = np.append(same, False) | np.concatenate([[False], same]) | hot | self.all
        known = send.copy()  # also what was sent with an earlier batch
        if self.last is not None:
            known[0] |= self.sent
            if self.sent and len(k) > 1 and same[0]:
                send[1] = True
            send[0] &= not self.sent
        if send.any():
            own = [x[k[send]] for x in cols]
            own[4] = np.where(hot[send], own[4] | HOT, own[4])
            yield _batch(tuple(own))
        self.last, self.sent = tuple(x[k[-1]] for x in cols), bool(known[-1])
        if len(marks):
            self.marked = int(marks[-1])


def _across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by COLUMNS -> the same columns: repeats with h = c = 0, and the first places of the contexts of
    anchors that have several, with h."""
    plain, hot = _Firsts(False), _Firsts(True)
    for b in it:
        cols = [b.column(i).to_numpy() for i in range(5)]
        known = (cols[0] == 0) & (cols[1] == 0)
        if known.any():
            yield _batch((*(np.zeros(int(known.sum()), np.int64),) * 2, *(x[known] for x in cols[2:])))
        dealt = ~known & (cols[4] >= HOT)
        yield from hot.rows([x[dealt] for x in cols])
        yield from plain.rows([x[~known & ~dealt] for x in cols])


def merge_repeats(contexts: list[bytes], order: np.ndarray) -> np.ndarray:
    """For all bytes of `contexts` laid end to end: whether the window that starts there occurs at a place of
    lower `order` too. Windows don't cross contexts."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1])
    text = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8).astype(np.uint64)
    own = np.repeat(np.arange(len(contexts)), sizes)
    place = np.arange(n)
    left = ends[own] - place  # bytes from here to the context's end
    four = text[:n] << np.uint64(24) | text[1 : n + 1] << np.uint64(16) | text[2 : n + 2] << np.uint64(8) | text[3 : n + 3]
    # symbols of 8 bytes, in an order that refines that of the first 4; one that the context's end cuts is unique
    first = _ranks(four, left < 4)
    then = np.where(left < 8, np.uint64(1 << 33) | place.astype(np.uint64), np.concatenate([four[4:], np.zeros(4, np.uint64)]))
    symbol = _ranks(first.astype(np.uint64) << np.uint64(34) | then, None)

    def ahead(k: int) -> np.ndarray:
        """The place k bytes on, around the end of the context."""
        return np.where(left > k, place + k, starts[own] + (k - left) % sizes[own])

    back = np.empty(n, np.int64)
    back[ahead(8)] = place
    # each shard's suffixes by prefix doubling, to 128 bytes and more
    shard = np.minimum(own * SHARDS // len(contexts), SHARDS - 1)
    rank, k = symbol.astype(np.int64), 8
    while k < SPAN + 8:
        rank = _ranks((shard << 56 | rank << 28 | rank[ahead(k)]).view(np.uint64), None).astype(np.int64)
        k *= 2
    suffixes = np.argsort(shard << 32 | rank, kind="stable")  # by shard, then as sorted there
    transform = symbol[back[suffixes]]  # of all shards, one behind the other
    counts = np.bincount(shard, minlength=SHARDS)
    kind = np.uint16 if transform.max(initial=0) < 1 << 16 else np.uint32
    transform = transform.astype(kind)
    # the interleave: from which shard the next suffix comes; at first ordered by 4 bytes
    source = np.repeat(np.arange(SHARDS, dtype=np.uint8), counts)
    by = first[suffixes]
    deal = np.argsort(by, kind="stable")
    source, block = source[deal], np.cumsum(np.concatenate([[0], by[deal][1:] != by[deal][:-1]]))
    merged = np.empty(n, kind)
    for _ in range((SPAN - 4) // 8):
        merged[np.argsort(source, kind="stable")] = transform
        deal = np.argsort(merged, kind="stable")
        source, b, m = source[deal], block[deal], merged[deal]
        block = np.cumsum(np.concatenate([[0], (b[1:] != b[:-1]) | (m[1:] != m[:-1])]))
        if block[-1] == n - 1:
            break
    at = np.empty(n, np.int64)  # read out: the suffix at each place of the merged order
    at[np.argsort(source, kind="stable")] = np.arange(n)
    merged_suffixes = suffixes[at]
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    order = np.where(left >= SPAN, order, np.iinfo(np.int64).max)[merged_suffixes]  # what wraps around is no window
    out = np.empty(n, bool)
    out[merged_suffixes] = order > np.minimum.reduceat(order, heads)[block]
    return out & (left >= SPAN)


def _ranks(x: np.ndarray, alone: np.ndarray | None) -> np.ndarray:
    """Dense ranks of x; places in `alone` get ranks of their own behind all others."""
    order = np.argsort(x)
    s = x[order]
    out = np.empty(len(x), np.uint32)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]), dtype=np.uint32)
    if alone is not None:
        k = np.flatnonzero(alone)
        out[k] = int(out.max()) + 1 + np.arange(len(k), dtype=np.uint32)
        order = np.argsort(out)
        s = out[order]
        out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]), dtype=np.uint32)
    return out


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, wanted: array of (h, at)) -> a row per wanted context, with its bytes."""
    names = ["h", "doc", "th", "at", "context"]
    for b in it:
        rows, size = [], 0
        for doc, th, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), strict=True):
            for x in wanted:
                at = x["at"] & ~HOT
                a, k = at >> 8, at & 255
                rows.append((x["h"], doc, th, x["at"], t[a : a + k + SPAN - 1]))
            size += 200 * len(wanted)
            if size > 1 << 24:
                yield _batch(tuple(zip(*rows, strict=True)), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), names)
                rows, size = [], 0
        if rows:
            yield _batch(tuple(zip(*rows, strict=True)), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), names)


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of h -> COLUMNS: repeats with h = c = 0; of anchors over MAX_BLOCK all windows, h and c
    being a window's hash."""
    held: list[tuple] = []  # whole anchors of the coming block
    own: list[tuple] = []  # the anchor that is being read
    dealt: list[tuple] = []  # contexts of crowded anchors
    size, own_size, large = 0, 0, False

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[1:4])
        doc, th, at = (np.array(x) for x in list(zip(*rows, strict=True))[1:4])
        sizes = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))
        which = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(rows)), sizes)
        pos = np.arange(len(row)) - starts[row] + (at[row] >> 8)
        found = np.flatnonzero(merge_repeats([r[4] for r in rows], which[row] << 40 | pos))
        if not len(found):
            return
        run = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1] + 1) | (row[found[1:]] != row[found[:-1]])]))
        n = np.diff(np.append(run, len(found)))
        k = row[found[run]]
        zero = np.zeros(len(run), np.int64)
        yield _batch((zero, zero, doc[k], th[k], pos[found[run]] << 8 | n))

    def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for r in range(0, len(rows), 512):
            part = [(d, th, (at >> 8) + i, x[i : i + SPAN]) for _, d, th, at, x in rows[r : r + 512] for i in range(len(x) - SPAN + 1)]
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[3]) for x in part), "<i8").reshape(-1, 2)
            doc, th, pos = (np.array(c) for c in list(zip(*part, strict=True))[:3])
            yield _batch((hashes[:, 0], hashes[:, 1], doc, th, pos << 8 | 1))

    for b in it:
        for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if r[3] >= HOT:
                dealt.append((*r[:3], r[3] & ~HOT, r[4]))
                if len(dealt) == 512:
                    yield from windows(dealt)
                    dealt = []
                continue
            if own and r[0] != own[0][0]:
                if large:
                    yield from windows(own)
                else:
                    if size + own_size > BLOCK:
                        yield from block(held)
                        held, size = [], 0
                    held += own
                    size += own_size
                own, own_size, large = [], 0, False
            own.append(r)
            own_size += len(r[4])
            if own_size > MAX_BLOCK:
                yield from windows(own)
                own, own_size, large = own[-1:], 0, True
                own[0] = (*own[0][:4], b"")
    yield from windows(dealt)
    if large:
        yield from windows(own)
        own = []
    if size + own_size > BLOCK:
        yield from block(held)
        held = []
    yield from block(held + own)


def _apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ats) -> what is left of each text, and what went."""
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    for b in it:
        kept, rows = [], []
        for t, ats in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            if not ats:
                kept.append(t)
                rows.append((len(t), 0, 0))
                continue
            at = np.array(ats, np.int64)
            edge = np.zeros(len(t) + 1, np.int32)
            np.add.at(edge, at >> 8, 1)
            np.add.at(edge, (at >> 8) + (at & 255) + SPAN - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            rows.append((len(t), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans); kept: the bytes left, which may break a character."""
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))
    local = docs.select("doc", "th", "text").transform(mapped, _local, ANCHORS)
    target = F.when((F.col("h") == 0) & (F.col("c") == 0), F.xxhash64("doc", "at")).when(F.col("at") >= HOT, F.xxhash64("h", "c")).otherwise(F.col("h"))
    places = written(local.repartition(target).sortWithinPartitions(*COLUMNS).transform(mapped, _across, ANCHORS))
    known = "h = 0 and c = 0"
    wanted = places.where(f"not ({known})").groupBy("doc", "th").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
    contexts = docs.select("doc", "th", "text").join(wanted.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "wanted").transform(mapped, _contexts, "h long, doc long, th int, at long, context binary")
    dealt = F.when(F.col("at") >= HOT, F.xxhash64("h", "doc", "at")).otherwise(F.col("h"))
    merged = written(contexts.repartition(dealt).sortWithinPartitions("h").transform(mapped, _merge, ANCHORS))
    windows = merged.where(f"not ({known})")
    gone = places.where(known).unionByName(merged.where(known)).select("doc", "th", "at")
    if windows.limit(1).count():
        place = F.struct("doc", "th", "at")
        firsts = windows.groupBy("h", "c").agg(F.min(place).alias("place"))
        gone = gone.unionByName(windows.join(firsts, ["h", "c"]).where(place > F.col("place")).select("doc", "th", "at"))
    gone = gone.groupBy("doc", "th").agg(F.collect_list("at").alias("ats"))
    return docs.join(gone.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "ats").transform(mapped, _apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
