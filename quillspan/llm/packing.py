"""Sum-of-squares online packing of token sequences into fixed windows (operator 1).

Each document's ids (its own end id included) are cut at multiples of the window; full windows are
emitted at once. The rest, an item of 1..size-1 ids, goes to the fill level h whose choice minimises
sum(N(l)^2) over the counts N(l) of windows that stand at level l (Csirik, Johnson and Kenyon's online
rule); h = 0 opens a new window. N is one array of `size` entries, so a placement costs O(size) whatever
the number of open windows. When more than `max_open` are open, which bounds memory, the fullest ones, that few items
still fit, are closed, and at a partition's end all are. A closed window of n ids becomes sequences of power-of-two
lengths that sum up to n, which need no padding. At the end, that is so for windows filled to a share of `keep`
at least, down to an eighth of a window; their tails and what emptier windows hold are cut anew into full windows,
or else they would end in many short sequences.

Packing is local to a partition: no row is shuffled, a re-run task gives the same sequences (ids are made
of the partition number and a counter), and memory is `max_open` windows plus one document.

Defined results: null or empty text holds the end id only; a row with a null doc_id is packed like any
other; repeated rows are packed once each; of levels of equal cost a new window comes first, then the one that is
filled up, then the lowest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillspan.llm.common import mapped, texts, vocabulary, word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class SumOfSquares:
    """Open windows by fill level. Items are (payload, length); `closed` gets full windows."""

    def __init__(self, size: int):
        self.size = size
        self.n = np.zeros(size, np.int64)
        self.at: list[list[list]] = [[] for _ in range(size)]
        self.open = 0

    def place(self, item: object, s: int) -> list | None:
        """Put an item of length 0 < s < size; the window's items if this fills it."""
        n, size = self.n, self.size
        # cost of level h = change of sum N^2: leaving h gives 1 - 2N(h), reaching h + s gives 1 + 2N(h + s)
        h = size - s
        best, cost = 0, 1 + 2 * int(n[s])
        if n[h] and 1 - 2 * int(n[h]) < cost:
            best, cost = h, 1 - 2 * int(n[h])
        if h > 1:
            have = n[1:h]
            c = np.where(have > 0, 2 - 2 * have + 2 * n[1 + s : size], np.iinfo(np.int64).max)
            k = int(c.argmin())
            if c[k] < cost:
                best = k + 1
        if best:
            window = self.at[best].pop()
            n[best] -= 1
        else:
            window, self.open = [], self.open + 1
        window.append(item)
        if best + s == size:
            self.open -= 1
            return window
        n[best + s] += 1
        self.at[best + s].append(window)
        return None

    def fullest(self, most: int) -> Iterator[list]:
        """Closes windows, the fullest first and of equals the youngest, until `most` are open."""
        for level in range(self.size - 1, 0, -1):
            while self.at[level] and self.open > most:
                self.n[level] -= 1
                self.open -= 1
                yield self.at[level].pop()


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_partition(rows: Iterator[tuple[int | None, bytes]], first_id: int, size: int, max_open: int = 4096, keep: float = 0.75) -> Iterator[tuple]:
    """Pieces of (doc_id, ids as bytes) rows. `first_id`: the partition's first sequence id."""
    bins, seq = SumOfSquares(size), first_id

    def emit(window: list, length: int) -> Iterator[tuple]:
        nonlocal seq
        offset = 0
        for doc, start, ids, total in window:
            k = len(ids) // 4
            yield doc, start, k, zlib.crc32(ids), total, seq, offset, length
            offset += k
        seq += 1

    def split(items: list, least: int = 1) -> Iterator[tuple]:
        """Items as full windows, and the rest as sequences of power-of-two lengths; returns what would make sequences
        shorter than `least`."""
        total, k = sum(len(x[2]) // 4 for x in items), 0
        for want in [size] * (total // size) + [x for x in powers(total % size) if x >= least]:
            own, left = [], want
            while left:
                doc, start, ids, n = items[k]
                take = min(left, len(ids) // 4)
                own.append((doc, start, ids[: 4 * take], n))
                left -= take
                if 4 * take == len(ids):
                    k += 1
                else:
                    items[k] = (doc, start + take, ids[4 * take :], n)
            yield from emit(own, want)
        return items[k:]

    for doc, ids in rows:
        total, start = len(ids) // 4, 0
        while total - start >= size:
            yield from emit([(doc, start, ids[4 * start : 4 * (start + size)], total)], size)
            start += size
        if start < total:
            if window := bins.place((doc, start, ids[4 * start :], total), total - start):
                yield from emit(window, size)
            for items in bins.fullest(max_open):
                yield from split(items)
    rest: list = []
    for items in bins.fullest(0):
        if sum(len(x[2]) // 4 for x in items) >= keep * size:
            rest += yield from split(items, size // 8)
        else:
            rest += items
    yield from split(rest)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None, max_open: int = 4096) -> DataFrame:
    """Pieces of `docs` (doc_id, text) packed into sequences of at most `size` ids."""
    path, end = path or vocabulary(), np.asarray([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(path), TaskContext.get().partitionId()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for b in it:
                for doc, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                    yield doc, words.text(t) + end

        out: list[tuple] = []
        for piece in pack_partition(rows(), part << 40, size, max_open):
            out.append(piece)
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select("doc_id", "text").transform(mapped, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
