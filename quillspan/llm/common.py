"""What the training-data operators share: table access, Arrow batches, tokenising."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: Words kept in a worker's word cache; beyond that the cache starts anew.
CACHE_WORDS = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; set one only where none is named (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillspan-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there: later jobs don't redo it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared checkpoint folder, gone when the driver ends. Frees the shuffles behind it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it new to `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key():
    """Hash of a row's text: with the doc_id, it tells rows apart by what they hold."""
    return F.xxhash64("text")


def without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """`docs` but for rows whose doc_id, null included, and text are in `judged` (doc_id, text_key). Other texts
    under the same doc_id stay."""
    own, key = fresh(docs, "_id"), fresh(docs, "_text_key")
    judged = judged.select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct()
    return docs.join(judged, F.col("doc_id").eqNullSafe(F.col(own)) & (text_key() == F.col(key)), "left_anti")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    out = column.to_pylist()
    return [b"" if x is None else x for x in out] if column.null_count else out


#: Bytes of a batch that a worker takes up at once; it may be one row more.
SLICE = 4 << 20


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow`, with batches of bounded size, and memory that a task has freed given back at its end: a
    worker lives on for other tasks, beside those of other stages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[pa.RecordBatch]:
            for b in it:
                n = max(1, b.num_rows * SLICE // max(b.nbytes, 1))
                yield from (b.slice(k, n) for k in range(0, b.num_rows, n))

        yield from fn(small())
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """`fn` over each Arrow batch of `df`; it returns the columns of `schema` by name."""
    names = _names(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows and (out := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x) for n in names], names)

    return df.transform(mapped, run, schema)


def _names(schema: str) -> list[str]:
    """Column names of a flat DDL string."""
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.split()[0].strip("`"))
            part = ""
        else:
            part += ch
    return out


_MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


class WordIds(dict):
    """Token ids of white-space-free chunks as little-endian uint32 bytes, encoded once each.

    The vocabulary's normaliser and splitter work within such chunks only (white space is dropped and
    never part of a token), so the ids of a text are those of its chunks in order. Chunks of letters are
    encoded many at a time, each ending at a token that closes a word; ASCII marks behind letters are a
    piece of their own. All else is encoded chunk by chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def encode(self, chunk: bytes) -> bytes:
        ids = self.tok.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        out = self[chunk] = self.encode(chunk)
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Encode chunks that aren't known yet."""
        letters, tails, rest = set(), [], []
        for c in chunks:
            body = c.rstrip(_MARKS)
            if not (body.isalpha() or unicodedata.normalize("NFC", body.decode("utf-8", "replace")).lower().isalpha()):
                rest.append(c)
                continue
            if len(body) < len(c):
                tails.append((c, body, c[len(body) :]))
            if body not in self:
                letters.add(body)
        if letters:
            own = list(letters)
            ids = np.asarray(self.tok.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):
                raw, at = ids.tobytes(), 0
                for w, e in zip(own, (4 * ends).tolist(), strict=True):
                    self[w] = raw[at:e]
                    at = e
        for c, body, tail in tails:
            self[c] = self[body] + self[tail]
        for c in rest:
            self[c]

    def piece(self, t: bytes) -> bytes:
        if b"<|" not in t:  # else a special token may come about
            t = t.lower()
        chunks = t.replace(b"\n", b" ").split(b" ")
        if new := {c for c in set(chunks) if c not in self}:
            if len(self) > CACHE_WORDS:
                self.clear()
                new = set(chunks)
            self.learn(new)
        return b"".join(map(self.__getitem__, chunks))

    def text(self, t: bytes) -> bytes:
        """Ids of a whole text. Works through long texts piece by piece to bound memory."""
        if len(t) < 1 << 20:
            return self.piece(t)
        out, at = [], 0
        while at < len(t):
            end = min(len(t), at + (1 << 20))
            if end < len(t):
                back = max(t.rfind(b" ", at, end), t.rfind(b"\n", at, end))
                if back < 0:  # no white space here: go on to the next one
                    fwd = [x for x in (t.find(b" ", end), t.find(b"\n", end)) if x >= 0]
                    back = min(fwd, default=len(t) - 1)
                end = back + 1
            out.append(self.piece(t[at:end]))
            at = end
        return b"".join(out)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's WordIds for a vocabulary file; one is loaded per process."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def vocabulary() -> str:
    """The default vocabulary file; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
