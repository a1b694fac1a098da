"""Toxicity by compression distance (operator 5).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, and used as raw content. Every
text is cut into overlapping windows of bytes; how many bytes fewer a window takes with the toxic dictionary
than with the ordinary one is its distance. A logistic model over a document's distances (means of the largest,
mean, deviation, windows over limits) calibrates them into a score; its limit is 0.5.

Training. Both dictionaries hold the same part, trained on ordinary text, at equal offsets, so that what all
texts share costs the same in both. In front of it, zstandard's trainer fills each from its own class: from the
words of the class's texts that hold an N-gram found in significantly more of its documents than of the
other class's. Without that choice, a dictionary of toxic text is filled with what is frequent in any text. What
is missing to equal lengths is ordinary text in the one dictionary and zeros in the other. A sentence that several
documents share counts once, so that groups of copies don't decide. The dictionaries come from three of four
documents of the sample, the model from the fourth.

The sample has labelled rows only, at most `max_labelled` of each class and those of at most `max_chars`
characters, by the smallest hash of doc_id. It is fitted on the driver. Scoring covers every window of every text.
doc_id, lang and source are no inputs of a score.

Defined results: null or empty text is one empty window and gets the model's score for that; a very long text
is windowed as a whole; a null doc_id is scored and counts as held out; repeated rows are scored each; of
several labels of a doc_id the largest counts; ties in the sample's order go by doc_id; without labels of both
classes every score is 0; an empty table gives no rows. `score` carries the input's columns along except text,
but replaces those it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import fresh, mapped, text_key, texts, without

WINDOW, STEP, LEVEL = 64, 48, 12
LIMITS = (1, 2, 3, 4, 5, 6, 8)
N_FEATURES = 7 + len(LIMITS)
#: Bytes of an N-gram, and bits of its hash.
GRAM, BITS = 6, 22
#: Bytes of the part that both dictionaries share, and at most of each one's own part.
SHARED, OWN = 30_000, 2_000
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, toxic) to learn from: not held out, at most `max_labelled` of each class."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id"))
    one = lambda which: rows.where(which).orderBy("_h", "doc_id").limit(max_labelled).drop("_h")
    return one("toxic > 0").withColumn("toxic", F.lit(1)).unionByName(one("toxic <= 0").withColumn("toxic", F.lit(0)))


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_chars: int) -> tuple[list[bytes], list[bytes]]:
    """(ordinary, toxic) lower-cased texts to learn from, in an order by hash."""
    known = F.broadcast(labelled(labels, max_labelled))  # 2 * max_labelled rows at most
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic").toArrow()
    own: tuple[list, list] = [], []
    for h, i, t, y in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        own[y].append((h, i, t.lower().encode()))
    return tuple([t for _, _, t in sorted(x)[:max_labelled]] for x in own)


def sentences(own: list[bytes]) -> list[list[bytes]]:
    """The sentences of each text that no earlier one has."""
    seen: set[bytes] = set()
    out = []
    for t in own:
        new = [x for x in dict.fromkeys(t.replace(b"\n", b". ").split(b". ")) if x not in seen]
        seen.update(new)
        out.append(new)
    return out


def gram_hashes(t: bytes) -> np.ndarray:
    raw = np.frombuffer(t, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x100000001B3) ^ (raw[i : n + i] + np.uint64(1))
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_counts(own: list[bytes]) -> np.ndarray:
    """By hash of an N-gram: texts that have it."""
    out = np.zeros(1 << BITS, np.int64)
    for t in own:
        out[np.unique(gram_hashes(t))] += 1
    return out


def telling(own: np.ndarray, other: np.ndarray, share: float, least_z: float, least_docs: int = 4) -> np.ndarray:
    """Which N-grams are in significantly more texts of a class than its `share` of all text lets expect."""
    expected = (own + other) * share
    z = (own - expected) / np.sqrt(expected * (1 - share) + 0.5)
    return (z >= least_z) & (own >= least_docs) & (own > 2 * expected * (1 - share))


def telling_words(own: list[bytes], which: np.ndarray) -> Iterator[bytes]:
    """Of each text the words that hold a telling N-gram, as a training sample."""
    for t in own:
        at = np.flatnonzero(which[gram_hashes(t)])
        gaps = np.flatnonzero(np.frombuffer(t, np.uint8) == 0x20)
        k = np.unique(np.searchsorted(gaps, at + GRAM // 2, "right"))
        k = k[(k > 0) & (k < len(gaps))]
        words = (t[gaps[i - 1] + 1 : gaps[i]].strip(MARKS) for i in k.tolist())
        if found := b" ".join(w for w in words if w):
            yield b" " + found + b" "


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """What zstandard's trainer makes of the samples; all of them if they are too few for it."""
    import zstandard as z

    if sum(map(len, samples)) > 2 * size and size >= 256:
        try:
            return z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(samples)[-size:]


class Texts:
    """Texts of one class to train from, each without the sentences that an earlier one has."""

    def __init__(self, own: list[list[bytes]]):
        self.sentences, self.texts = own, [b" " + b" ".join(x) + b" " for x in own]
        self.size, self.counts = sum(map(len, self.texts)), gram_counts(self.texts)


def dictionaries(ordinary: Texts, toxic: Texts) -> tuple[bytes, bytes]:
    """Contents (ordinary, toxic), of equal length."""
    own: list[bytes] = []
    for this, other in ((ordinary, toxic), (toxic, ordinary)):
        words: list[bytes] = []
        for least_z in (5.0, 3.0, 1.5):  # small samples have to do with less
            share = this.size / max(1, this.size + other.size)
            words = list(telling_words(this.texts, telling(this.counts, other.counts, share, least_z)))
            if sum(map(len, words)) >= 256:
                break
        own.append(trained(words, OWN, 16))
    plain = [s for x in ordinary.sentences for s in x if len(s) >= 8]
    shared, n = trained(plain, SHARED, 40), max(map(len, own))
    filler = b" ".join(plain[-2000:])[:n].ljust(n)
    return (filler + own[0])[-n:] + shared, own[1].rjust(n, b"\0") + shared


class Distance:
    """Window distances and a document's features from them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for content in (ordinary, toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def windows(self, t: bytes) -> np.ndarray:
        t = t.lower()
        plain, toxic = self.by
        own = (t[i : i + WINDOW] for i in range(0, max(1, len(t) - WINDOW + STEP), STEP))
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in own), np.int64)

    def features(self, t: bytes) -> list[float]:
        d = self.windows(t)
        top = np.sort(d)[::-1]
        return [*(float(top[:k].mean()) for k in (1, 2, 4, 8)), float(d.mean()), float(d.std()), math.log1p(len(d)), *(math.log1p(int((d >= x).sum())) for x in LIMITS)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) by Newton's method. A row of the rarer class weighs as much more as
    the square root of the classes' ratio, so that the limit stands between their shares and equal ones."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    c = np.where(y > 0, np.sqrt(max(1, (y == 0).sum()) / max(1, (y > 0).sum())), 1.0)
    w = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (c * p * (1 - p))[:, None]) + keep, a.T @ (c * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Dictionaries from three of four texts of each class, and the model from the distances of the fourth."""
    rest = lambda own: [x for i, x in enumerate(own) if i % 4 or len(own) < 4]
    content = dictionaries(Texts(sentences(rest(ordinary))), Texts(sentences(rest(toxic))))
    by = Distance(*content)
    own = ordinary[::4] + toxic[::4]
    y = np.array([0.0] * len(ordinary[::4]) + [1.0] * len(toxic[::4]))
    return *content, *fit_logistic(np.array([by.features(t) for t in own]), y)


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, max_chars: int = 1 << 16) -> DataFrame:
    """`docs` without text, with held_out, score and predicted."""
    docs = docs.drop("held_out", "score", "predicted")
    own = fresh(docs, "_x")
    ordinary, toxic = sample(docs, labels, max_labelled, max_chars)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    rest = docs.select(*[f.name for f in fields], "text")
    if not ordinary or not toxic:
        out = rest.withColumn(own, F.lit(0.0)).drop("text")
    else:
        held = docs.sparkSession.sparkContext.broadcast(fit(ordinary, toxic))  # of constant size

        def run(it):
            plain, offending, mean, scale, w = held.value
            by = Distance(plain, offending)
            for b in it:
                x = np.array([by.features(t) for t in texts(b.column(b.num_columns - 1))]).reshape(-1, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -700, 700)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], own])

        out = rest.transform(mapped, run, T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(own, T.DoubleType())]))
    return out.withColumns({"held_out": held_out(), "score": F.col(own), "predicted": (F.col(own) >= 0.5).cast("int")}).drop(own)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted to be toxic. Each text is judged by itself, whatever else is under its
    doc_id; a null doc_id as well."""
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    return without(docs, score(rows, labels).where("predicted = 1"))
