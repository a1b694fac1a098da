"""Documents with every awkward case, and their empty counterpart."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ret", "sun") for b in ("da", "ne", "pi", "stra") for c in ("", "k", "ns", "tor", "é")]
LONG_LINE = "The quick brown fox jumps over the lazy dog again and again, says line {}."


MANY = [f"{a}{b}{c}" for a in WORDS for b in ("do", "fu", "gri") for c in ("", "n", "stel", "w", "x", "ya")]


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(4)
    out = [
        (1, None, "en", "web", None),
        (2, "", None, "web", 0),
        (None, "no id here, just " + prose(rng, 30), "en", None, 1),
        (3, " \t\n\x0b\x0c\r ", "en", "web", 7),
        (4, "one", "en", "web", 3),
        (5, "é" * 60 + "\n" + "É" * 60, "fr", "web", 121),
        (6, prose(rng, 30_000), "en", "web", 1),
        (7, prose(rng, 5), "en", "web", 1),
        (8, "x" * 5000, "en", "web", 5000),
        (9, "中文字" * 400, "zh", "web", 1200),
        (10, "\n\n\n", "en", "web", 3),
    ]
    base = prose(rng, 200)
    out += [(20 + i, base, "en", "hot", 1) for i in range(6)]  # exact copies
    out += [(30 + i, base + f" end{i}", "en", "hot", 1) for i in range(6)]  # near copies
    shared = LONG_LINE.format("shared")
    out += [(40 + i, f"{prose(rng, 20)}\n  {shared.upper()} \t\n{prose(rng, 20)}\n{shared}", "en", "hot", 1) for i in range(7)]
    out += [(50 + i, f"{prose(rng, 60)} {base[100:400]} {prose(rng, 60)}", "de", "web", 1) for i in range(4)]
    out += [(60 + i, prose(rng, rng.randint(10, 400)), "en", "web", 1) for i in range(40)]
    return out + [out[11], out[11], out[-1]]  # repeated rows


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(spark, docs):
    """`docs` with columns that operators add or use."""
    from pyspark.sql import functions as F

    names = "n_lines n_dropped held_out score predicted base_failed anomaly kept n_words word_chars n_symbols n_dup_lines n_repeat_words node fp component_id h c th at doc wanted ats key keys labels start length _id _gone _x _drops _key root item_id"
    return docs.withColumns({n: F.lit("clash") for n in names.split()})
