"""Text analysis: words, stop words, the index analyzer and the query analyzer.

Both analyzers take maximal runs of ASCII letters and digits, extract first and lower-case then (lower-casing
first would turn some other letters into ASCII ones). The index analyzer drops its stop words, which leave gaps in the
positions; the query analyzer keeps all words and the operator signs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.stemmer import stem

WORD = "[0-9A-Za-z]+"

# Words that the index leaves out, before stemming.
INDEX_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()

# Words that a query leaves out, compared after stemming.
QUERY_STOP_WORDS = (
    "the and to of a in is it you that he was for on are with as i his they be at one have this from or had by but "
    "not what all were we when your can said there use an each which do how their if will up other about out many "
    "then them these so some her would make like him into time has look two more write go see"
).split()

# The operators of the query language.
AND, OR, NOT = ("AND", "&"), ("OR", "|"), ("NOT", "-")
OPERATORS = frozenset((*AND, *OR, *NOT, "(", ")"))

_QUERY_TOKEN = re.compile(r"[0-9A-Za-z]+|[&|()\-]")


def normalize_query(text: str, analyzer: str = "english") -> list[str]:
    """Query tokens: stemmed lower-case words, and operators as they are."""
    own = _QUERY_TOKEN.findall(text)
    fold = stem if analyzer == "english" else str
    return [t if t in OPERATORS else fold(t.lower()) for t in own]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of lower-case words, by Arrow batch; each worker keeps the stems that it has met."""
    return words.map(lambda own: None if own is None else [stem(w) for w in own])


def words(text: Column) -> Column:
    """All words, lower-cased; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def is_index_stop_word(word: Column) -> Column:
    return word.isin(INDEX_STOP_WORDS)


def kept_words(text: Column) -> Column:
    """Number of words that the index keeps, without a row per word."""
    return F.coalesce(F.size(F.filter(words(text), lambda w: ~is_index_stop_word(w))), F.lit(0))


def title_terms(title: Column, analyzer: str = "english") -> Column:
    """Terms of a title by the query analyzer. Upper-case operators are no terms."""
    found = F.regexp_extract_all(title, F.lit(WORD), F.lit(0))
    plain = F.transform(F.filter(found, lambda w: ~w.isin("AND", "OR", "NOT")), F.lower)
    return stem_words(plain) if analyzer == "english" else plain


def utf8_or_latin1(raw: Column) -> Column:
    """Text of a binary column: as UTF-8 if that is valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def page_parts(html: Column) -> tuple[Column, Column]:
    """(title, body text) of a web page."""
    blank = lambda c, pattern: F.regexp_replace(c, pattern, " ")
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<title.*?</title>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        body = blank(body, pattern)
    return title, F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))
