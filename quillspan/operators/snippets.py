"""Highlighted excerpts of result documents.

An excerpt shows one or two stretches of a body: the closest group of hits with the most distinct query terms
within SPAN words, then the best group among later hits. Stretches are widened by words of context.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 15  # words between the first and the last hit of a group
BUDGET = 30  # words of all stretches together
_WORD = re.compile(r"[0-9A-Za-z]+")

Hit = tuple[int, str]


def hits(posts: DataFrame, results: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits: array of (pos, term) by position) of results (query_id, doc_id)."""
    own = posts.join(F.broadcast(terms.select("query_id", "term").distinct()), "term").join(results.select("query_id", "doc_id"), ["query_id", "doc_id"])
    places = own.select("query_id", "doc_id", F.explode("positions").alias("pos"), "term")
    return places.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("hits"))


def best_group(found: list[Hit], wanted: int) -> tuple[int, int]:
    """(first, last) number of the hits in the best group: most distinct terms, then shortest, then leftmost. A
    group that has all `wanted` terms ends the search."""
    where = [p for p, _ in found]
    best, choice = (0, 0), (0, 0)
    for last, at in enumerate(where):
        first = bisect_left(where, at - SPAN)
        quality = (len({t for _, t in found[first : last + 1]}), where[first] - at)
        if quality > best or not last:
            best, choice = quality, (first, last)
            if quality[0] == wanted:
                break
    return choice


def stretches(found: list[Hit], wanted: int) -> list[tuple[int, int, list[int]]]:
    """(first word, last word, words to highlight) of each stretch, with context."""
    groups, rest = [], found
    while len(groups) < 2 and (rest or not groups):
        if not rest:
            groups.append((0, 0, []))
            break
        first, last = best_group(rest, wanted)
        lo, hi = rest[first][0], rest[last][0]
        if not groups or hi:
            groups.append((lo, hi, [p for p, _ in rest if lo <= p <= hi]))
        rest = rest[last + 1 :]
        if not rest:
            break
    out = []
    for lo, hi, marked in groups:
        spare = BUDGET // len(groups) - (hi - lo)
        out.append((max(0, lo - int(spare / 2)), hi + spare - int(spare / 2), marked))
    return sorted(out)


def render(body: str, parts: list[tuple[int, int, list[int]]]) -> str:
    """The excerpt's text. In the last tenth of the last stretch it ends where a sentence does."""
    words = list(_WORD.finditer(body))
    pieces, shown, ended = [], 0, False
    for n, (lo, hi, marked) in enumerate(parts):
        lo = max(lo, shown)  # stretches may meet
        text, bold = "", set(marked)
        if n and shown < len(words):
            pieces.append(" ... ")
        for i in range(lo, min(hi + 1, len(words))):
            word = f"<b>{words[i][0]}</b>" if i in bold else words[i][0]
            text += (body[words[i - 1].end() if i else 0 : words[i].start()] if i > parts[n][0] else "") + word
            if n == len(parts) - 1 and hi - (parts[n][1] - parts[n][0] + 1) // 10 <= i < hi:
                end = re.search(r"[.!?]", body[words[i].end() : words[i].end() + 3])
                if end:
                    text, ended = text + end[0], True
                    break
        pieces.append(text)
        shown = max(shown, hi + 1)
        if ended:
            break
    more = not ended and shown < len(words)
    return ("... " if parts[0][0] > 0 else "") + "".join(pieces) + (" ..." if more else "")


def snippet(body: str | None, found: list[Hit], wanted: int) -> str:
    """The excerpt of one body; without hits its beginning."""
    return render(body or "", stretches(found, wanted))


@F.pandas_udf(T.StringType())
def _snippets(body: pd.Series, found: pd.Series, wanted: pd.Series) -> pd.Series:
    rows = zip(body, found, wanted, strict=True)
    return pd.Series([snippet(b, [] if h is None else [(x["pos"], x["term"]) for x in h], n) for b, h, n in rows], dtype=object)


def with_snippets(results: DataFrame, posts: DataFrame, terms: DataFrame) -> DataFrame:
    """`results` (query_id, doc_id, body, ...) with `snippet` in place of `body`; meant for rows behind a limit."""
    wanted = terms.groupBy("query_id").agg(F.countDistinct("term").alias("_wanted"))
    rows = results.join(hits(posts, results, terms), ["query_id", "doc_id"], "left").join(F.broadcast(wanted), "query_id", "left")
    return rows.withColumn("snippet", _snippets("body", "hits", F.coalesce("_wanted", F.lit(0)))).drop("body", "hits", "_wanted")
