"""Incremental black-box rendering of conversations (operator 4).

A template is any function from a list of (role, text) to a string. The operator never looks inside it: it
renders the prefixes of 1, 2, ... turns, and what the i-th output adds to the (i-1)-th is turn i's span; the
place of a turn's own text in its span comes from rendering the same prefix with the text emptied. If an
output does not begin with its predecessor (up to a generation suffix), the template rewrites history; the
conversation is flagged (`rewrites_history`) and gets no spans.

Every prefix is rendered, as nothing less tells whether a template rewrites history, so a conversation costs the
square of its length in time, not in memory.

Turns are dealt out by conversation and sorted inside partitions; a task holds one conversation at a time.

Defined results: null text, role or conv_id: empty text, empty role, one conversation without an id; ties of
`turn` are ordered by role, then text; null turns come first; repeated rows are turns of their own; an empty
table gives only what `extra` adds; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import mapped

Turn = tuple[str, str]
SCHEMA = "conv_id long, formatted string, rewrites_history boolean, loss_spans array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    """No control string (`<|`) is left in the result; `unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """As `escape`, and without line breaks, as one ends the role."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def chatml(turns: list[Turn]) -> str:
    """Turns between `<|im_start|>role\\n` and `<|im_end|>\\n`, texts and roles escaped."""
    return "".join(f"<|im_start|>{escape_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_end\|>\n", re.S)


def parse_chatml(formatted: str) -> list[Turn]:
    """The turns, read back from `chatml`'s output."""
    out = []
    for m in TURN.finditer(formatted):
        role, _, text = m[1].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def text_span(full: str, history: list[Turn], role: str, template: Callable[[list[Turn]], str]) -> tuple[int, int]:
    """Where in `full` the last turn's text stands: a mark in its place shows the start, and what `full`
    has more than a rendering without text is its length."""
    blank = template([*history, (role, "")])
    mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in blank)
    start = template([*history, (role, mark)]).find(mark)
    start = common_prefix(full, blank) if start < 0 else start
    return start, start + len(full) - len(blank)


def render(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int]] | None]:
    """(whole rendering, span of each turn's text in it); no spans if the template rewrites history."""
    full = template(turns)
    spans, last = [], ""
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(last):
            return full, None
        a, b = text_span(now, turns[:i], role, template)
        if a < len(last):
            return full, None
        spans.append((a, b))
        last = now
    return full, spans


def format_conversations(conversations: DataFrame, template: Callable[[list[Turn]], str] = chatml, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation: its rendering and the code-point spans under the loss mask."""
    return _grouped(conversations, lambda turns: _loss(turns, template, loss_roles), SCHEMA)


def _loss(turns: list[Turn], template, loss_roles) -> tuple:
    full, spans = render(turns, template)
    mask = None if spans is None else [{"start": a, "end": b} for (r, _), (a, b) in zip(turns, spans, strict=True) if r in loss_roles]
    return full, spans is None, mask


def digest(row: tuple) -> tuple:
    """Columns of the query, read back from the formatted string and its mask."""
    full, rewrites, mask = row
    turns = parse_chatml(full)
    own = hashlib.sha256()
    for r, t in turns:
        own.update(f"{r}\n{t}\n".encode())
    loss = "".join(unescape(full[x["start"] : x["end"]]) for x in mask or [])
    return len(turns), own.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(full), rewrites


def _grouped(conversations: DataFrame, fn: Callable[[list[Turn]], tuple], schema: str) -> DataFrame:
    names = re.findall(r"(?:^|, )(\w+) (?:long|string|boolean|array<struct<.*?>>)", schema)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds.get(x, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for x in re.findall(r"(?:^|, )\w+ (long|string|boolean|array)", schema)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, out, held = None, [], [], 0
        started = False

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in it:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if started and conv != key:
                    out.append((key, *fn(turns)))
                    held += sum(len(t) for _, t in turns)
                    turns = []
                    if len(out) >= 2000 or held > 1 << 24:
                        yield flush()
                        out, held = [], 0
                started, key = True, conv
                turns.append((role, text))
        if started:
            out.append((key, *fn(turns)))
        if out:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").transform(mapped, run, schema)


def digests(conversations: DataFrame, template: Callable[[list[Turn]], str] = chatml) -> DataFrame:
    """The query's row per conversation, made from the real output."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    return _grouped(conversations, lambda turns: digest(_loss(turns, template, ("assistant",))), schema)
