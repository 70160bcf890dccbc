"""Chat formatting by a black-box template, with the span of every turn.

A template is any function from a list of (role, text) turns to a string; ``opening`` gives what it writes before
the text of a next turn. It is never looked into: the prefixes of a conversation are rendered one after the
other, and each output is compared with the one before. Where it extends it, the turn's span is what came
on top. Where it does not, the template rewrites history: the first position that changed and the turn at which it
happened are reported, and turns that reach beyond it have no span. Inside its span a turn's text is found with two more
renderings of the same prefix: what the opening adds before it, and what an empty text leaves after it. Loss falls on
the texts of the roles in ``learned``, if their span is known.

``marked`` is the template of the query: every turn is ``<s>role``, a newline, the text and ``</s>``. Control
strings within a role or text get a backslash after their first character (one more where there are some), which
``parse_marked`` takes back, so no text can end its turn or open another.

Rows of a conversation are ordered by turn, then role and text; null role or text is empty; rows of a null
conv_id form one conversation of their own. A conversation is one row of the result and so fits a task by nature; rendering all
prefixes costs the square of its turns. Other columns play no part. An empty table gives an empty one.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

# The strings that a template may read as control.
_CONTROL = r"(?:/?s>|/?INST\]|/?SYS\])"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.S)

SPANS = ("array<struct<turn:long,role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def marked(turns: list[Turn]) -> str:
    """The template of the query."""
    return "".join(f"<s>{_role(r)}\n{escape(t)}</s>" for r, t in turns)


def marked_opening(role: str) -> str:
    return f"<s>{_role(role)}\n"


def parse_marked(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked``."""
    plain = {"n": "\n", "\\": "\\"}
    return [(re.sub(r"\\(.)", lambda m: plain[m[1]], unescape(r)), unescape(t)) for r, t in _TURN.findall(formatted)]


def locate(turns: list[Turn], render: Callable, opening: Callable) -> tuple[str, list, int | None, int | None]:
    """The output, (start, end, text start, text end) of each turn or None, and where and when history changed."""
    before, spans = render([]), []
    where = when = None
    for n, (role, text) in enumerate(turns):
        now = render(turns[:n + 1])
        same = len(before) if now.startswith(before) else len(os.path.commonprefix([before, now]))
        if same < len(before):
            where, when = (same, n) if where is None or same < where else (where, when)
            spans = [s if s and s[1] <= same else None for s in spans]
        start, end = same if same == len(before) else None, len(now)
        if start is None:
            spans.append(None)
        else:
            head = len(opening(role))
            tail = len(render([*turns[:n], (role, "")])) - start - head
            inside = now.startswith(opening(role), start) and tail >= 0 and start + head <= end - tail
            spans.append((start, end, *((start + head, end - tail) if inside else (None, None))))
        before = now
    return before, spans, where, when


def format_conversations(df: DataFrame, render: Callable = marked, opening: Callable = marked_opening,
                         learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``spans`` of its turns in code points, and
    ``rewritten_at`` and ``rewriting_turn``, null where the template only appends."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    fields = ("turn", "role", "start", "end", "text_start", "text_end", "loss")
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                out = []
                for turns in part.column("turns").to_pylist():
                    pairs = [(t["role"], t["text"]) for t in turns]
                    text, spans, where, when = locate(pairs, render, opening)
                    out.append((text, [dict(zip(fields, (t["turn"], t["role"], *(s or (None,) * 4),
                                                         bool(s and s[2] is not None and t["role"] in learned))))
                                       for t, s in zip(turns, spans)], where, when))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], _SPANS),
                     pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64())],
                    ["conv_id", "formatted", "spans", "rewritten_at", "rewriting_turn"])

    return grouped.mapInArrow(
        run, f"conv_id {kind}, formatted string, spans {SPANS}, rewritten_at long, rewriting_turn long")


_SPANS = pa.list_(pa.struct([
    ("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of ``marked`` outputs, from the output and its spans alone: ``n_turns``, the turns as
    role, newline, text, newline (``turns_text``), the unescaped texts under the loss mask (``loss_text``)."""

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                texts, spans = part.column("formatted").to_pylist(), part.column("spans").to_pylist()
                turns = [parse_marked(t) for t in texts]
                whole = ["".join(f"{r}\n{t}\n" for r, t in of) for of in turns]
                loss = ["".join(unescape(t[s["text_start"]:s["text_end"]]) for s in of if s["loss"])
                        for t, of in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([len(t) for t in turns], pa.int64()), pa.array(whole, pa.string()),
                     pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_text string, loss_text string, formatted_chars long")
