"""Conversations as training text that can be read back exactly.

The template marks a user turn as ``[INST] text [/INST]``, an assistant turn as
``text</s>`` after a blank, a system turn as ``<<SYS>>text<</SYS>>`` and any other role as
``[ROLE] "role"`` with its text on the next line and ``[/ROLE]``; ``<s>`` begins a
conversation.  Each turn is rendered and read again by a deterministic parser; as long as
what it reads differs from the source, conflicting content is escaped further:

1. the text as it is;
2. a backslash before each control string inside the text, and doubled backslashes before that;
3. doubled backslashes at the end of the text, too.

A control string behind an odd number of backslashes is text; behind an even number it
is a mark.  The loss covers the texts of assistant turns.

Turns are rendered where they are; only reading whole conversations back needs their
turns in order, and does so row by row in bounded memory, whatever a conversation's length.

Results of odd input: a null text is empty, a null role is the empty role; turns are in
order of turn (null first), then role and text, so repeated turns are all kept; rows
without conversation id form one conversation; an empty table gives an empty table;
columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_arrow, map_batches, pick

BEGIN = "<s>"
#: Opening and closing of the roles with a form of their own (fixed values of the template).
FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_OTHER = ("[ROLE] ", "[/ROLE]")
_CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]")
LEVELS = 3


def _marks(text: str, begin: int = 0) -> Iterator[tuple[int, str, int]]:
    """Begin, control string and number of backslashes before it of every control string; the time is linear in the text."""
    after = begin
    for mark in _CONTROL.finditer(text, begin):
        slashes = mark.start() - after - len(text[after : mark.start()].rstrip("\\"))
        yield mark.start(), mark[0], slashes
        after = mark.end()


def _escape(text: str, level: int) -> str:
    if level >= 1:
        parts, after = [], 0
        for at, control, slashes in _marks(text):
            parts += [text[after:at], "\\" * (slashes + 1), control]
            after = at + len(control)
        text = "".join(parts) + text[after:]
    if level >= 2:
        text += "\\" * (len(text) - len(text.rstrip("\\")))
    return text


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """The turn, and where its escaped text begins and ends."""
    if role in FORMS:
        opening, closing = FORMS[role]
    else:
        name = json.dumps(role, ensure_ascii=False).replace("<", "\\u003c").replace("[", "\\u005b")
        opening, closing = f"{_OTHER[0]}{name}\n", _OTHER[1]
    body = _escape(text, level)
    return opening + body + closing, len(opening), len(opening) + len(body)


def _opening(rendered: str, at: int) -> tuple[str, int, str]:
    """Role, begin of the text and closing of the turn that begins here."""
    if rendered.startswith(_OTHER[0], at):
        line = rendered.index("\n", at)
        return json.loads(rendered[at + len(_OTHER[0]) : line]), line + 1, _OTHER[1]
    for role, (opening, closing) in FORMS.items():
        if rendered.startswith(opening, at):
            return role, at + len(opening), closing
    raise ValueError("No turn begins here")


def read_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role and text of the turn that begins at ``at``, begin and end of its escaped text, and the turn's end.

    Any other unescaped control string than the closing one is an error.
    """
    role, begin, closing = _opening(rendered, at)
    pad = " " if closing[0] == " " else ""
    text, after = [], begin
    for at, control, slashes in _marks(rendered, begin):
        if slashes % 2:
            text += [rendered[after : at - slashes], "\\" * (slashes // 2), control]
            after = at + len(control)
            continue
        end = at - len(pad)
        if control != closing.lstrip() or end < begin or rendered[end:at] != pad:
            raise ValueError("Another mark inside a turn")
        if pad:
            text.append(rendered[after:end])  # the blank parts the text's backslashes from the mark
        else:
            text += [rendered[after : at - slashes], "\\" * (slashes // 2)]
        return role, "".join(text), begin, end, at + len(control)
    raise ValueError("A turn without end")


def safe_render(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn with the least escaping that reads back as its source, its text's place, and the level."""
    for level in range(LEVELS):
        rendered, begin, end = render(role, text, level)
        try:
            if read_turn(rendered) == (role, text, begin, end, len(rendered)):
                return rendered, begin, end, level
        except ValueError:
            continue
    raise AssertionError(f"No escaping of {text!r} reads back")


TURNS = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("rendered", pa.string()),
        ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("level", pa.int32()), ("text", pa.string()),
    ]
)


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn rendered; see :data:`TURNS`.  A conversation is ``<s>`` and its turns in order.

    ``loss_begin`` and ``loss_end`` are code points of ``rendered`` under the loss mask, null outside assistant turns.
    """

    def run(batch: pa.RecordBatch) -> dict:
        roles = [r.as_py() or "" for r in batch.column("role")]
        texts = [t.as_py() or "" for t in batch.column("text")]
        found = [safe_render(r, t) for r, t in zip(roles, texts)]
        mask = [r == "assistant" for r in roles]
        return {
            "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": roles, "rendered": [f[0] for f in found],
            "loss_begin": [f[1] if m else None for f, m in zip(found, mask)],
            "loss_end": [f[2] if m else None for f, m in zip(found, mask)], "level": [f[3] for f in found],
            "text": texts,
        }

    rows = pick(df, conv_id=(conv_col, "bigint"), turn=(turn_col, "bigint"), role=(role_col, "string"), text=(text_col, "string"))
    return map_batches(rows, TURNS, run)


READ = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


class _Reader:
    """One conversation read back from its rendered turns."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, len(BEGIN), 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, begin: int | None, end: int | None) -> None:
        role, text, at, to, stop = read_turn(rendered)
        if stop != len(rendered):
            raise ValueError("Text behind a turn")
        self.n += 1
        self.chars += len(rendered)
        self.turns.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            if (at, to) != (begin, end):
                raise ValueError("The loss mask does not cover the turn's text")
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame) -> DataFrame:
    """Every conversation as it reads in the rendered turns; see :data:`READ`."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "rendered", "loss_begin", "loss_end")]
            for conv_id, *turn in zip(*columns):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv_id)
                reader.add(*turn)
            if done:
                yield _rows(done)
        if reader is not None:
            yield _rows([reader.row()])

    return map_arrow(ordered.select("conv_id", "rendered", "loss_begin", "loss_end"), run, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ.types)], schema=READ)


def with_conversation(df: DataFrame, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    """The table with one more conversation."""
    rows = [(conv_id, i, role, text) for i, (role, text) in enumerate(turns)]
    more = df.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    kinds = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in kinds.items()]).unionByName(more)
