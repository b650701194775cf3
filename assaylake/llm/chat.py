r"""Chat turns as training text, with a template that can be read back exactly.

A conversation is a row of turns. A turn is a header, the text, and an end line::

    ### User: text
    </turn>

Headers and ``</turn>`` are control strings. A text that would not read back as itself is escaped: each control string
inside gets one more backslash in front, and reading takes one off. So a turn is rendered as it is, parsed, compared with
its source, and escaped until both are the same; most texts stay untouched. The grammar is prefix-free: where a turn ends
is known from the turn alone, so turns rendered one by one are the conversation when written one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from assaylake.llm.common import whole_text

NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {name: role for role, name in NAMED.items()}
END = "\n</turn>\n"
LOSS_ROLES = ("assistant",)

_CONTROL = re.compile(r"</turn>|### (?:System: |User: |Assistant: |Role)")
_ESCAPED = re.compile(r"\\(?=</turn>|### (?:System: |User: |Assistant: |Role))")
_HEADER = re.compile(r'### (?:(System|User|Assistant): |Role(?: "([^"\\]*(?:\\.[^"\\]*)*)")?: )', re.DOTALL)


# ---- grammar ---------------------------------------------------------------------------------
def header(role: str | None) -> str:
    """Other roles are quoted; no role has no name."""
    if role in NAMED:
        return f"### {NAMED[role]}: "
    return "### Role: " if role is None else '### Role "' + re.sub(r'["\\]', r"\\\g<0>", role) + '": '


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def parse_turn(formatted: str, at: int = 0) -> tuple[str | None, int, int, int] | None:
    """Role, begin and end of the (still escaped) text, and end of the turn that begins at ``at``; None if none does."""
    found = _HEADER.match(formatted, at)
    if not found:
        return None
    begin = found.end()
    for control in _CONTROL.finditer(formatted, begin):
        low, high = control.span()
        if low > begin and formatted[low - 1] == "\\":
            continue
        whole = low > begin and formatted.startswith(END, low - 1)
        if not whole:
            return None  # a bare control string inside a text
        role = ROLES[found[1]] if found[1] else found[2] and re.sub(r"\\(.)", r"\1", found[2], flags=re.DOTALL)
        return role, begin, low - 1, high + 1
    return None


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and texts of all turns."""
    turns, at = [], 0
    while at < len(formatted):
        turn = parse_turn(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        role, begin, end, at = turn
        turns.append((role, unescape(formatted[begin:end])))
    return turns


def render_turn(role: str | None, text: str) -> tuple[str, int, int, int]:
    """The turn, begin and end of its text in it, and how often it had to be escaped."""
    head, body = header(role), text
    for rounds in range(3):
        out = head + body + END
        turn = parse_turn(out)
        if turn and turn[3] == len(out) and turn[0] == role and unescape(out[turn[1] : turn[2]]) == text:
            return out, turn[1], turn[2], rounds
        body = escape(body)
    raise ValueError(f"a turn of role {role!r} does not read back")


# ---- tables ----------------------------------------------------------------------------------
def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Per turn: ``conv_id, turn, formatted, loss_start, loss_end, escapes``; no rows are exchanged.

    A conversation's text is its rows' ``formatted`` in the order of ``turn`` (nulls first, then by ``formatted``).
    Places count code points within the row; they are null where the loss does not see the turn. Null texts are empty,
    null roles stay null, repeated rows are repeated turns, and rows without conversation id are one conversation.
    """

    @arrow_udf("struct<formatted: string, loss_start: bigint, loss_end: bigint, escapes: int>")
    def render(roles: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for role, text in zip(roles.to_pylist(), texts.to_pylist(), strict=True):
            out, begin, end, rounds = render_turn(role, text)
            rows.append((out, begin, end, rounds) if role in loss_roles else (out, None, None, rounds))
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["formatted", "loss_start", "loss_end", "escapes"])

    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), render(F.col(role_col).cast("string"), whole_text(text_col)).alias("made"))
    return turns.select("conv_id", "turn", "made.*")


class _Reading:
    """One conversation read piece by piece: digests and counts, and the text of a turn that has not ended yet."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, piece: str, start: int | None, end: int | None) -> None:
        if start is not None:
            seen = unescape(piece[start:end])
            self.loss.update(seen.encode())
            self.loss_chars += len(seen)
        self.chars += len(piece)
        self.rest += piece
        at = 0
        while turn := parse_turn(self.rest, at):
            role, begin, stop, at = turn
            self.turns.update(f"{role or ''}\n{unescape(self.rest[begin:stop])}\n".encode())
            self.n_turns += 1
        self.rest = self.rest[at:]

    def row(self, conv_id) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv_id!r} does not end with a whole turn")
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, held, reading, done = pa.int64(), None, None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for part in batches:
        kind = part.schema.field(0).type
        for conv_id, piece, start, end in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if reading is None or conv_id != held:
                if reading:
                    done.append(reading.row(held))
                held, reading = conv_id, _Reading()
            reading.feed(piece, start, end)
        if len(done) >= 10_000:
            yield batch(done)
            done = []
    if reading:
        done.append(reading.row(held))
    if done:
        yield batch(done)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted text: ``n_turns``, digest of role and text of all turns, code points and
    digest of what the loss sees, and ``formatted_chars``.

    Turns stream through a parser in order, with two running digests and one turn as state, so a conversation of any
    length takes constant memory. A digest runs over a whole conversation one turn after the other: that chain, and
    nothing else, is one task's work for a conversation that holds many of the rows.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    turns = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return turns.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_fold, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
