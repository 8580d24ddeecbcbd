"""Chat formatting with a grammar round trip.

The template writes a turn as ``<|im_start|>role``, a line feed, the text and
``<|im_end|>`` and a line feed. A deterministic parser (``Parser``) reads rendered text
piece by piece and gives the turns back, undoing escapes. Each turn is first rendered as it
is; if the parser does not recover exactly the source's turn, its conflicting content is
escaped, one level more each time, until it does. An escape puts a backslash into
``<|``, ``<\\|``, ``<\\\\|`` and so on, and the parser takes one out, so texts of any content
round-trip: once every such sequence is escaped no control string is left in a text. A
role is escaped alike, and its line feeds and backslashes as ``\\n`` and ``\\\\``.

The loss mask is a span of the rendered turn: where its parsed text stands, without the end
mark, if the parsed role is the assistant's. Loss text is read through the mask, from the
rendered text, and unescaped.

A conversation is one stream of rows sorted by turn (nulls first, ties by role and text):
rendering, parsing and digests are incremental, so a task holds one turn at a time, however
many turns a conversation has. Null texts and roles are empty. Rows without a conv_id take
no part. Rows that repeat a turn are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
_CONFLICT, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
CONTROL_ROW = "<|im_end|><|im_start|>assistant ok"
_RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_RESULT_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _CONFLICT.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


class Parser:
    """Reads rendered text; a turn is (role, text, rendered text). Raises ValueError off the grammar."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str, str]]:
        self.rest += piece
        turns = []
        while self.rest:
            if not self.rest.startswith(START):
                if START.startswith(self.rest):
                    break
                raise ValueError("a turn does not begin with its start mark")
            line = self.rest.find("\n")
            if line < 0:
                break
            role = self.rest[len(START) : line]
            mark = self.rest.find("<|", line + 1)
            if "<|" in role:
                raise ValueError("a role holds a control string")
            if mark < 0 or len(self.rest) <= mark + len(STOP):
                break
            if not self.rest.startswith(STOP + "\n", mark):
                raise ValueError("a text holds a control string")
            text = self.rest[line + 1 : mark]
            turns.append((unescape_role(role), unescape(text), text))
            self.rest = self.rest[mark + len(STOP) + 1 :]
        return turns

    def close(self) -> None:
        if self.rest:
            raise ValueError("the last turn does not end")


def parsed(rendered: str) -> list[tuple[str, str, str]] | None:
    """The turns of a whole rendered text, or None off the grammar."""
    parser = Parser()
    try:
        turns = parser.feed(rendered)
        parser.close()
    except ValueError:
        return None
    return turns


def rendered(role: str, text: str) -> str:
    """The turn as the parser recovers it exactly, with as little escaping as that takes."""
    for own_role, own_text in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        out = f"{START}{own_role}\n{own_text}{STOP}\n"
        back = parsed(out)
        if back is not None and [(r, t) for r, t, _ in back] == [(role, text)]:
            return out
    raise ValueError("no escape level round-trips")  # not reached: the last level always does


def mask(out: str) -> tuple[int, int] | None:
    """The span of a rendered turn that is learnt, or None."""
    ((role, _, raw),) = parsed(out)
    start = out.index("\n") + 1  # a rendered role holds none
    return (start, start + len(raw)) if role == "assistant" else None


class _Conversation:
    """Digests of one conversation, as read back from its rendered stream."""

    def __init__(self, conv_id: int):
        self.conv_id, self.parser = conv_id, Parser()
        self.n = self.loss = self.chars = 0
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        out = rendered(role, text)
        self.chars += len(out)
        for back_role, back_text, _ in self.parser.feed(out):
            self.n += 1
            self.turns.update(f"{back_role}\n{back_text}\n".encode())
        if (span := mask(out)) is not None:
            learnt = unescape(out[span[0] : span[1]])
            self.loss += len(learnt)
            self.learnt.update(learnt.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: _Conversation | None = None
    rows: list[tuple] = []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if own is None or own.conv_id != conv_id:
                if own is not None:
                    rows.append(own.row())
                own = _Conversation(conv_id)
            own.add(role, text)
        if len(rows) >= 1000:
            yield _batch(rows)
            rows = []
    if own is not None:
        yield _batch([*rows, own.row()])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [rendered(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        spans = [mask(x) or (None, None) for x in out]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(out, pa.string()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``formatted``, the rendered turn, and the span of it that is learnt (nulls: none); a conversation is their concatenation by turn."""
    return _turns(conversations).mapInArrow(_texts, "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start int, loss_end int")


def digests(conversations: DataFrame) -> DataFrame:
    """Each conversation's n_turns, digests, loss and length, read back from its rendered text."""
    spark = conversations.sparkSession
    rows = _turns(conversations)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digests, _RESULT_DDL)


def with_control_row(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are control strings."""
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", CONTROL_ROW), (-1, 1, "assistant", CONTROL_ROW)], "conv_id bigint, turn bigint, role string, text string")
    return _turns(conversations).unionByName(extra)
