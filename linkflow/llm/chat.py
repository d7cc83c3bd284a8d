"""Operator 10, chat formatting with typed content parts.

A message's content is a list of parts (``type`` text, image, audio or
document; ``text``; ``ref``; ``units``). A visitor flattens them in order: a
text part becomes its escaped text, any other part a placeholder such as
``<|image|>``; its reference goes to ``attachments`` with the placeholder's
offset and the tokens it will expand to (TOKENS_PER_UNIT times its units). A
message becomes one formatted piece, ``<|im_start|>role`` line, content,
``<|im_end|>`` line; a conversation's output is its pieces in order. Pieces
are independent, so formatting shuffles nothing and a conversation of any
length never sits in one row.

Escaping: every ``<``, backslashes, ``|`` in a text gets one backslash more, so
no control string can occur inside a text; unescaping takes one away. In roles
backslash, line end and ``|`` are escaped too.

The loss mask is the span of an assistant's content in its piece
(``loss_start``, ``loss_end``; null for others; code points).

Defined results: null text, part list or part text: empty; null role: an empty
role; null units: 1; an unknown part type is a placeholder without tokens;
null conv_id: a conversation of its own, first; equal turns are ordered by role, then
text; repeated rows stay; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import sliced

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Tokens that one unit (image tile, second of audio, document page) expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
PIECE = "piece string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,at:int,tokens:bigint>>, expanded_tokens long"

_control = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<\\(\\*)\|")
_role = {"\\": r"\\", "\n": r"\n", "|": r"\p"}
_placeholder = re.compile(r"<\|([^|]*)\|>")


def escape(text: str) -> str:
    return _control.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _role[m[0]], role)


def unescape_role(role: str) -> str:
    back = {v: k for k, v in _role.items()}
    return re.sub(r"\\[\\np]", lambda m: back[m[0]], role)


class Flatten:
    """Visits parts in order and gathers text and attachments."""

    def __init__(self, at: int):
        self.out, self.at, self.attachments, self.tokens = [], at, [], 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self._add(part["text"] or "")

    def visit_other(self, part: dict) -> None:
        kind = part["type"] or ""
        units = 1 if part["units"] is None else part["units"]
        tokens = TOKENS_PER_UNIT.get(kind, 0) * units
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.at, "tokens": tokens})
        self.tokens += tokens
        self._add(f"<|{escape_role(kind)}|>")

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def flat_parts(parts: list[dict]) -> list[dict]:
    """Adjacent text parts as one, escaped together: a control string may not
    arise across their border."""
    out: list[dict] = []
    for p in parts:
        if p["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = out[-1] | {"text": (out[-1]["text"] or "") + (p["text"] or "")}
        else:
            out.append(p)
    return [p | {"text": escape(p["text"] or "")} if p["type"] == "text" else p for p in out]


def format_message(role: str | None, parts: list[dict] | None) -> tuple:
    """(piece, loss_start, loss_end, attachments, expanded_tokens)."""
    head = f"{START}{escape_role(role or '')}\n"
    v = Flatten(len(head))
    for p in flat_parts([p for p in parts or [] if p]):
        v.visit(p)
    content = "".join(v.out)
    loss = (len(head), len(head) + len(content)) if role == TRAINED else (None, None)
    return f"{head}{content}{END}\n", *loss, v.attachments, v.tokens


def parse_piece(piece: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, [(kind, unescaped text or empty)]) of one formatted piece."""
    if not (piece.startswith(START) and piece.endswith(f"{END}\n")):
        raise ValueError("a piece is not framed by control strings")
    role, _, content = piece[len(START):-len(END) - 1].partition("\n")
    runs = _placeholder.split(content)
    parts = [(unescape_role(x), "") if k % 2 else ("text", unescape(x)) for k, x in enumerate(runs)]
    return unescape_role(role), [p for p in parts if p[0] != "text" or p[1]]


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, turn, PIECE) of each message; ``parts`` is of type PARTS."""
    slim = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).cast(PARTS).alias("parts"))

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])), pa.int64()]
        for b in sliced(batches):
            rows = [format_message(r, p) for r, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            arrays = [pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["conv", "turn", "piece", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(run, f"conv {types['conv']}, turn {types['turn']}, {PIECE}").withColumnsRenamed({"conv": conv, "turn": turn})


def read_chat(pieces: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Reads formatted pieces back: (conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars) of each conversation.

    Pieces stream through a task in order of conversation and turn with only
    the running digests held: a digest over a whole conversation is one chain
    of bytes, so its rows meet in one task, but never in memory.
    """
    def run(batches):
        state, names = None, ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def closed(rows):
            cols = [*zip(*((k, n, t.hexdigest(), lc, ls.hexdigest(), fc) for k, n, t, lc, ls, fc in rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

        kind = pa.int64()
        for b in sliced(batches):
            kind, done = b.column(0).type, []
            for key, piece, s, e in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != key:
                    if state:
                        done.append(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, parts = parse_piece(piece)
                text = "".join(t for _, t in parts)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if s is not None:
                    masked = unescape(piece[s:e])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
            if done:
                yield closed(done)
        if state:
            yield closed([state])

    slim = pieces.select(F.col(conv).alias("conv"), "piece", "loss_start", "loss_end", F.col(turn).alias("turn"))
    in_order = slim.repartition(F.col("conv")).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv", "turn", "piece"))).drop("turn")
    kind = slim.schema["conv"].dataType.simpleString()
    out = in_order.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv)
