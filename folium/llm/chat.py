r"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document). A visitor flattens them into
text with ordered placeholders ``<|image:0|>`` and records, for each attachment, its
reference, and the tokens its placeholder expands to.

A turn is written as ``### role: text</turn>\n``. Inside roles and texts the signs ``\``,
``#``, ``<`` and (roles) ``:`` carry a backslash, so that no control string can come from a
text, and removing the backslashes gives the text again. Placeholders are control strings
of their own and are not escaped. The loss mask covers the text of assistant turns.

Defined cases: a null text is empty, a null role is the empty role; a null conv_id is a
conversation of its own; rows of one conversation go by turn (nulls first), then role, then
text, and repeated rows are turns of their own; an empty table gives an empty result.
A conversation is never gathered into one row: its turns are rows in order, and what spans
turns (offsets, digests) is computed in a stream over a sorted partition.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LOSS_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,ms:long,pages:int>"
FORMATTED = (
    f"conv_id long, turn long, role string, piece string, char_start long, loss_start long, loss_end long, n_tokens long, attachments array<struct<slot:int,type:string,ref:string,n_tokens:long>>"
)
_CONTROL, _ROLE_CONTROL = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_PIECE = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<\|[a-z]+:\d+\|>)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens one message. Expanded tokens: image tiles of ``tile`` pixels, audio steps of
    ``step_ms``, ``per_page`` a document page, and for text its words as an estimate."""

    tile: int = 28
    step_ms: int = 40
    per_page: int = 256
    slot: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    n_tokens: int = 0

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part: {kind}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.n_tokens += len(text.split())

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or self.tile) / self.tile) * math.ceil((part.get("height") or self.tile) / self.tile)
        self._attach("image", part, tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("ms") or 0) / self.step_ms)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.per_page)

    def _attach(self, kind: str, part: dict, n: int) -> None:
        self.out.append(f"<|{kind}:{self.slot}|>")
        self.attachments.append({"slot": self.slot, "type": kind, "ref": part.get("ref"), "n_tokens": n})
        self.n_tokens += n
        self.slot += 1


def text_part(text: Column) -> Column:
    """A column of content parts that holds one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("ms", "long"), ("pages", "int")))))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, at, slot, begun = None, 0, 0, False
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("char_start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_tokens", pa.int64()), ("attachments", pa.list_(pa.struct([("slot", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])))])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                conv, at, slot, begun = r["conv_id"], 0, 0, True
            visitor = PartVisitor(slot=slot)
            for part in r["parts"] or []:
                visitor.visit(part)
            slot = visitor.slot
            body = "".join(visitor.out)
            head = f"### {_ROLE_CONTROL.sub(r'\\\g<0>', r['role'] or '')}: "
            piece = f"{head}{body}</turn>\n"
            loss = r["role"] == LOSS_ROLE
            start = at + len(head)
            rows.append({"conv_id": conv, "turn": r["turn"], "role": r["role"], "piece": piece, "char_start": at, "loss_start": start if loss else None, "loss_end": start + len(body) if loss else None, "n_tokens": visitor.n_tokens, "attachments": visitor.attachments})
            at += len(piece)
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_conversations(messages: DataFrame) -> DataFrame:
    """Of conv_id, turn, role and parts: the formatted pieces, in order within a partition
    that holds whole conversations. Joined by char_start they are the formatted conversation."""
    ordered = messages.select("conv_id", "turn", "role", "parts").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.col("parts").cast("string"))
    return ordered.mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns (placeholders stay as they are)."""
    turns, at = [], 0
    while at < len(formatted):
        m = _PIECE.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class _Digest:
    """What one conversation's stream gives; constant memory."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.at, self.loss = conv_id, 0, 0, 0
        self.turns, self.lost = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        for role, text in parse(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(piece[start - self.at : end - self.at])
            self.loss += len(text)
            self.lost.update(text.encode())
        self.at += len(piece)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.lost.hexdigest(), "formatted_chars": self.at}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(r["conv_id"])
            now.add(r["piece"], r["loss_start"], r["loss_end"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests read back from format_conversations' output, whose order they need."""
    return formatted.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all conversations and conversation -7, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, LOSS_ROLE, tricky)], rows.schema)
    return digests(format_conversations(rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
