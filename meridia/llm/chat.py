"""Chat formatting: typed content parts, control strings and the loss mask.

A visitor flattens the parts of a message (text, image, audio, document) into
text with ordered placeholders, and records each attachment's reference and how
many tokens it expands to. Turns are marked by control strings; control strings
inside texts are broken by a backslash after their first character, and
backslashes are doubled, so that reading back is exact.

Turns are formatted where they lie. Then the rows of a conversation meet in one
task, sorted by turn, and stream through it: a running hash per conversation is
all that is held, so a conversation may be of any length. (A hash over one text
is sequential; that is why a conversation isn't split.)

Nulls and edges: a null role or text is empty; null conversation ids form one
conversation; equal turn numbers are ordered by role, then text as it is read
back (null turns first); with `typed`, what is no list of parts is one text, and
malformed parts are read as `PartVisitor` says; an empty table yields no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this template and of others; their first character may not stand before the rest inside a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_RAW = re.compile(r"\\(.)", re.S)

#: Tokens that a unit of an attachment expands to: an image tile, a second of sound, a page.
TOKENS = {"image": (85, 170), "audio": (4, 25), "document": (8, 500)}
MOST_UNITS = 10**9


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _RAW.sub(lambda m: m[1], text)


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _units(value, missing: int) -> float:
    """A number of units, or `missing` if it is none."""
    plain = isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= MOST_UNITS
    return value if plain else missing


class PartVisitor:
    """Flattens typed parts in order.

    Unknown types are kept as placeholders that expand to nothing. A text that is
    no string is written as JSON; a null one is empty. A number of units that is
    no number from 0 to MOST_UNITS counts as missing: an image has one tile then,
    a document one page, a sound no second.
    """

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(_text(part.get("text"))))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, _units(part.get("tiles"), 1))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, _units(part.get("seconds"), 0))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, _units(part.get("pages"), 1))

    def visit_other(self, part: dict) -> None:
        self._attach(re.sub(r"\W", "_", str(part["type"])), part, 0)

    def _attach(self, kind: str, part: dict, units: int) -> None:
        fixed, each = TOKENS.get(kind, (0, 0))
        k = len(self.attachments)
        self.attachments.append({"index": k, "kind": kind, "ref": _text(part.get("ref")), "tokens": int(fixed + each * units)})
        self.out.append(f"<|{kind}:{k}|>")


def flatten(parts: list[dict]) -> tuple[str, list[dict]]:
    """The escaped text with placeholders, and the attachments in order."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    return "".join(visitor.out), visitor.attachments


def parts_of(content: str | None) -> list[dict]:
    """A JSON list of objects that each name a type is a list of parts; anything else is one text."""
    if content and content.startswith("[{") and '"type"' in content:
        try:
            found = json.loads(content)
        except ValueError:
            found = None
        if isinstance(found, list) and all(isinstance(x, dict) and isinstance(x.get("type"), str) for x in found):
            return found
    return [{"type": "text", "text": content or ""}]


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The marked turn, where its body starts and ends in it, and its attachments."""
    body, attachments = flatten(parts)
    head = f"{OPEN}{escape(role or '')}{BODY}"
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body), attachments


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(CLOSE), re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, body start, body end) of every turn of a formatted text; placeholders stay as they are."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        yield unescape(turn[1]), unescape(turn[2]), turn.start(2), turn.end(2)
        at = turn.end()


_PLACEHOLDER = re.compile(r"<\|(\w+):(\d+)\|>")


def read_parts(body: str) -> list[tuple[str, str]]:
    """A formatted body's parts in order: ("text", unescaped text) or (kind, number of the attachment).

    A placeholder that was said as text has a backslash within, so it is read back as text.
    """
    out, at = [], 0
    for found in _PLACEHOLDER.finditer(body):
        if found.start() > at:
            out.append(("text", unescape(body[at : found.start()])))
        out.append((found[1], found[2]))
        at = found.end()
    return out + [("text", unescape(body[at:]))] * (at < len(body))


SEGMENT = "conv_id bigint, turn bigint, role string, segment string, body_start int, body_end int, attachments array<struct<index:int,kind:string,ref:string,tokens:bigint>>"
_ATTACHMENTS = pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def segments(rows: DataFrame, *, typed: bool = False) -> DataFrame:
    """Each row's formatted turn; a conversation's text is its segments in order.

    rows: conv_id, turn, role, text. With `typed`, a text that is a JSON list of
    typed parts is flattened as such; else every text is one text part.
    """
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [format_turn(r, parts_of(t) if typed else [{"type": "text", "text": t}]) for r, t in zip(roles, texts)]
            columns = list(zip(*made)) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], _ATTACHMENTS)],
                names=["conv_id", "turn", "role", "segment", "body_start", "body_end", "attachments"],
            )

    return plain.mapInArrow(run, SEGMENT)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, expanded_tokens bigint"


class _Running:
    """One conversation as it streams by."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attachments = self.tokens = 0

    def add(self, segment: str, attachments: list[dict]) -> None:
        for role, text, _, _ in read_turns(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(segment)
        self.attachments += len(attachments)
        self.tokens += sum(x["tokens"] for x in attachments)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def digest(rows: DataFrame, *, typed: bool = False) -> DataFrame:
    """The contract's row per conversation, read back from the formatted text."""
    # ties go by the text as it is read back, not by its escaped form
    body = F.substring("segment", F.col("body_start") + 1, F.col("body_end") - F.col("body_start"))
    said = F.regexp_replace(body, r"(?s)\\(.)", "$1")
    made = segments(rows, typed=typed).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, segment, attachments in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist(), batch.column("attachments").to_pylist()):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Running(conv)
                now.add(segment, attachments)
            if done:
                yield _rows(done)
                done = []
        if now is not None:
            yield _rows([now.row()])

    return made.select("conv_id", "segment", "attachments").mapInArrow(run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts are control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
