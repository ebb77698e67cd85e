"""Chat formatting from an event log.

A conversation is a log of events. An event belongs to a message and is one of

- ``start``: the message begins; carries its role,
- ``delta``: text to append, as it was streamed,
- ``edit``: the text becomes the event's text,
- ``regenerate``: the text so far is dropped, new deltas follow,
- ``delete``: the message is withdrawn.

Logs are partitioned by conversation and sorted by message and sequence, so one pass folds the events into
final messages and renders them, with one message and one segment of output in memory. A long
conversation gives several segments, cut between messages. Conversations without messages give none.

Template: ``<|im_start|>ROLE``, a line feed, the text, ``<|im_end|>``, a line feed. Inside roles and texts a
backslash is doubled and the first character of each control string (and a line feed in a role) becomes
``\\u`` and four hex digits, so no control string can come from a text, and reading undoes it exactly.
Null roles and texts count as empty; events of unknown kind and null kinds change nothing.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_CHARS = 1 << 20
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>",
)
_STARTS = "|".join(re.escape(c) for c in CONTROL)
_IN_TEXT = re.compile(rf"\\|(?=(?:{_STARTS}))[\s\S]")
_IN_ROLE = re.compile(rf"\\|\n|(?=(?:{_STARTS}))[\s\S]")
_ESCAPED = re.compile(r"\\(?:\\|u([0-9a-f]{4}))")
_TURN = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n([\s\S]*?){re.escape(END)}\n")


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\u{ord(m[0]):04x}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\\", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted message, and where its text begins and ends in it."""
    head = f"{BEGIN}{escape(role, _IN_ROLE)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted messages."""
    out, at = [], 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            break
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    if at != len(formatted):
        raise ValueError(f"no message begins at character {at}")
    return out


def rows_to_events(rows: DataFrame, piece: int = 256) -> DataFrame:
    """The log of conversations that are stored as finished rows (``conv_id``, ``turn``, ``role``, ``text``).

    A row becomes a ``start`` and one ``delta`` per ``piece`` characters. Rows of one turn are ordered by role, then
    by a hash of the text; repeated rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.ceil(F.length(text) / piece).cast("int")
    message = F.struct("turn", "role", F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    numbered = rows.select("conv_id", "role", message.alias("message"), text.alias("all"), pieces.alias("n")).withColumn(
        "seq", F.explode(F.sequence(F.lit(0), F.col("n")))
    )
    first = F.col("seq") == 0
    return numbered.select(
        "conv_id", "message", "seq", F.when(first, "start").otherwise("delta").alias("kind"), F.when(first, F.col("role")).alias("role"),
        F.when(~first, F.substr("all", (F.col("seq") - 1) * piece + 1, F.lit(piece))).alias("text"),
    )


def _messages(batches):
    """Final messages in order: conversation, role, text. The events come sorted."""
    here = None
    role, parts, alive = "", [], False
    for batch in batches:
        for event in batch.to_pylist():
            key = (event["conv_id"], event["message"])
            if here is None or key != here[0]:
                if alive:
                    yield here[0][0], role, "".join(parts)
                here, role, parts, alive = (key,), "", [], True
            kind, text = event["kind"], event["text"] or ""
            if kind == "start":
                role = event["role"] or ""
            elif kind == "delta":
                parts.append(text)
            elif kind == "edit":
                parts = [text]
            elif kind == "regenerate":
                parts = []
            elif kind == "delete":
                alive = False
    if alive:
        yield here[0][0], role, "".join(parts)


def format_log(events: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations: ``conv_id``, ``segment`` (from 0), ``formatted`` and ``loss``, the spans of code points
    that are learned (the texts of ``learn_roles``). ``events``: ``conv_id``, ``message``, ``seq``, ``kind``, ``role``, ``text``."""
    span = T.StructType().add("start", "long", False).add("end", "long", False)
    schema = (
        T.StructType().add("conv_id", events.schema["conv_id"].dataType).add("segment", "integer", False)
        .add("formatted", "string", False).add("loss", T.ArrayType(span, False), False)
    )
    arrow = pa.schema(
        [
            ("segment", pa.int32()), ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches):
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []
        size, open_, number, parts, spans, chars = 0, None, 0, [], [], 0

        def batch():
            ids, *rest = zip(*rows, strict=True)
            columns = [pa.array(c, f.type) for c, f in zip(rest, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), *columns], ["conv_id", *arrow.names])

        def noted():
            for batch_in in batches:
                kinds.append(batch_in.schema.field("conv_id").type)
                yield batch_in

        for conv, role, text in _messages(noted()):
            other = open_ is not None and open_[0] != conv
            if open_ is not None and (other or chars >= SEGMENT_CHARS):
                rows.append((open_[0], number, "".join(parts), spans))
                size += chars
                number, parts, spans, chars = (0 if other else number + 1), [], [], 0
                if size >= SEGMENT_CHARS or len(rows) >= 4096:
                    yield batch()
                    rows, size = [], 0
            open_ = (conv,)
            piece, begin, end = render(role, text)
            if role in learn_roles:
                spans.append({"start": chars + begin, "end": chars + end})
            parts.append(piece)
            chars += len(piece)
        if open_ is not None:
            rows.append((open_[0], number, "".join(parts), spans))
            yield batch()

    log = events.select("conv_id", "message", "seq", "kind", "role", "text")
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq")
    return ordered.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations: number of turns, SHA-256 of roles and texts, length and SHA-256 of what is
    learned, and number of characters. Segments of a conversation are read in order, one at a time."""
    schema = (
        T.StructType().add("conv_id", formatted.schema["conv_id"].dataType).add("n_turns", "long", False)
        .add("turns_sha256", "string", False).add("loss_chars", "long", False).add("loss_sha256", "string", False)
        .add("formatted_chars", "long", False)
    )
    names = schema.names

    def run(batches):
        out, open_ = [], None

        def close():
            turns, all_, learned, loss, chars = open_[1:]
            out.append((open_[0], turns, all_.hexdigest(), learned, loss.hexdigest(), chars))

        def batch():
            ids, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c) for c in rest]], names)

        for rows in batches:
            kind = rows.schema.field("conv_id").type
            for row in rows.to_pylist():
                if open_ is None or open_[0] != row["conv_id"]:
                    if open_ is not None:
                        close()
                    open_ = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"]):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["formatted"][span["start"] : span["end"]])
                    open_[3] += len(text)
                    open_[4].update(text.encode())
                open_[5] += len(row["formatted"])
            if out:
                yield batch()
                out.clear()
        if open_ is not None:
            close()
            yield batch()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, schema)
