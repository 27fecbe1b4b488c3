"""Chat formatting by event-sourced reconstruction.

A log of events is folded into final messages: ``open`` starts a message (its role), ``delta``
appends streamed text, ``edit`` replaces the text, ``regenerate`` discards what was streamed so
far. Messages are then rendered with a template that marks turns and escapes its control
strings reversibly, and the loss mask covers the assistant's texts.

The fold runs per message, sorted by the log's sequence, and holds one message at a time, so a
conversation of any length is spread over tasks; only the last step, which joins a conversation's
rendered turns in order, reads it in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that must not stand in a text as they are; a backslash goes in after their first character.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
#: Columns that order a log: the turn, a key of the message, its number, the event's number in it.
SEQUENCE = ("turn", "tie", "message", "step")
EVENT_FIELDS = ("conv_id", *SEQUENCE, "kind", "role", "text")


def conversation_events(conversations: DataFrame, piece: int = 400) -> DataFrame:
    """A log in the shape of a streaming service, from (conv_id, turn, role, text) rows.

    Assistant turns are streamed in pieces, with a first draft that is discarded; user turns are
    sent and then edited. Rows of one turn are told apart by their content and position.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"))
    rows = rows.select("*", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("message"))
    size = F.length("text")

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.cast("string").alias("text"))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / piece).cast("int") - 1, F.lit(0))), lambda k: event("delta", F.substring(F.col("text"), k * piece + 1, F.lit(piece))))
    draft = F.array(event("open", F.lit(None)), event("delta", F.substring(F.col("text"), F.lit(1), F.lit(piece))), event("regenerate", F.lit(None)))
    typed = F.array(event("open", F.lit(None)), event("delta", F.substring(F.col("text"), F.lit(1), F.lit(piece))), event("edit", F.col("text")))
    events = F.when(F.col("role") == LOSS_ROLE, F.concat(draft, pieces)).otherwise(typed)
    return rows.select("conv_id", "turn", "tie", "message", "role", F.posexplode(events).alias("step", "event")).select("conv_id", "turn", "tie", "message", F.col("step").cast("long"), "event.kind", "role", "event.text")


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, message, role, text): the final state of every message.

    An event before any ``open`` opens the message itself; unknown kinds and null texts change
    nothing; an edit with a null text empties the message.
    """
    names = ["conv_id", "turn", "tie", "message", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, done = None, None, [], []

        def close() -> None:
            if key is not None:
                done.append((*key, role, "".join(parts)))

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            size = 0
            for conv, turn, tie, message, kind, who, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "tie", "message", "kind", "role", "text")), strict=True):
                if (conv, turn, tie, message) != key:
                    close()
                    key, role, parts = (conv, turn, tie, message), who, []
                if kind == "open":
                    role = who
                elif kind == "delta" and text:
                    parts.append(text)
                elif kind == "edit":
                    parts = [text or ""]
                elif kind == "regenerate":
                    parts = []
                size += len(text or "")
                if size > 4 << 20:
                    yield batch_of(batch.schema)
                    size = 0
            yield batch_of(batch.schema)
            last = batch.schema
        close()
        if done:
            yield batch_of(last)

    keys = ["conv_id", "turn", "tie", "message"]
    schema = events.select(*names).schema
    return events.select(*EVENT_FIELDS).repartition(*keys).sortWithinPartitions(*keys, "step").mapInArrow(run, schema)


def escape(text: Column, is_role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if is_role else out


def unescape(text: str, is_role: bool = False) -> str:
    return re.sub(r"\\(.)", (lambda m: "\n" if m[1] == "n" else m[1]) if is_role else r"\1", text, flags=re.DOTALL)


def render(messages: DataFrame) -> DataFrame:
    """Each message with ``segment``, its rendered turn, and ``loss``, the [from, to) code points of
    the segment that the loss mask covers (null for roles other than the assistant)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    body = escape(F.col("text"))
    masked = F.when(F.col("role") == LOSS_ROLE, F.struct(F.length(head).alias("a"), (F.length(head) + F.length(body)).alias("b")))
    return messages.select("conv_id", "turn", "tie", "message", F.concat(head, body, F.lit(f"{CLOSE}\n")).alias("segment"), masked.alias("loss"))


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def parse_segment(segment: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of rendered output, unescaped."""
    return [(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(segment)]


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render a log: one row per final message with its rendered turn and loss mask."""
    return render(fold_messages(events))


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered turns in order: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    A digest over a conversation is sequential by nature; a task streams it and holds one
    batch of turns and the running state. Null conversation ids are one conversation; an empty
    table gives no rows; turns with equal numbers follow their content.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, kind = None, [], None

        def close() -> None:
            if state is not None:
                conv, turns, whole, loss_chars, loss, chars = state
                done.append((conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, segment, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_segment(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    text = unescape(segment[loss["a"] : loss["b"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(segment)
            yield batch_of()
        close()
        if done:
            yield batch_of()

    order = ["conv_id", "turn", "tie", "message"]
    conv = segments.schema["conv_id"].dataType.simpleString()
    sorted_ = segments.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "loss")
    return sorted_.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
