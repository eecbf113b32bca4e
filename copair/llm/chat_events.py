"""Chat formatting by event-sourced reconstruction.

A log holds events ``(conv_id, seq, message, kind, role, text)``:

* ``delta``       appends ``text`` to the message,
* ``edit``        replaces the message's text so far by ``text``,
* ``regenerate``  discards the message so far and every later message begun
                  before it; ``text`` starts the new version.

Reconstruction partitions the log by conversation and sorts by sequence.  Two
windows over that one partitioning find the last reset of each message and the
last regeneration of an earlier message; events before them are dead.  Both
windows spill, so a conversation with a third of all rows needs no more memory.
The live events, sorted by message and sequence, are then folded in one stream
that holds a single message at a time, escaped and rendered.

Template, one segment per message::

    <|turn|>role NEWLINE text<|end|> NEWLINE

Control strings (this template's and other common ones) inside roles and texts
are broken by a backslash after their first character and every backslash is
doubled, so a segment is parsed back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that a text must not contain unescaped (fixed values).
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.?)", re.S)
LOSS_ROLE = "assistant"
_ROWS_OUT = 2000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    # a doubled backslash stands for one; a single one was put into a control string
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """Segment, and the span of its text under the loss mask (empty unless the role is trained)."""
    head = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    start = len(head)
    return f"{head}{body}{END}\n", start, start + len(body) if role == LOSS_ROLE else start


def parse(segment: str) -> tuple[str, str]:
    """``(role, text)`` of one segment."""
    if not (segment.startswith(TURN) and segment.endswith(f"{END}\n")):
        raise ValueError("not a segment of this template")
    head, _, body = segment[len(TURN):-len(END) - 1].partition("\n")
    role = re.sub(r"\\(.?)", lambda m: {"n": "\n"}.get(m[1], m[1]), head)
    return role, unescape(body)


def live_events(events: DataFrame) -> DataFrame:
    """Drop events that an edit or a regeneration has replaced."""
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    own = Window.partitionBy("conv_id", "message")
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("__cut", again.over(earlier)).withColumn("__reset", reset.over(own))
    return marked.where("(__cut IS NULL OR seq > __cut) AND (__reset IS NULL OR seq >= __reset)").drop("__cut", "__reset")


def format_conversations(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, segment, loss_start, loss_end)``: a row per final message.

    Needs ``conv_id, seq, message long; kind, role, text string``.  A null text is
    empty, a null role is an empty role, the first role of a message counts.  Equal
    ``seq`` within a message are ordered by text; null ids form their own
    conversation.  An empty log gives no rows; more columns are not read.
    Rows of a conversation lie in one partition, in order.
    """
    read = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"),
                         F.col("message").cast("long").alias("message"), "kind",
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = live_events(read).select("conv_id", "message", "seq", "role", "text").sortWithinPartitions(
        "conv_id", "message", "seq", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
                        ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv = message = role = None
        parts: list[str] = []
        turn = -1

        def close() -> None:
            segment, start, end = render(role, "".join(parts))
            out.append((conv, turn, role, segment, start, end))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "message", "role", "text")]
            for c, m, r, t in zip(*columns):
                if turn < 0 or c != conv or m != message:
                    if turn >= 0:
                        close()
                    turn = turn + 1 if turn >= 0 and c == conv else 0
                    conv, message, role, parts = c, m, r, []
                    if len(out) >= _ROWS_OUT:
                        yield flush()
                parts.append(t)
        if turn >= 0:
            close()
        if out:
            yield flush()

    return ordered.mapInArrow(fold, "conv_id long, turn long, role string, segment string, loss_start long, loss_end long")


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of formatted conversations, parsed from the segments alone.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``;
    a stream over the sorted segments of ``format_conversations``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> tuple:
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            return conv, state["n"], turns, state["loss_chars"], loss, state["chars"]

        for batch in batches:
            out = []
            for c, segment, start, end in zip(*(batch.column(n).to_pylist()
                                                for n in ("conv_id", "segment", "loss_start", "loss_end"))):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row())
                    conv = c
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
                role, text = parse(segment)
                trained = unescape(segment[start:end])
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["loss"].update(trained.encode("utf-8", "surrogatepass"))
                state["n"] += 1
                state["loss_chars"] += len(trained)
                state["chars"] += len(segment)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), schema)], schema=schema)

    return segments.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` as a log: one delta per row, one message per row.

    Rows of one turn are separate messages, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")
