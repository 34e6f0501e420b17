"""Chat formatting from an event log of conversations.

``log`` has one row per event: conv_id, turn (the place of a message in its conversation), message (tells messages at one place
apart), seq (order inside the message), kind, role, text.  Kinds:

* ``open``: begins the message with a role and a first text;
* ``delta``: appends, as an answer that is streamed;
* ``edit``: the text becomes this one;
* ``regenerate``: the text so far is dropped, an answer is written anew;
* ``retract``: the message is taken back; a later ``open`` begins it again.

Folding.  The log is range-partitioned by (conversation, place), so a conversation of any size lies in as many tasks as its
share of the log asks, and the events of one message lie together; sorted by sequence, it streams through the fold, which
holds one message.  Events that are equal in all columns are one event delivered again.  Events before the first
``open`` of a message, and those of unknown kind, have no effect.

Rendering.  ``<turn>### role``, a line end, the text, ``</turn>`` and a line end.  A backslash stands before each backslash and before
each character with which ``###``, ``<turn>`` or ``</turn>`` begins inside a role or text, and before a line end in a role; reading takes it away,
so any text comes back.  The loss mask is the list of spans (code points of the formatted segment) of texts by the role ``assistant``.
A conversation is written as segments of whole turns, of up to ``SEGMENT`` characters each or one turn.

Reading back.  ``read_back`` parses segments into turns and masked texts.  A conversation that lies in one segment is digested where it
is read; segments of others are brought together by conversation and read in order as a stream, since a digest is
sequential, with only one segment in memory.

Defined results: null roles and texts are empty, null conversation ids are one conversation of their own, null places come first;
messages at one place follow in the order of ``message``; a conversation whose messages are all retracted has no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import ready

DELTA = 2000
SEGMENT = 1 << 20
ROWS = 5000
TRAINED = "assistant"
SPANS = "array<struct<start:long,end:long>>"
MESSAGES = "conv_id long, turn long, message long, role string, text string"
SEGMENTS = f"conv_id long, turn long, message long, whole boolean, formatted string, loss {SPANS}"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
EVENT = ["conv_id", "turn", "message", "seq", "kind", "role", "text"]
# fixed values: the template
BEGIN, END = "<turn>### ", "</turn>\n"
CONTROL = re.compile(r"\\|#(?=##)|<(?=/?turn>)")
CONTROL_IN_ROLE = re.compile(r"\\|\n|#(?=##)|<(?=/?turn>)")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<turn>### ((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def event_log(conversations: DataFrame) -> DataFrame:
    """The log of a service that ended with these rows, one message per row.

    Texts of the assistant are streamed in deltas of up to ``DELTA`` characters; one answer in 16 had a first draft that was regenerated, one other
    message in 16 a first version that was edited, chosen by a hash of conversation and turn.  Repeated rows are told apart by
    their place in the scan.
    """
    body = F.coalesce("text", F.lit(""))
    deltas = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda kind, text=None: F.struct(F.lit(kind).alias("kind"), (F.lit("") if text is None else text).alias("text"))
    streamed = F.transform(deltas, lambda d: event("delta", d))
    chosen = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(16)) == 0
    none = F.slice(F.array(event("delta")), 1, 0)
    draft = F.when(chosen, F.array(event("delta", F.reverse(F.coalesce(F.get(deltas, 0), F.lit("")))), event("regenerate"))).otherwise(none)
    edited = F.when(chosen, F.array(event("open", F.upper(F.substring(body, 1, 40))), event("edit", body))).otherwise(F.array(event("open", body)))
    events = F.when(F.col("role") == TRAINED, F.concat(F.array(event("open")), draft, streamed)).otherwise(edited)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", events.alias("events"), F.monotonically_increasing_id().alias("message")
    )
    return rows.select("conv_id", "turn", "message", "role", F.posexplode("events").alias("seq", "event")).select(
        "conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "event.kind", F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text"
    )


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final messages of a sorted log, in its order."""
    done: list[tuple] = []
    held = 0
    key = role = last = None
    parts: list[str] | None = None  # None while the message is not open
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for row in _rows(batches):
        conv, turn, message, seq, kind, by, text = row
        if key != (conv, turn, message):
            if parts is not None:
                done.append((*key, role, "".join(parts)))
                held += sum(map(len, parts))
            key, parts, last = (conv, turn, message), None, None
            if len(done) >= ROWS or held >= SEGMENT:
                yield flush()
                done, held = [], 0
        if row == last:
            continue
        last, text = row, text or ""
        if kind == "open":
            role, parts = by or "", [text]
        elif parts is not None:
            if kind == "delta":
                parts.append(text)
            elif kind == "edit":
                parts = [text]
            elif kind == "regenerate":
                parts = []
            elif kind == "retract":
                parts = None
    if parts is not None:
        done.append((*key, role, "".join(parts)))
    if done:
        yield flush()


def fold(log: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text of every message that the log leaves, in order within each partition.

    Partitions are ranges of (conv_id, turn); whatever reads them without a shuffle sees a conversation in order.
    """
    ready(log.sparkSession)
    ordered = log.select(*EVENT).repartitionByRange("conv_id", "turn").sortWithinPartitions(*EVENT)
    return ordered.mapInArrow(_fold, MESSAGES)


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text."""
    head, body = f"{BEGIN}{escape(role, CONTROL_IN_ROLE)}\n", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def _render(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        parts: list[str] = []
        loss: list[dict] = []
        used = held = 0
        start: tuple | None = None
        here = object()  # the conversation that is being written
        split = True  # it may have turns in another segment

        def close(whole: bool) -> None:
            nonlocal parts, loss, used, held
            done.append((*start, whole, "".join(parts), loss))
            held += used
            parts, loss, used = [], [], 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["conv_id", "turn", "message", "whole", "formatted", "loss"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for conv, turn, message, role, text in _rows(batches):
            turned, a, b = render_turn(role, text)
            if start is not None and conv != here:
                close(not split)
                split = False
            elif parts and used + len(turned) > size:
                split = True
                close(False)
            if held >= SEGMENT or len(done) >= ROWS:
                yield flush()
                done, held = [], 0
            if not parts:
                start, here = (conv, turn, message), conv
            if role == TRAINED:
                loss.append({"start": used + a, "end": used + b})
            parts.append(turned)
            used += len(turned)
        if parts:
            close(False)  # the next partition may go on with it
        if done:
            yield flush()

    return run


def render(messages: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments of formatted conversations, in order; ``messages`` as ``fold`` returns them.

    ``whole`` tells that a segment is all of its conversation; the first and last of a partition may go on elsewhere.
    """
    return messages.mapInArrow(_render(size), SEGMENTS)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        at = 0
        while at < len(formatted):
            found = TURN.match(formatted, at)
            if found is None:
                raise ValueError("a segment is not a row of turns")
            self.n_turns += 1
            self.turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
            at = found.end()
        self.chars += len(formatted)
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of segments with the same conversation."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done, here, now = [], None, None
    for conv, formatted, loss in _rows(batches):
        if now is not None and conv != here:
            done.append(now.row(here))
            now = None
            if len(done) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        here, now = conv, now or _Digest()
        now.add(formatted, loss)
    if now is not None:
        done.append(now.row(here))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def read_back(segments: DataFrame) -> DataFrame:
    """Number of turns and digests of each conversation, parsed from its formatted segments."""
    ready(segments.sparkSession)
    shown = ["conv_id", "formatted", "loss"]
    alone = segments.filter("whole").select(*shown).mapInArrow(_digest, DIGESTS)
    apart = segments.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message").select(*shown).mapInArrow(_digest, DIGESTS)
    return alone.union(apart)


def write_formatted(log: DataFrame, folder: str, size: int = SEGMENT) -> None:
    """Fold ``log`` and write the formatted segments to ``folder``."""
    render(fold(log), size).write.option("compression", "zstd").parquet(folder)


def read_formatted(spark, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(folder)
