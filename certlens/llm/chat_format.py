"""Chat formatting: conversations rebuilt from an event log, then rendered.

The log has one row per event: (conversation, sequence, op, message, role, text).

* ``start`` opens a message (role, first text) under its id;
* ``delta`` appends streamed text to a message;
* ``edit`` replaces a message's text;
* ``regenerate`` empties a message and drops all later ones: what streams in next
  is the new answer;
* ``delete`` drops a message.

The log is dealt by conversation, sorted by sequence within the partition, and
folded while it streams by: only the messages of the conversation at hand are in
memory. A conversation is one output row, so it can't be spread over tasks.

Template: user ``[INST] text [/INST]``, assistant ``[ANSWER] text</s>``, system
``[SYSTEM] text [/SYSTEM]``, any other role ``[TURN] role [:] text [/TURN]``, after
one ``<s>``. In texts a backslash and every control string get a backslash in
front, so the rendering can be read back exactly. The loss mask is the code point
ranges of assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN = "<s>"
# What stands around a turn's text.
AROUND = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", "</s>"), "system": ("[SYSTEM] ", " [/SYSTEM]")}
OTHER = ("[TURN] ", " [:] ", " [/TURN]")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "[SYSTEM]", "[/SYSTEM]", "[TURN]", "[:]", "[/TURN]")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TOKEN = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROL)), re.S)

EVENTS = "conv_id long, seq long, op string, message long, role string, text string"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """(op, message, role, text) in sequence -> final (role, text) turns. Events
    for a message that isn't there open it (role of the event, else assistant)."""
    turns: dict[int, tuple[str, list[str]]] = {}
    for op, message, role, text in events:
        if op == "delete":
            turns.pop(message, None)
            continue
        if op == "regenerate":
            names = list(turns)
            if message in turns:
                for later in names[names.index(message) + 1 :]:
                    del turns[later]
        if op == "start" or message not in turns:
            turns.pop(message, None)
            turns[message] = (role if role is not None or op == "start" else "assistant", [])
        elif op in ("edit", "regenerate"):
            turns[message][1].clear()
        turns[message][1].append(text or "")
    return [(role or "", "".join(parts)) for role, parts in turns.values()]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    out, mask, size = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        before, after = AROUND.get(role, (OTHER[0] + escape(role) + OTHER[1], OTHER[2]))
        body = escape(text)
        if role == "assistant":
            mask.append((size + len(before), size + len(before) + len(body)))
        out += [before, body, after]
        size += len(before) + len(body) + len(after)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: only control strings that no
    backslash escapes count."""
    marks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(formatted) if m[0][0] != "\\"]
    opening = {before.strip(): role for role, (before, _) in AROUND.items()}
    turns, i = [], 1
    while i < len(marks):
        _, end, mark = marks[i]
        if mark in opening:
            role = opening[mark]
            close = marks[i + 1][0]
            text = formatted[end + 1 : close if role == "assistant" else close - 1]
            i += 2
        else:
            role = unescape(formatted[end + 1 : marks[i + 1][0] - 1])
            text = formatted[marks[i + 1][1] + 1 : marks[i + 2][0] - 1]
            i += 3
        turns.append((role, unescape(text)))
    return turns


def events_of_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = 1000) -> DataFrame:
    """The event log of a table of whole turns: each starts a message, its text
    streams in as deltas of ``piece`` code points. Turns of equal number go by
    role and text, null numbers first; a null text is empty."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    flat = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = flat.withColumn("message", F.row_number().over(order).cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / piece).cast("int")), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))
    parts = F.concat(F.array(F.lit("")), pieces)
    each = placed.select("conv_id", "message", "role", F.posexplode(parts).alias("i", "part"))
    return each.select("conv_id", (F.col("message") * F.lit(1 << 31) + F.col("i")).alias("seq"), F.when(F.col("i") == 0, "start").otherwise("delta").alias("op"),
                       "message", F.when(F.col("i") == 0, F.col("role")).alias("role"), F.col("part").alias("text"))


_OUT = "conv_id long, formatted string, loss_mask array<struct<start:long,end:long>>"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    held: list[tuple] = []
    now: list = []
    ready: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.string()),
             pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in ready], mask_type)], names=["conv_id", "formatted", "loss_mask"])

    for batch in batches:
        for conv, _, op, message, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not now or now[0] != conv:
                if now:
                    ready.append((now[0], *render(fold(iter(held)))))
                    size += len(ready[-1][1])
                now, held = [conv], []
                if size > 4 << 20:
                    yield flush()
                    ready, size = [], 0
            held.append((op, message, role, text))
    if now:
        ready.append((now[0], *render(fold(iter(held)))))
        yield flush()


def format_conversations(events: DataFrame) -> DataFrame:
    """An event log (``EVENTS``) -> conv_id, formatted, loss_mask, one row per
    conversation (null ids are one conversation).

    Null texts are empty, null roles the empty role; events with equal sequence
    numbers go by op, message and text; columns beyond ``EVENTS`` are not looked
    at. An empty log gives an empty result."""
    names = [f.split()[0] for f in EVENTS.split(", ")]
    sort = ["conv_id", F.col("seq").asc_nulls_first(), F.col("op").desc(), "message", "text"]
    return events.select(*names).repartition("conv_id").sortWithinPartitions(*sort).mapInArrow(_rebuild, _OUT)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, mask in zip(*(c.to_pylist() for c in batch.columns)):
            turns = read_back(formatted)
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            for span in mask:
                own = unescape(formatted[span["start"] : span["end"]])
                loss.update(own.encode())
                chars += len(own)
            out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                         names=[f.split()[0] for f in _READ.split(", ")])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: number and digest of
    the turns, size and digest of the text under the loss mask, size."""
    return formatted.mapInArrow(_digests, _READ)
