"""Chat formatting by event-sourced reconstruction.

A log holds one row per event of a conversation: a message is opened, grows by streamed
deltas, is replaced by an edit, or starts again when it is regenerated. The log is
partitioned by conversation and message, sorted by sequence and folded in one pass with the
state of a single message; the final messages are rendered with a template whose control
strings are escaped in texts, so that the output can be read back.

One conversation may hold a large part of all rows: its messages are folded and rendered in
parallel, and digests of whole conversations are taken while the sorted messages stream by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
DELTA_CHARS = 512
_CONTROL = re.compile(r"(\\|###|</turn>)")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{HEAD}{escape(role).replace(':', chr(92) + ':')}{MID}{escape(text)}{TAIL}"


# Possessive: what a text may hold never runs into its end mark, so that no way back is kept for each character.
_TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|:))*+): ((?:[^\\<#]++|\\(?:\\|###|</turn>)|<(?!/turn>)|#(?!##))*+)</turn>\n")


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log (conv_id, turn, message, seq, kind, role, text) that leads to the given rows (conv_id, turn,
    role, text): assistant texts are streamed as a draft, regenerated and
    streamed again; others are typed in capitals and then edited."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = c.withColumn("message", F.monotonically_increasing_id())

    def event(kind: str, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    starts = F.sequence(F.lit(0), F.floor(F.length("text") / DELTA_CHARS).cast("int"))
    deltas = F.transform(starts, lambda k: event(DELTA, F.substring(F.col("text"), k * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    draft = F.array(event(DELTA, F.substring("text", 1, DELTA_CHARS)), event(REGENERATE, F.lit("")))
    typed = F.array(event(DELTA, F.upper(F.substring("text", 1, DELTA_CHARS))), event(EDIT, F.col("text")))
    events = F.concat(F.array(event(OPEN, F.lit(""))), F.when(F.col("role") == "assistant", F.concat(draft, deltas)).otherwise(typed))
    return c.select("conv_id", "turn", "message", "role", F.posexplode(events).alias("seq", "e")).select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "e.kind", F.when(F.col("e.kind") == OPEN, F.col("role")).alias("role"), "e.text")


_FOLDED = "conv_id long, turn long, role string, text string, formatted string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events -> final messages."""
    key, role, parts, out = None, "", [], []

    def flush():
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn", "role", "text", "formatted"])
        out.clear()
        return batch

    for b in batches:
        for conv, turn, message, kind, who, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "message", "kind", "role", "text")), strict=True):
            if (conv, turn, message) != key:
                if key is not None:
                    done = "".join(parts)
                    out.append((key[0], key[1], role, done, render(role, done)))
                key, role, parts = (conv, turn, message), "", []
            if kind == OPEN:
                role = who or ""
            elif kind in (EDIT, REGENERATE):
                parts = [text or ""]
            elif kind == DELTA:
                parts.append(text or "")
        if len(out) > 256:
            yield flush()
    if key is not None:
        done = "".join(parts)
        out.append((key[0], key[1], role, done, render(role, done)))
    if out:
        yield flush()


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted): the final messages of an event log.

    Events are those of log_of(); `message` tells messages apart, `turn` orders them. An edit
    or a regeneration replaces what came before it in sequence, a delta is added. Null texts
    count as empty, a message that was never opened has an empty role, and events of an unknown
    kind change nothing. Null conv_ids are one conversation. Events with equal sequence
    numbers apply in the order of kind, then text. Other columns are ignored; an empty log gives no rows.
    """
    log = log.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn", "message", "seq")), *(F.col(c).cast("string").alias(c) for c in ("kind", "role", "text")))
    keys = ("conv_id", "turn", "message")
    return log.repartition(*keys).sortWithinPartitions(*keys, "seq", "kind", "text").mapInArrow(_fold, _FOLDED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered messages in order -> one row per conversation, read back from the rendering."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, out = None, []
    done = lambda x: (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])
    for b in batches:
        for conv, formatted in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now:
                    out.append(done(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    now[3] += len(text)
                    now[4].update(text.encode())
            now[5] += len(formatted)
    if now:
        out.append(done(now))
    cols = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def conversation_digests(messages: DataFrame) -> DataFrame:
    """One row for each conversation of reconstruct(): its turns and the text under the loss
    mask (assistant turns), as parsed back from the rendered messages. Messages of one turn
    are taken in the order of role and text."""
    order = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return order.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
