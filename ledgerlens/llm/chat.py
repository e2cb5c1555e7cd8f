"""Chat logs folded into final messages and rendered for training.

The log is event-sourced: one row per event with conversation, turn, message, sequence number, kind,
role and text.  ``start`` opens a message, ``delta`` appends to it, ``edit`` replaces its text,
``regenerate`` empties it for new deltas.  An edit or regeneration of a turn voids what later
turns held before it (smaller sequence number): those answers belonged to the old text.

One shuffle partitions the log by conversation and sorts it; the tasks then stream over the sorted
rows and hold one message at a time, so a conversation with a third of all events is sorted with
spilling and never gathered.  Rendering and reading back go message by message on the same order;
only the digest of one conversation is sequential, as its definition asks.

Template: ``<turn role>``, newline, text, ``</turn>``, newline.  Inside roles and texts a backslash
precedes every backslash and ``<``, in roles also ``>`` and newlines (written ``\\n``), so no text can
forge a control string and reading back is exact.

Defined cases: null text: empty; null role: empty; null conversation: one conversation of its own; null
turn: before all others.  Rows of one turn are ordered by role, then the xxhash64 of the text, then
arrival; equal rows stay separate messages.  An unknown event kind stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table

LOSS_ROLE = "assistant"
_OPEN = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

# The contract's probe of escaping: a user row, then an assistant row.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The message and the range of its text under the loss mask (empty for other roles)."""
    head, body = f"<turn {escape_role(role)}>\n", escape(text)
    start = len(head)
    return f"{head}{body}</turn>\n", start, start + (len(body) if role == LOSS_ROLE else 0)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each message of a formatted conversation, or of a part of it at message borders."""
    at = 0
    while at < len(formatted):
        found = _OPEN.match(formatted, at)
        if not found:
            raise ValueError(f"no message at {at}")
        at = found.end()
        yield unescape(found.group(1)), unescape(found.group(2))


RENDERED = "conv_id long, message long, formatted string, loss_start int, loss_end int"


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events sorted by conversation, turn, message and sequence, to rendered messages in order."""
    conv, turn, message = object(), object(), object()
    number, cut, own_cut = 0, -1, -1  # cut: latest change of a lower turn; own_cut: with this turn's
    role, parts, alive = "", [], False
    for batch in batches:
        out = []

        def close():
            nonlocal number
            if alive:
                text, start, end = render(role, "".join(parts))
                out.append((conv, number, text, start, end))
                number += 1

        for c, t, m, seq, kind, r, text in zip(*(batch[x] for x in ("conv_id", "turn", "message", "seq", "kind", "role", "text"))):
            new_conv = not _same(c, conv)
            new_turn = new_conv or not _same(t, turn)
            if new_turn or m != message:
                close()
                role, parts, alive, message = "", [], False, m
                if new_conv:
                    conv, number, cut, own_cut = c, 0, -1, -1
                if new_turn:
                    turn, cut = t, own_cut if not new_conv else -1
            if kind in ("edit", "regenerate"):
                own_cut = max(own_cut, seq)
            elif kind not in ("start", "delta"):
                raise ValueError(f"unknown event kind {kind!r}")
            if seq < cut:
                continue
            alive = True
            if kind == "start":
                role = r or ""
            if kind in ("edit", "regenerate"):
                parts = []
            if kind != "regenerate" and text:
                parts.append(text)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "message", "formatted", "loss_start", "loss_end"]).astype({"conv_id": "Int64"})
        out = []
    out = []
    if alive:
        text, start, end = render(role, "".join(parts))
        yield pd.DataFrame([(conv, number, text, start, end)],
                           columns=["conv_id", "message", "formatted", "loss_start", "loss_end"]).astype({"conv_id": "Int64"})


def format_log(events: DataFrame) -> DataFrame:
    """Rendered messages, conversation by conversation in order within each task.

    ``events``: conv_id, turn, tie (order among messages of one turn), message (an id), seq, kind, role, text.
    A formatted conversation is its messages' ``formatted`` in order of ``message``; loss ranges are within a message.
    """
    order = ["conv_id", "turn", "tie", "message", "seq"]
    laid = events.repartition("conv_id").sortWithinPartitions(*order)
    return laid.select("conv_id", "turn", "message", "seq", "kind", "role", "text").mapInPandas(_fold, RENDERED)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, started = None, False
    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def row():
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def frame(rows):
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    for batch in batches:
        rows = []
        for c, text, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"]):
            if not started or not _same(c, conv):
                if started:
                    rows.append(row())
                conv, started = c, True
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            size += len(text)
            for role, said in read_back(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            if end > start:
                trained = unescape(text[start:end])
                chars += len(trained)
                loss.update(trained.encode())
        if rows:
            yield frame(rows)
    if started:
        yield frame([row()])


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the formatted output back gives, one row per conversation (in the order of ``format_log``)."""
    return rendered.mapInPandas(_digest, DIGEST)


def as_log(rows: DataFrame) -> DataFrame:
    """A table of final turns as the log that would have led to it: a start and two deltas per row."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    half = (n / 2).cast("int")
    events = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.substr(text, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("delta").alias("kind"), F.substr(text, half + 1).alias("text")))
    tie = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("text"))
    return (rows.withColumn("message", F.monotonically_increasing_id())  # per row, so before the rows are exploded
            .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), tie.alias("tie"), "message", F.explode(events).alias("e"))
            .select("conv_id", "turn", "tie", "message", F.col("e.seq").cast("long").alias("seq"), "e.kind", "role", "e.text"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_log(as_log(rows)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || role || '>' || chr(10) || replace(replace(text, '\', '\\'), '<', '\<') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
