r"""Operator 8: chat formatting from an event log.

A log holds one row per event: a message begins (``message``), text is appended
to it (``delta``), replaced (``edit``), dropped to be written anew
(``regenerate``), or the message is withdrawn (``delete``). The log is
partitioned by conversation and sorted by turn, message and sequence number, so
one streaming pass folds each message and renders it with its place in the
conversation. A task holds one message at a time, never a conversation.

Template, per turn: ``### Assistant: <text></turn>\n``; other roles than system,
user and assistant stand as ``### @<role>: ``. In texts ``\``, ``###`` and
``</turn>`` get a ``\`` in front, so a header or turn end inside a text can't be
taken for a real one and reading back restores the text. The loss mask of a
conversation is the set of spans ``[loss_start, loss_end)`` in code points.

Defined results: null text or role is empty; a null conversation id is a
conversation of its own; a null turn sorts first; repeated rows are messages of
their own; an empty log gives no rows; other columns of the log are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "</turn>\n"
_SPECIAL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_BODY = r"((?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+)"
_TURN = re.compile(r"### (?:(System|User|Assistant)|@((?:[^\\:]|\\(?:\\|:|###|</turn>))*+)): " + _BODY + "</turn>\n")
KINDS = ("message", "delta", "edit", "regenerate", "delete")
#: Code points of formatted text after which a batch of rows is handed on.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where the escaped text lies in it."""
    title = TITLES.get(role) or "@" + escape(role).replace(":", "\\:")
    head, body = f"### {title}: ", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the text's span for every turn of formatted text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield (m[1].lower() if m[1] else unescape(m[2])), unescape(m[3]), m.start(3), m.end(3)
        at = m.end()


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """``(conversation, turn, message, kind, role, text)`` in order -> finished ``(conversation, turn, role, text)``."""
    key, role, parts = None, None, None
    for conv, turn, message, kind, who, text in events:
        if key is None or key != (conv, turn, message):
            if parts is not None:
                yield key[0], key[1], role, "".join(parts)
            key, role, parts = (conv, turn, message), "", []
        if kind not in KINDS:
            raise ValueError(f"unknown event {kind!r}")
        role = who if who is not None else role
        if kind == "delete":
            parts = None
        elif kind == "delta":
            if parts is not None:
                parts.append(text or "")
        else:
            parts = [text or ""] if kind != "regenerate" else []
    if parts is not None:
        yield key[0], key[1], role, "".join(parts)


def format_chats(log: DataFrame) -> DataFrame:
    """Formatted turns of a log ``(conv_id, turn, message, seq, kind, role, text)``.

    Returns conv_id, turn, role, formatted, start (where the turn begins in its
    conversation), loss_start and loss_end (null outside the loss). Rows of a
    conversation lie in one partition, in order.
    """
    cols = ["conv_id", "turn", "message", "seq", "kind", "role", "text"]
    ordered = (log.select(*cols).withColumn("kind", F.coalesce("kind", F.lit("message")))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message", "seq", "kind", "text"))
    schema = StructType([log.schema["conv_id"], log.schema["turn"], StructField("role", StringType()),
                         StructField("formatted", StringType()), StructField("start", LongType()),
                         StructField("loss_start", LongType()), StructField("loss_end", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events():
            for b in batches:
                conv, turn, message, _, kind, role, text = (c.to_pylist() for c in b.columns)
                yield from zip(conv, turn, message, kind, role, text)

        rows, held, before, at = [], 0, object(), 0
        for conv, turn, role, text in fold(events()):
            if conv != before:
                before, at = conv, 0
            formatted, lo, hi = render(role, text)
            learned = role == "assistant"
            rows.append((conv, turn, role, formatted, at, at + lo if learned else None, at + hi if learned else None))
            at += len(formatted)
            held += len(formatted)
            if held > BATCH_CHARS:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)


def read_back(chats: DataFrame) -> DataFrame:
    """Parse formatted turns again: one row of counts and digests per conversation.

    Reads the formatted text and the loss spans alone, in the order and
    partitions that ``format_chats`` leaves.
    """
    schema = StructType([chats.schema["conv_id"], StructField("n_turns", LongType()),
                         StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
                         StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None
        for b in batches:
            for conv, formatted, start, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_digest(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    learned = unescape(formatted[lo - start:hi - start])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(formatted)
            if len(done) > 10_000:
                yield _batch(done, schema)
                done = []
        if state is not None:
            done.append(_digest(state))
        if done:
            yield _batch(done, schema)

    return chats.select("conv_id", "formatted", "start", "loss_start", "loss_end").mapInArrow(run, schema)


def _digest(state: list) -> tuple:
    conv, turns, turns_hash, chars, loss_hash, total = state
    return conv, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total


def log_of(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """A table of finished messages as an event log that ends in them.

    Assistant texts arrive in streamed pieces of ``chunk`` code points. By a hash of
    the message some answers are begun and regenerated, some end in noise that an
    edit takes away, some messages of others are drafts first, and some turns
    hold a message that is withdrawn again. The log's rows have no order of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), F.monotonically_increasing_id().alias("nth"))
    kind = F.pmod(F.xxhash64("text", "turn"), F.lit(4))
    event = lambda k, t, m="": F.struct(F.lit(m).alias("part"), F.lit(k).alias("kind"), t.cast("string").alias("text"))
    none = F.slice(F.array(event("delta", F.lit(""))), 1, 0)
    begun = F.when(kind == 0, F.array(event("delta", F.substring("text", 1, chunk)), event("delta", F.lit(" never mind")), event("regenerate", F.lit(None)))).otherwise(none)
    streamed = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / chunk).cast("int")),
                           lambda i: event("delta", F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    noise = F.when(kind == 1, F.array(event("delta", F.lit(" ...")), event("edit", F.col("text")))).otherwise(none)
    answer = F.concat(F.array(event("message", F.lit(""))), begun, streamed, noise)
    draft = F.when(kind == 2, F.array(event("message", F.concat(F.lit("draft: "), F.substring("text", 1, 40))), event("edit", F.col("text")))) \
        .otherwise(F.array(event("message", F.col("text"))))
    withdrawn = F.when(kind == 3, F.array(event("message", F.lit("sent too early"), "-withdrawn"), event("delete", F.lit(None), "-withdrawn"))).otherwise(none)
    events = F.concat(F.when(F.col("role") == "assistant", answer).otherwise(draft), withdrawn)
    message = F.concat_ws("-", F.coalesce("role", F.lit("")), F.xxhash64("text").cast("string"), F.col("nth").cast("string"))
    return (rows.select("conv_id", "turn", "role", message.alias("message"), F.posexplode(events).alias("seq", "e"))
            .select("conv_id", "turn", "role", F.concat("message", "e.part").alias("message"), "seq", "e.kind", "e.text"))
