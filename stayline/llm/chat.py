"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, NAMED, CLOSE = "### ", ": ", "</turn>"
ESCAPED_TEXT = re.compile(r"\\|###|</turn>")
ESCAPED_ROLE = re.compile(r"\\|#|:|<")
ESCAPE = re.compile(r"\\(\\|###|</turn>|#|:|<)")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\</turn>|\\.|<(?!/turn>))*)</turn>\n", re.S)

FLUSH_CHARS, FLUSH_ROWS = 4_000_000, 1_000

EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, last boolean"
READ = "conv_id long, example long, n_turns long, turns_sha256 string, loss_text string, n_chars long"


def escape(text: str, control: re.Pattern = ESCAPED_TEXT) -> str:
    """Put a backslash before every control string and backslash."""
    return control.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn in the template, and where its text starts."""
    head = f"{OPEN}{escape(role, ESCAPED_ROLE)}{NAMED}"
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation; fails where anything else stands in it."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def _examples(batches: Iterator[pa.RecordBatch], trained: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    schema = pa.schema(
        [("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()),
         ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())]
    )

    def flush() -> pa.RecordBatch:
        nonlocal rows, held
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows, held = [], 0
        return out

    for batch in batches:
        for conv, turns in zip(batch.column(0), batch.column(1)):
            conv, turns = conv.as_py(), turns.as_py()
            targets = [i for i, t in enumerate(turns) if t["role"] == trained]
            if not targets or targets[-1] < len(turns) - 1:
                targets.append(len(turns))  # what follows the last reply: context only
            prefix, done = "", 0
            for k, target in enumerate(targets):
                context = [format_turn(t["role"] or "", t["text"] or "")[0] for t in turns[done:target]]
                prefix += "".join(context)
                done, start, end, text = target, None, None, prefix
                if target < len(turns):
                    turn, at = format_turn(turns[target]["role"], turns[target]["text"] or "")
                    start, end = len(prefix) + at, len(prefix) + len(turn) - len(CLOSE) - 1
                    text = prefix + turn
                rows.append((conv, k, min(target + 1, len(turns)), text, start, end, k == len(targets) - 1))
                held += len(text)
                if held > FLUSH_CHARS or len(rows) >= FLUSH_ROWS:
                    yield flush()
    if rows:
        yield flush()


def prefix_examples(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """One example per assistant turn: all turns before it, then that reply, which alone is trainable.

    ``loss_start`` and ``loss_end`` are code points of ``text``, end exclusive; they hold the reply's escaped text.
    Turns after the last reply, or a conversation without one, give one more example with null bounds, so that the
    examples hold every turn. ``last`` marks a conversation's longest example.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows stay. Null texts and roles count
    as empty; rows with a null ``conv_id`` form one conversation. Other columns are ignored, an empty table gives no
    rows. A task holds one conversation and about FLUSH_CHARS of examples, which it passes on as it goes.
    """
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    light = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    return light.mapInArrow(lambda batches: _examples(batches, trained), EXAMPLES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            conv, example, n, text, start, end, last = (batch.column(i)[r].as_py() for i in range(7))
            sha = None
            if last:
                turns = parse_turns(text)
                n = len(turns)
                sha = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            out.append((conv, example, n, sha, "" if start is None else unescape(text[start:end]), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["conv_id", "example", "n_turns", "turns_sha256", "loss_text", "n_chars"],
        )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts alone: digests of all turns and of all trained text."""
    read = examples.mapInArrow(_read, READ)
    grouped = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss_text"))).alias("parts"),
        F.sum("n_chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    trained = F.array_join(F.transform("parts", lambda p: p["loss_text"]), "")
    return grouped.select(
        "conv_id", "n_turns", "turns_sha256",
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )
