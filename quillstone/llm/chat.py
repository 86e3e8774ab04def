"""Chat formatting, proved turn by turn by reparsing what was rendered.

Grammar of the output, one turn after another::

    turn := "<s>[ROLE]" role "[/ROLE]" text "</s>"

Neither role nor text may hold a control string. A turn is first rendered as it
stands and parsed again; where the parser does not give back the very role and
text, the conflicting content is escaped and the turn parsed once more, until
both are identical. Escaping puts a backslash behind the first character of
each control string, and one more where backslashes are already there; parsing
takes one away, so it loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, END_ROLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
# The control strings less their first character: turn ends, role marks, and
# the instruction and system marks that a tokenizer of this family knows.
_TAIL = r"(/?s>|/?(?:ROLE|INST)\]|</?SYS>>)"
_CONTROL = re.compile(r"[<\[]" + _TAIL)
_ANY = re.compile(r"([<\[])(\\*)" + _TAIL)
_STUFFED = re.compile(r"([<\[])\\(\\*)" + _TAIL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ANY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _STUFFED.sub(r"\1\2\3", text)


def parse_turn(segment: str) -> tuple[str, str] | None:
    """Role and text of one rendered turn, or None where the grammar does not fit."""
    if not segment.startswith(OPEN):
        return None
    role = _CONTROL.search(segment, len(OPEN))
    if role is None or role[0] != END_ROLE:
        return None
    text = _CONTROL.search(segment, role.end())
    if text is None or text[0] != CLOSE or text.end() != len(segment):
        return None
    return unescape(segment[len(OPEN):role.start()]), unescape(segment[role.end():text.start()])


def render_turn(role: str, text: str) -> str:
    """The rendered turn, known to parse back to the same role and text."""
    segment = f"{OPEN}{role}{END_ROLE}{text}{CLOSE}"
    if parse_turn(segment) != (role, text):
        segment = f"{OPEN}{escape(role)}{END_ROLE}{escape(text)}{CLOSE}"
        if parse_turn(segment) != (role, text):
            raise ValueError("a turn does not survive formatting")
    return segment


def format_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv, turn, segment``: every turn rendered; a conversation is its segments in order.

    Narrow: one turn is one string, so a conversation of any length is never
    gathered. NULL role or text counts as empty; other columns are ignored.
    """
    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            segments = [render_turn(r, t) for r, t in zip(b["_role"], b["_text"])]
            yield pd.DataFrame({"_conv": b["_conv"], "_turn": b["_turn"], "segment": segments})

    picked = turns.select(
        F.col(conv).cast("long").alias("_conv"), F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return picked.mapInPandas(render, "_conv long, _turn long, segment string").select(
        F.col("_conv").alias(conv), F.col("_turn").alias(turn), "segment")


def read_back(segments: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What parsing the segments of each conversation in order gives.

    ``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Rows with equal turn numbers go by their segments. A segment that does not
    fit the grammar, NULL too, is no turn: only its characters count, in
    ``formatted_chars``. Conversations are streamed in sorted order through running digests, so memory does not grow
    with a conversation; NULL is a conversation id like any other.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row():
            n, turns, chars, loss, total = state
            return pa.RecordBatch.from_pylist([{
                "_conv": current, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": total}], schema=schema)

        out = []
        for b in batches:
            for cid, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or cid != current:
                    if state is not None:
                        out.append(row())
                    current, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(segment or "")
                turn = parse_turn(segment or "")
                if turn is None:
                    continue
                role, text = turn
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == LOSS_ROLE:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
            yield from out
            out = []
        if state is not None:
            yield row()

    schema = pa.schema([
        ("_conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = (
        segments.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), "segment")
        .repartition("_conv").sortWithinPartitions("_conv", "_turn", "segment").select("_conv", "segment"))
    return ordered.mapInArrow(
        digest, "_conv long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long").withColumnRenamed("_conv", conv)
