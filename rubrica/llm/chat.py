"""Chat formatting: conversations through a compiled template, turn by turn.

Rows are dealt by conversation and sorted by turn; a task streams through them, so memory is
bounded by the longest turn, not by a conversation.  The output has one row a turn: the
text the template wrote for it, where it starts in the conversation's text, and the ranges written
inside generation markers (the loss mask).

Control strings inside texts and role names are escaped: a backslash goes in after the first
character, also where there are backslashes already, so reading removes exactly one.

Defined cases: null text and null role are empty; rows of a null conv_id form one
conversation; turns are ordered by turn (null first), then role, then text, so ties and repeated
rows are turns of their own in a fixed order; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.template import Template

CONTROLS = ("[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)

_STUFFED = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
#: Characters of output that a task hands on at once.
FLUSH = 4 << 20
TURN_SCHEMA = "conv_id long, position long, start long, text string, loss array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    """Break control strings with one backslash more than they have."""
    return _STUFFED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _STUFFED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns in formatted text that follows TEMPLATE."""
    at = 0
    while at < len(formatted):
        opened = _CONTROL.match(formatted, at)
        if not opened:
            raise ValueError(f"no turn begins at {at}")
        closed = _CONTROL.search(formatted, opened.end())
        if opened[0] == "[INST]" and closed and closed[0] == "[/INST]":
            yield "user", unescape(formatted[opened.end() + 1 : closed.start() - 1])
        elif opened[0] == "<s>" and closed and closed[0] == "</s>":
            yield "assistant", unescape(formatted[opened.end() : closed.start()])
        elif opened[0] == "[ROLE]" and closed and closed[0] == "[/ROLE]":
            role, begin = unescape(formatted[opened.end() : closed.start()]), closed.end()
            closed = _CONTROL.search(formatted, begin)
            if not closed or closed[0] != "</s>":
                raise ValueError(f"the turn at {at} does not end")
            yield role, unescape(formatted[begin : closed.start()])
        else:
            raise ValueError(f"the turn at {at} does not end")
        at = closed.end()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, position, start, text, loss of every turn; sorted by conversation within partitions.

    ``template`` needs one outer loop over ``messages`` (with ``role`` and ``text``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, {"escape": escape})
        rows: list[tuple] = []
        size = 0
        for conv_id, turns in groupby(_rows(batches), key=lambda r: r[0]):
            start = 0
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for position, written in enumerate(compiled.pieces(messages)):
                at, loss = start, []
                for text, generated in written:
                    if generated:
                        loss.append({"start": at, "end": at + len(text)})
                    at += len(text)
                rows.append((conv_id, position, start, "".join(t for t, _ in written), loss))
                size += at - start
                start = at
                if size >= FLUSH or len(rows) >= FLUSH // 1000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    ordered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, TURN_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), loss]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "position", "start", "text", "loss"])


def digests(turns: DataFrame) -> DataFrame:
    """What can be read back from formatted turns, one row a conversation.

    ``turns`` as ``format_turns`` returns it: a conversation's rows follow each other in one partition.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            for _, _, start, text, loss in rows:
                for role, said in read_back(text):
                    n += 1
                    turns_hash.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] - start : span["end"] - start])
                    loss_chars += len(said)
                    loss_hash.update(said.encode())
                chars += len(text)
            out.append((conv_id, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return turns.mapInArrow(run, schema)
