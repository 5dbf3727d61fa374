"""Chat formatting by a compiled template, with a loss mask over what assistants say, and reading it back.

Control strings inside roles and texts are escaped with a backslash, so that the output can be read back as it was. The rows of
a conversation are sorted by (turn, role, text) and stream through the template one at a time; output comes in pieces that
end with a turn and have about `PIECE_CHARS` characters, and leaves the task as soon as so much is waiting, so that a conversation of
any number of turns needs the memory of a piece and of a turn. (Its loop may look at what came before and its digests are
those of one sequence, so one task reads it to the end.)

Defined results: a null role or text counts as empty; a null turn comes first; rows that repeat are turns of their own, equal
turns in order of role and text; rows of a null conv_id are one conversation; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.template import Template

#: Control strings of the format: they mark where a turn begins, where a role ends, and where a turn ends.
BEGIN, ROLE_END, END = "### ", ": ", " </turn>\n"
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escaped }}: "
    '{% if message.role == "assistant" %}{% generation %}{{ message.text | escaped }}{% endgeneration %}{% else %}{{ message.text | escaped }}{% endif %}'
    " </turn>\n{% endfor %}"
)
PIECE_CHARS = 1 << 20

_CONTROL = re.compile(r"\\|###|:|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|:|</turn>)")
_MARKS = re.compile(r"\\(?:\\|###|:|</turn>)|(: )|( </turn>\n)")


def escaped(text: str | None) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class _Pieces:
    """A template's sink that cuts its output into pieces after a turn and keeps the spans under the loss mask; `rows` are to be taken away."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.piece = conv_id, [], 0
        self.parts: list[str] = []
        self.size, self.starts, self.ends, self.inside = 0, [], [], False

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        if self.size >= PIECE_CHARS and not self.inside and text.endswith("\n"):
            self.cut()

    def begin(self) -> None:
        self.starts.append(self.size)
        self.inside = True

    def end(self) -> None:
        self.ends.append(self.size)
        self.inside = False

    def cut(self) -> None:
        self.rows.append((self.conv_id, self.piece, "".join(self.parts), self.starts, self.ends))
        self.piece, self.parts, self.size, self.starts, self.ends = self.piece + 1, [], 0, [], []


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, formatted, loss_starts, loss_ends): the mask's spans are in characters of the piece."""
    Template(template, {"escaped": escaped})  # a bad template fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, {"escaped": escaped})
        waiting: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*waiting), _PIECE.types)], schema=_PIECE)
            waiting.clear()
            held = 0
            return made

        def taken(sink: _Pieces) -> bool:
            """Takes the sink's pieces; whether enough is waiting."""
            nonlocal held
            held += sum(len(r[2]) for r in sink.rows)
            waiting.extend(sink.rows)
            sink.rows.clear()
            return held >= PIECE_CHARS or len(waiting) >= 1_000

        for conv_id, turns in groupby(_rows(batches), key=lambda r: r[0]):
            sink = _Pieces(conv_id)

            def messages(turns=turns, sink=sink) -> Iterator[dict]:
                for _, _, role, text in turns:
                    yield {"role": role or "", "text": text or ""}

            for _ in compiled.steps(sink, messages()):
                if sink.rows and taken(sink):
                    yield batch()
            if sink.parts:
                sink.cut()
            if taken(sink):
                yield batch()
        if waiting:
            yield batch()

    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, piece int, formatted string, loss_starts array<int>, loss_ends array<int>")


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text; raises ValueError where it isn't one."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(BEGIN)
        role = None
        for m in _MARKS.finditer(formatted, at):
            if m[1] and role is None:
                role, at = unescaped(formatted[at : m.start()]), m.end()
            elif m[2]:
                break
        else:
            raise ValueError("a turn has no end")
        if role is None:
            raise ValueError("a turn has no role")
        yield role, unescaped(formatted[at : m.start()])
        at = m.end()


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted pieces alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()
            return made

        for conv_id, pieces in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = under = 0
            for _, _, text, starts, ends in pieces:
                chars += len(text)
                for role, said in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    said = unescaped(text[a:b])
                    under += len(said)
                    loss.update(said.encode())
            out.append((conv_id, n, turns.hexdigest(), under, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield batch()
        yield batch()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
