"""Operator 9, chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered and compared: what a longer prefix adds is the span of its last turn, and a rendering that does not
begin with the one before means that the template rewrites history. Two probe texts in the turn's place show
where its text lies in the span, so the loss mask needs no knowledge of the template either.

Rows are sorted by conversation and turn and streamed. The prefix that is rendered is the real one, from the
first turn on, so a template may look back, number or rewrite as far as it likes; a task then holds the longest
conversation, and rendering its prefixes grows with the square of its turns. A template whose ``looks_back``
attribute is a number k declares that what a turn adds (or rewrites) is the same if only the k turns before it
are given. Then a task holds at most the larger of ``context`` and k + 1 turns, and a conversation of any length
passes through in bounded memory. ``turn_template`` looks back no turns.

Defined cases: null text and null role are empty; turns go by number (null first), then role and text;
repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives only
what the query itself adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

#: Control strings of the query's template (fixed values): begin of a turn, end of its role, end of a turn.
BEGIN, COLON, END = "### ", ": ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
_STOP = re.compile(r"\\(?:\\|###|</turn>|: )|</turn>\n")


def turn_template(messages: Messages) -> str:
    """``### role: text</turn>`` lines; a backslash goes before control strings inside roles and texts."""
    return "".join(BEGIN + _ROLE_CONTROL.sub(r"\\\g<0>", role) + COLON + _CONTROL.sub(r"\\\g<0>", text) + END + "\n" for role, text in messages)


turn_template.looks_back = 0


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Renderer:
    """Spans of one conversation's turns, one turn at a time."""

    def __init__(self, template: Template, context: int = 16, frames: dict | None = None):
        self.template, self.back = template, getattr(template, "looks_back", None)
        self.context = None if self.back is None else max(context, self.back + 1)
        self.frames = {} if frames is None else frames  # role -> text before and behind a turn's text, if it looks back no turns
        self.turns: Messages = []
        self.before, self.at = template([]), 0
        self.at = len(self.before)
        self.prologue = self.before

    def _frame(self, role: str) -> tuple[str, str] | None:
        """What the template puts around this turn's text, by two probes; None if it changes earlier turns."""
        one, two = (self.template(self.turns + [(role, x)]) for x in "ab")
        if not (one.startswith(self.before) and two.startswith(self.before)) or len(one) != len(two):
            return None
        one, two = one[len(self.before):], two[len(self.before):]
        at = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), None)
        return None if at is None else (one[:at], one[at + 1:])

    def add(self, role: str, text: str) -> tuple[str, int, int, int | None, int | None, bool]:
        """(span text, start, end, start and end of the turn's own text, whether earlier output changed)."""
        out = self.template(self.turns + [(role, text)])
        kept = len(self.before)
        rewrites = not out.startswith(self.before)
        if rewrites:
            kept = next((i for i, (x, y) in enumerate(zip(out, self.before)) if x != y), min(len(out), len(self.before)))
        piece, start = out[kept:], self.at - (len(self.before) - kept)
        body = (None, None)
        if not rewrites:
            frame = self.frames.get(role)
            if not self._fits(piece, frame):
                frame = self._frame(role)
                if self.back == 0:  # else other turns before could give another one that fits by chance
                    self.frames[role] = frame
            if self._fits(piece, frame):
                body = (start + len(frame[0]), start + len(piece) - len(frame[1]))
        self.turns.append((role, text))
        self.before, self.at = out, start + len(piece)
        if self.context is not None and len(self.turns) >= self.context:
            self.turns = self.turns[len(self.turns) - self.back:]
            self.before = self.template(self.turns)
        return piece, start, start + len(piece), *body, rewrites

    @staticmethod
    def _fits(piece: str, frame: tuple[str, str] | None) -> bool:
        return frame is not None and len(piece) >= len(frame[0]) + len(frame[1]) and piece.startswith(frame[0]) and piece.endswith(frame[1])


PIECES = "conv_id long, turn_no long, role string, piece string, start long, end long, text_start long, text_end long, rewrites boolean"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def format_conversations(turns: DataFrame, template: Template = turn_template, context: int = 16) -> DataFrame:
    """One row per turn of ``turns(conv_id, turn, role, text)``: the text it adds to its conversation's output,
    where that lies, where the turn's own text lies in it, and whether the template changed earlier output.

    Rows of a conversation follow one another in one task, in order; their ``piece`` joined are the output."""
    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, r, no, frames = object(), None, 0, {}
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, r, no = c, Renderer(template, context, frames), 0
                piece, start, end, t0, t1, rewrites = r.add(role, text)
                if not no and r.prologue:
                    piece, start = r.prologue + piece, 0
                rows.append((c, no, role, piece, start, end, t0, t1, rewrites))
                no += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return d.mapInArrow(run, PIECES)


class Reader:
    """Reads one conversation back from its output, piece by piece."""

    def __init__(self):
        self.rest, self.turns, self.chars = "", 0, 0
        self.all, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, piece: str, start: int, loss: tuple[int, int] | None) -> None:
        self.chars += len(piece)
        if loss is not None:
            text = unescape(piece[loss[0] - start:loss[1] - start])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        data, at, begin = self.rest + piece, 0, 0
        while m := _STOP.search(data, at):
            at = m.end()
            if m.group() != END + "\n":
                continue
            self._turn(data[begin:m.start()])
            begin = at
        self.rest = data[begin:]

    def _turn(self, one: str) -> None:
        if not one.startswith(BEGIN):
            raise ValueError("output does not parse: no begin of turn")
        at = len(BEGIN)
        while True:  # the first end of role that no backslash hides
            m = re.compile(r"\\(?:\\|###|</turn>|: )|: ").search(one, at)
            if m is None:
                raise ValueError("output does not parse: no end of role")
            at = m.end()
            if m.group() == COLON:
                break
        self.turns += 1
        self.all.update(f"{unescape(one[len(BEGIN):m.start()])}\n{unescape(one[at:])}\n".encode())


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the output of ``format_conversations`` with its own template."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)

    def run(batches):
        conv, r, done = object(), None, []
        end = lambda: done.append((conv, r.turns, r.all.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars))
        for b in batches:
            for c, no, role, piece, start, t0, t1 in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn_no", "role", "piece", "start", "text_start", "text_end"))):
                if c != conv or not no:
                    if r is not None:
                        end()
                    conv, r = c, Reader()
                r.feed(piece, start, (t0, t1) if role == "assistant" else None)
            yield from batch(done)
            done.clear()
        if r is not None:
            end()
        yield from batch(done)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)))
