"""Chat formatting: a finite-state machine over roles, text segments with loss flags, a declarative template.

A template names for every role the strings around its texts, which roles may follow each other and whose
texts are learned. Each turn becomes three segments (opening, text, closing); only the text of a learned
role has the loss flag. Control strings inside texts are escaped: each gets a backslash after its first
character and backslashes are doubled, so no text can open or close a turn and ``unescape`` gives the
text back. Roles the template does not name are written into the opening string, escaped likewise.

The machine's state is the role of the turn before. Rows are range-partitioned by (conversation, turn), so a
conversation of any length is spread over tasks; a task learns the state it starts in from a table with one
row per partition (the last row of each). A turn the machine does not expect is formatted like the
others and marked ``valid = false``.

``read_back`` parses segments in order and digests each conversation as a stream (one sequential hash per
conversation, constant memory).

Null texts and roles count as empty. Rows with equal turns are ordered by role and text, equal rows are all
kept; a null turn comes first, a null conv_id is a conversation of its own. No rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import materialise

SEGMENTS = "conv_id long, position long, part int, role string, segment string, loss boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, n_invalid long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """Strings around each role's text, allowed roles after each role (None: at the start), learned roles."""

    around: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("<<TURN ", ">>", "<</TURN>>")
    after: dict = field(default_factory=lambda: {
        None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    learned: tuple = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (*(s for pair in self.around.values() for s in pair), self.other[0], self.other[2])

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in sorted(self.controls(), key=len, reverse=True)))

    def escape(self, text: str, pattern: re.Pattern | None = None) -> str:
        text = text.replace("\\", "\\\\") if "\\" in text else text
        return (pattern or self.pattern()).sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def opening(self, role: str) -> str:
        if role in self.around:
            return self.around[role][0]
        return self.other[0] + re.sub(r"([\\>])", r"\\\1", role) + self.other[1]

    def closing(self, role: str) -> str:
        return self.around[role][1] if role in self.around else self.other[2]

    def role_of(self, opening: str) -> str:
        for role, (start, _) in self.around.items():
            if opening == start:
                return role
        return unescape(opening[len(self.other[0]):-len(self.other[1])])

    def expects(self, before: str | None, role: str) -> bool:
        return role in self.after.get(before, ())


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _format(template: Template, states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int32()), ("role", pa.string()),
                            ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
        pattern, conv, before, position, begun = template.pattern(), None, None, 0, False
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "_at", "_first")))
            out = []
            for conv_id, role, text, at, first in rows:
                if not begun:
                    conv, before = states.value.get(at, (None, None, False))[:2]
                    begun, known = True, at in states.value
                    if not known or conv != conv_id:
                        conv, before = conv_id, None
                elif conv_id != conv:
                    conv, before = conv_id, None
                position = first
                valid, learned = template.expects(before, role), role in template.learned
                out.append((conv_id, position, 0, role, template.opening(role), False, valid))
                out.append((conv_id, position, 1, role, template.escape(text, pattern), learned, valid))
                out.append((conv_id, position, 2, role, template.closing(role), False, valid))
                before = role
            cells = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, schema.types)], schema=schema)

    return run


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of ``turns`` (conv_id, turn, role, text): conv_id, position, part (0 to 2), role, segment, loss, valid.

    Segments in the order of conv_id, position, part are the formatted text of a conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                     text("text").alias("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_first", F.monotonically_increasing_id()).withColumn("_at", F.spark_partition_id()))
    placed = materialise(sorted_rows)  # partition numbers and positions are fixed from here on
    ends = placed.groupBy("_at").agg(F.max_by(F.struct("conv_id", "role"), "_first").alias("end")).collect()  # one row per partition
    states, previous = {}, None
    for row in sorted(ends, key=lambda r: r["_at"]):
        if previous is not None:
            states[row["_at"]] = previous
        previous = (row["end"]["conv_id"], row["end"]["role"])
    held = turns.sparkSession.sparkContext.broadcast(states)
    again = placed.repartition("_at").sortWithinPartitions("_at", "_first")
    return again.select("conv_id", "role", "text", "_at", "_first").mapInArrow(_format_runs(template, held), SEGMENTS)


def _format_runs(template: Template, states):
    """``_format`` for tasks that hold several of the sorted partitions, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                at, a = batch.column("_at").to_pylist(), 0
                for part, same in groupby(at):
                    n = sum(1 for _ in same)
                    yield part, batch.slice(a, n)
                    a += n

        for _, group in groupby(pieces(), lambda x: x[0]):
            yield from _format(template, states)(piece for _, piece in group)

    return run


def _digest(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid", "part")))

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("n_invalid", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for conv_id, segments in groupby(rows(), lambda r: r[0]):
            turns, learned = hashlib.sha256(), hashlib.sha256()
            n_turns = n_invalid = loss_chars = chars = 0
            for _, segment, loss, valid, part in segments:
                chars += len(segment)
                if part == 0:
                    role = template.role_of(segment)
                    n_turns += 1
                    n_invalid += not valid
                    turns.update(role.encode() + b"\n")
                elif part == 1:
                    text = unescape(segment)
                    turns.update(text.encode() + b"\n")
                    if loss:
                        learned.update(text.encode())
                        loss_chars += len(text)
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv_id, "n_turns": n_turns, "n_invalid": n_invalid, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                "loss_sha256": learned.hexdigest(), "formatted_chars": chars}], schema=schema)

    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its segments say: turns, digests of turns and of learned text, characters."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position", "part")
    return ordered.select("conv_id", "segment", "loss", "valid", "part").mapInArrow(_digest(template), DIGEST)
