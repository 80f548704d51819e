"""Chat formatting (4): a finite-state machine over roles and a declarative template.

A template gives each role an opening mark, all turns a closing mark, and the roles
whose text counts for the loss. Texts cannot imitate marks: inside a text every
backslash is doubled and a backslash is put before every mark, so that a mark is one
only where no backslash stands before it; `parse` takes it all back exactly.

Rows are dealt by conversation and sorted by turn within the partition (Spark's sort
spills), and a conversation is written turn by turn: state per conversation is the
machine's state, running digests and counts. No conversation is ever held as a whole,
so one that has a third of all rows costs time but no memory.

Defined results: a null text is empty; rows with equal turn are ordered by role, then
text; null turns come first; null ids are one conversation; a null role is the role
"" and, as all unknown ones, is written with the generic mark and makes the order
invalid. Invalid conversations are formatted too, with valid = false and the first
turn at which the machine refused. A conversation of any length is one row of digests;
repeated rows are turns of their own. Only the four columns named are read, so others may
have any names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a format. step maps (state, role) to the next state; what it lacks is refused."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: str = "### Role "
    other_end: str = ": "
    close: str = " </turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    step: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )
    accept: frozenset[str] = frozenset({"answered"})

    def marks(self) -> list[str]:
        return sorted({*self.opens.values(), self.other, self.other_end, self.close, *(m.strip() for m in (*self.opens.values(), self.other, self.close))} - {": "}, key=len, reverse=True)


CHAT = Template()


class Format:
    """Writes turns as segments (text, counts for loss) and reads them back."""

    def __init__(self, template: Template = CHAT):
        self.t = template
        strings = "|".join(re.escape(m) for m in template.marks())
        self._escape = re.compile(r"\\|(?:" + strings + ")")
        self._unescape = re.compile(r"\\(.)", re.DOTALL)
        opens = "|".join(re.escape(m) for m in sorted(template.opens.values(), key=len, reverse=True))
        self._open = re.compile(f"(?:{opens})|{re.escape(template.other)}")
        self._plain = re.compile(r"(?:[^\\]|\\.)*?(?=" + re.escape(template.close) + ")", re.DOTALL)
        self._roles = {m: r for r, m in template.opens.items()}

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" + m.group(), text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = self.t.opens[role] if role in self.t.opens else self.t.other + json.dumps(role) + self.t.other_end
        return [(head, False), (self.escape(text), role in self.t.loss), (self.t.close, False)]

    def parse(self, out: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a formatted conversation; ValueError if it is none."""
        at = 0
        while at < len(out):
            if not (m := self._open.match(out, at)):
                raise ValueError(f"no turn begins at {at}")
            at = m.end()
            if m.group() in self._roles:
                role = self._roles[m.group()]
            else:
                role, at = json.JSONDecoder().raw_decode(out, at)
                at += len(self.t.other_end)
            if not (body := self._plain.match(out, at)):
                raise ValueError(f"the turn at {at} has no end")
            yield role, self.unescape(body.group())
            at = body.end() + len(self.t.close)


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows as (conv_id, turn, role, text), each conversation in one partition and in order."""
    picked = rows.select(
        F.col(id_col).cast("string").alias("conv_id"),  # a null would make pandas read numbers as floats
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(rows: DataFrame, template: Template = CHAT, **columns: str) -> DataFrame:
    """The operator's output: a row per segment (conv_id, turn_no, part, segment, loss), in order within conv_id."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, conv, no = Format(template), object(), 0
        for pdf in batches:
            ids, numbers, parts, texts, losses = [], [], [], [], []
            for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                conv, no = c, no + 1 if c == conv else 0
                for part, (segment, loss) in enumerate(form.turn(role, text)):
                    ids.append(c), numbers.append(no), parts.append(part), texts.append(segment), losses.append(loss)
            yield pd.DataFrame({"conv_id": pd.Series(ids, dtype=object), "turn_no": numbers, "part": parts, "segment": texts, "loss": losses})

    kind = dict(rows.dtypes)[columns.get("id_col", "conv_id")]
    out = conversations(rows, **columns).mapInPandas(write, "conv_id string, turn_no long, part int, segment string, loss boolean")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


class _Reader:
    """What is read back from one conversation's output, turn by turn."""

    def __init__(self, template: Template):
        self.t, self.turns, self.lossy = template, hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars, self.state, self.refused = 0, 0, 0, "start", None

    def add(self, form: Format, role: str, text: str) -> None:
        parts = form.turn(role, text)
        self.chars += sum(len(s) for s, _ in parts)
        for got_role, got in form.parse("".join(s for s, _ in parts)):
            self.turns.update(f"{got_role}\n{got}\n".encode())
            if self.refused is None:
                state = self.t.step.get((self.state, got_role))
                self.refused, self.state = (None, state) if state else (self.n, self.state)
            self.n += 1
        for segment, loss in parts:
            if loss:
                said = form.unescape(segment)
                self.loss_chars += len(said)
                self.lossy.update(said.encode())

    def row(self, conv) -> list:
        valid = self.refused is None and self.state in self.t.accept
        return [conv, self.n, self.turns.hexdigest(), self.loss_chars, self.lossy.hexdigest(), self.chars, valid, self.refused]


def digests(rows: DataFrame, template: Template = CHAT, **columns: str) -> DataFrame:
    """One row per conversation, each value read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "refused_at"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form, conv, reader = Format(template), None, None

        def frame(done: list[list]) -> pd.DataFrame:
            out = pd.DataFrame(done, columns=names)
            return out.astype({"conv_id": object, "refused_at": "Int64"})

        for pdf in batches:
            done = []
            for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.add(form, role, text)
            if done:
                yield frame(done)
        if reader is not None:
            yield frame([reader.row(conv)])

    kind = dict(rows.dtypes)[columns.get("id_col", "conv_id")]
    out = conversations(rows, **columns).mapInPandas(
        read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, refused_at long"
    )
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
