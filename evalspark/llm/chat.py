"""Chat formatting: a finite-state machine over roles and a declarative template.

One shuffle brings the turns of a conversation together in order; tasks then stream over them, so memory does
not depend on the length of a conversation. A null text or role counts as empty, a null conv_id is a
conversation of its own, null turns come first, and rows with equal turns are ordered by role and text.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import table


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles under the loss mask, and the machine: state -> roles that may follow."""

    head: str = "<turn "
    head_end: str = ">\n"
    tail: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """After this no mark of a turn occurs in the text."""
        return re.sub(r"<(/?turn)", r"<\\\1", text.replace("\\", "\\\\"))

    def escape_role(self, role: str) -> str:
        return re.sub(r"([\\>])", r"\\\1", role)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = f"{self.head}{self.escape_role(role)}{self.head_end}"
        return [(head, False), (self.escape(text), role in self.loss_roles), (self.tail, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        found = re.fullmatch(r"<turn ((?:\\.|[^\\>])*)>\n(.*)</turn>\n", formatted, re.DOTALL)
        if not found:
            raise ValueError(f"not a turn: {formatted[:80]!r}")
        return self.unescape(found[1]), self.unescape(found[2])


TURNS = "conv_id bigint, position bigint, state string, valid boolean, texts array<string>, losses array<boolean>"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, valid boolean"
)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn in order within its partition: segments, their loss flags, state, and whether the turn may follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, state = object(), 0, template.start
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, position, state = conv, 0, template.start
                valid = role in template.moves.get(state, ())
                parts = template.segments(role, text)
                state = role
                rows.append((conv, position, state, valid, [p[0] for p in parts], [p[1] for p in parts]))
                position += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_())]
            names = ["conv_id", "position", "state", "valid", "texts", "losses"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    clean = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, TURNS)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest of every conversation, read from the rows of `format_turns` as they lie."""

    class Reader:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n = self.loss_chars = self.chars = 0
            self.valid, self.state = True, template.start

        def add(self, texts, losses, valid, state):
            whole = "".join(texts)
            role, text = template.read(whole)
            self.turns.update(f"{role}\n{text}\n".encode())
            masked = template.unescape("".join(t for t, flag in zip(texts, losses, strict=True) if flag))
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
            self.chars += len(whole)
            self.n += 1
            self.valid, self.state = self.valid and valid, state

        def row(self):
            good = self.valid and self.state in template.final
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = [part.split()[0] for part in DIGESTS.split(", ")]

        def out(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        reader, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "texts", "losses", "valid", "state")]
            for conv, *rest in zip(*columns, strict=True):
                if reader is None or conv != reader.conv:
                    if reader:
                        done.append(reader.row())
                    reader = Reader(conv)
                reader.add(*rest)
            if done:
                yield out(done)
                done = []
        if reader:
            yield out([reader.row()])

    return formatted.mapInArrow(run, DIGESTS)


PROBE = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string"
    )
    return read_back(format_turns(turns.unionByName(extra)))


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
s AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS is_last,
    length(regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '<\\\1', 'g'))
      + length(replace(replace(role, '\', '\\'), '>', '\>')) + 16 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and((coalesce(before, 'start') || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant',
    'assistant>user', 'assistant>tool', 'tool>assistant')) AND bool_or(is_last AND role = 'assistant') AS valid
FROM s GROUP BY conv_id
"""
