"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns are sorted by conversation and streamed through the machine, one turn in memory at a time,
so a conversation of any length takes bounded memory. Each turn becomes one row of segments
(text, loss); the text under the loss mask is exactly the escaped text of the roles the template
names. Control strings inside a text are escaped by a backslash (and backslashes doubled), so
`parse_turn` gives back any role and text.

The machine's verdict is per turn (`valid`: the role may follow the one before) and never drops
a turn. Order: (turn, role, text), nulls first; ties and repeated rows are all kept. Null texts
and roles count as empty ones; unknown roles are formatted and invalid; an empty table gives no
rows; a null conversation id is an id of its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The machine: role -> roles that may come next; "" is the start.
TRANSITIONS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Template:
    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            text = text.replace(control, "\\" + control)
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        name = self.escape(role).replace(":", "\\:")
        return [(self.head + name + self.colon, False), (self.escape(text), role in self.loss_roles), (self.tail, False)]

    def parse_turn(self, formatted: str) -> tuple[str, str, str]:
        """Role, text and the rest after the first formatted turn."""
        match = re.match(re.escape(self.head) + r"((?:\\.|[^\\:])*)" + re.escape(self.colon) + r"((?:\\.|(?!" + re.escape(self.tail.strip()) + r")[^\\])*)" + re.escape(self.tail), formatted, re.S)
        if not match:
            raise ValueError("not a formatted turn: " + formatted[:80])
        return self.unescape(match[1]), self.unescape(match[2]), formatted[match.end() :]


FORMATTED = "conv_id bigint, seq bigint, role string, state_before string, valid boolean, segments array<struct<text:string,loss:boolean>>"
ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("state_before", pa.string()), ("valid", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn, sorted by (conv_id, seq) within its partition, a conversation in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, seq = object(), "", 0
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ARROW.names}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != last:
                    last, state, seq = conv, "", 0
                valid = role in TRANSITIONS.get(state, ())
                segments = [{"text": t, "loss": loss} for t, loss in template.segments(role, text)]
                for name, value in zip(ARROW.names, (conv, seq, role, state, valid, segments), strict=True):
                    out[name].append(value)
                state, seq = role, seq + 1
            yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of format_conversations' output (in its order): digests of the parsed turns and of the loss mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, chars, masked, ok, turns, loss = None, 0, 0, 0, True, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            done = []
            for conv, valid, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if n and conv != current:
                    done.append((current, n, turns.hexdigest(), masked, loss.hexdigest(), chars, ok))
                    n, chars, masked, ok, turns, loss = 0, 0, 0, True, hashlib.sha256(), hashlib.sha256()
                current, n, ok = conv, n + 1, ok and valid
                whole = "".join(s["text"] for s in segments)
                role, text, rest = template.parse_turn(whole)
                if rest:
                    raise ValueError("more than a turn in a turn's segments")
                chars += len(whole)
                turns.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = template.unescape(s["text"])
                        masked += len(plain)
                        loss.update(plain.encode())
            if done:
                yield pa.RecordBatch.from_pydict({f.name: [x[i] for x in done] for i, f in enumerate(schema)}, schema=schema)
        if n:
            yield pa.RecordBatch.from_pydict({f.name: [x] for f, x in zip(schema, (current, n, turns.hexdigest(), masked, loss.hexdigest(), chars, ok), strict=True)}, schema=schema)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts hold the template's own control strings. Turns that the table itself has under -7 join it, in their order."""
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
             replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er,
             lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(COALESCE(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(er) + length(et)) AS BIGINT) AS formatted_chars,
       bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM e GROUP BY conv_id
"""
