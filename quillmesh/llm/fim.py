"""Fill-in-middle: an index of distinct texts with Elias-Fano boundary lists, and seeded cuts.

1. Documents meet by the hash of their text. Groups of copies with more than a stated share of all rows are known from a
   count of the hashes first (summed before the shuffle) and divided over parts by a hash of the id, so none is one task.
2. Within a task rows are sorted by hash, and a text is compared with the one before: the hash only brings
   copies together, equal content makes them one text. Of each text the boundaries of its units (code points) are
   listed once, as byte offsets in an Elias-Fano list; all its documents are served from that list.
3. A document's two cuts are `select`s on the list, at positions drawn from a hash of seed and id; bytes are
   sliced there, so a text is never decoded.

Texts cross the network once. A task holds one text and its list, and a batch of rows.

Edge cases: a null text is an empty one; empty texts and texts that hold a marker are plain; repeated rows and ids are cut one by
one, ids that are equal (or null, which counts as an empty id) at the same positions; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of copies are whole up to this share of all rows (LEAST rows at least), so at most 1 / SHARE hashes are broadcast.
SHARE, LEAST = 1 / 4096, 32
CHUNK_BYTES = 16 << 20


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class EliasFano:
    """A non-decreasing list of integers in about 2 + log2(largest / n) bits each; `select(i)` is the i-th."""

    SAMPLE = 1024

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // self.n).bit_length() - 1) if self.n else 0
        self.low = np.packbits((values[:, None] >> np.arange(self.width)) & 1) if self.width else np.empty(0, np.uint8)
        bits = np.zeros(-(-(self.n + (top >> self.width) + 1) // self.SAMPLE) * self.SAMPLE, bool)
        bits[(values >> self.width) + np.arange(self.n)] = True
        self.high = np.packbits(bits)
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, self.SAMPLE).sum(1))])

    def select(self, i: int) -> int:
        block = int(np.searchsorted(self.before, i, "right")) - 1
        step = self.SAMPLE // 8
        inside = np.flatnonzero(np.unpackbits(self.high[block * step : (block + 1) * step]))[i - int(self.before[block])]
        value = (block * self.SAMPLE + int(inside) - i) << self.width
        if self.width:
            first = i * self.width
            part = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8])[first % 8 : first % 8 + self.width]
            value |= int(part @ (1 << np.arange(self.width)))
        return value


def boundaries(text: bytes) -> EliasFano:
    """The byte offsets at which code points begin, and the end: n + 1 of them."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano(np.append(starts, len(text)))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


class Text:
    """One distinct text of the index."""

    def __init__(self, text: bytes, markers: tuple[bytes, ...]) -> None:
        self.text, self.list = text, boundaries(text)
        self.n = self.list.n - 1
        self.plain = not text or any(m in text for m in markers)

    def cut(self, drawn: tuple[int, int, int, int], markers: tuple[bytes, ...], plain_percent: int, spm_percent: int) -> tuple[str, int | None, int | None, bytes]:
        """Form, units of the prefix, units of the middle, output."""
        h1, h2, h3, h4 = drawn
        if self.plain or h3 % 100 >= 100 - plain_percent:
            return "plain", None, None, self.text
        a, b = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        at, to = self.list.select(a), self.list.select(b)
        p, s, m = markers
        prefix, middle, suffix = self.text[:at], self.text[at:to], self.text[to:]
        if h4 % 100 < spm_percent:
            return "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
        return "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): copies of a text in one partition and side by side, hot groups in as many parts as they need."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    most = max(LEAST, int(docs.count() * SHARE))
    hot = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").select("doc_id", "text", "key")


FORMATTED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: Markers = Markers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    marks = tuple(m.encode() for m in markers.all())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip([c.split()[0] for c in FORMATTED.split(", ")], kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, held = None, [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if current is None or raw != current.text:
                    current = Text(raw, marks)
                form, prefix, middle, output = current.cut(draws(seed, doc_id), marks, plain_percent, spm_percent)
                out.append((doc_id, current.n, form, prefix, middle, output))
                held += len(output)
                if held > CHUNK_BYTES:
                    yield flushed()
                    out, held = [], 0
            if out:
                yield flushed()
                out, held = [], 0

    return grouped(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, FORMATTED)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text, from output and form alone."""
    parts = F.split(output, "|".join(map(re.escape, markers.all())), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_digest(docs: DataFrame) -> DataFrame:
    """fill_in_middle's rows with the digests of output and restored text in place of the output."""
    rows = fill_in_middle(docs)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


FIM_SQL = """
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
