"""Late session merging: a linear sorted-run merge of mini-sessions with standing sessions.

Events reach a user in batches, some of them late. After each batch the events so far form sessions:
neighbours in time at most `gap` seconds apart share one. A session that holds an event of the batch
is a new version and retracts the standing sessions that it contains.

1. Each user-batch is pre-sessionized by aggregation (session windows, summed before the shuffle), within
   blocks of time, so that neither a busy user nor a busy batch is one group.
2. A user's time is cut into segments where no two neighbours of any batch are within the gap: no session ever
   spans a cut, so segments are independent. Cuts are found block by block; only a block without any
   gap passes its neighbours through, and runs of those are resolved by pointer doubling in joins.
3. Each segment's mini-sessions, sorted by batch and start, are streamed through the sweep: it keeps the standing
   sessions as one sorted run and merges each batch's run into it, from the first session touched to the last.

Memory of a task is the standing sessions of one segment (of a block, unless events stay within the gap for longer).

Edge cases: rows without a user, batch or second are no events; repeated rows and ties are events of their own and are
counted; a null value counts as 0; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

GAP = 240
#: Seconds of a block.
BLOCK = 4 * 3600

NAMES = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")
VERSIONS = ", ".join(f"{n} bigint" for n in NAMES)
ARROW = pa.schema([(n, pa.int64()) for n in NAMES])


def floor_div(value: Column, by: int) -> Column:
    """The floor of an integer division (a call of `div`, which truncates, on a multiple)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def mini_sessions(events: DataFrame, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """(user, batch, block, start_s, end_s, n, h): the sessions of a user-batch by itself, cut at the bounds of blocks."""
    rows = events.where("user IS NOT NULL AND batch IS NOT NULL AND second IS NOT NULL")
    rows = rows.select("user", "batch", floor_div(F.col("second"), block).alias("block"), F.timestamp_seconds("second").alias("at"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    found = rows.groupBy("user", "batch", "block", F.session_window("at", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("h"))
    return found.select("user", "batch", "block", F.unix_seconds("w.start").alias("start_s"), (F.unix_seconds("w.end") - gap).alias("end_s"), "n", "h")


def with_segments(minis: DataFrame, gap: int, scratch: Scratch) -> DataFrame:
    """minis with `segment`: of a user, a number that sessions of different segments never share. Joins are by merge: none of the sides has a bound, so none is broadcast."""
    before = W.partitionBy("user", "block").orderBy("start_s", "end_s").rowsBetween(W.unboundedPreceding, -1)
    opens = F.col("start_s") - F.max("end_s").over(before) > gap
    blocks = minis.select("user", "block", "start_s", "end_s", opens.alias("opens")).groupBy("user", "block")
    blocks = blocks.agg(F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"), F.min(F.when(F.col("opens"), F.col("start_s"))).alias("cut_s"))
    left = blocks.select("user", (F.col("block") + 1).alias("block"), F.col("last_s").alias("left_s"))
    linked = blocks.join(left.hint("merge"), ["user", "block"]).where(F.col("first_s") - F.col("left_s") <= gap).select("user", "block", "cut_s", (F.col("block") - 1).alias("to"))
    linked = scratch.put(linked, "linked")
    through = linked.where("cut_s IS NULL").select("user", "block", "to")
    jumps, moved = scratch.put(through, "through"), True
    while moved:  # each round doubles the blocks that a pointer skips
        ahead = jumps.select("user", F.col("block").alias("to"), F.col("to").alias("next"))
        step = jumps.join(ahead.hint("merge"), ["user", "to"], "left").select("user", "block", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        step = scratch.put(step, "through")
        jumps, moved = step.drop("moved"), not step.where("moved").isEmpty()
    ends = jumps.select("user", F.col("block").alias("to"), F.col("to").alias("end"))
    linked = linked.join(ends.hint("merge"), ["user", "to"], "left").select("user", "block", "cut_s", F.coalesce("end", "to").alias("to"))
    joins_left = F.col("to").isNotNull() & (F.col("cut_s").isNull() | (F.col("start_s") < F.col("cut_s")))
    return minis.join(linked.hint("merge"), ["user", "block"], "left").withColumn("segment", F.when(joins_left, F.col("to")).otherwise(F.col("block"))).drop("to", "cut_s")


class Standing:
    """The standing sessions of a segment as one sorted run. A version is [start, end, n_events, h_sum, batch, n_new, n_retracted]."""

    def __init__(self, gap: int) -> None:
        self.gap, self.run = gap, []

    def merge(self, batch: int, minis: list[tuple[int, int, int, int]]) -> list[tuple[list, int, int]]:
        """Take in a batch's mini-sessions (start, end, n, h), sorted by start; the versions retracted, each with its retractor's batch and start."""
        gap, run = self.gap, self.run
        low = i = bisect_left(run, minis[0][0] - gap, key=lambda v: v[1])
        k, merged, gone = 0, [], []
        while k < len(minis):
            start, end, n, h = minis[k]
            k += 1
            while i < len(run) and run[i][1] < start - gap:
                merged.append(run[i])
                i += 1
            new, old = n, []
            while True:
                if i < len(run) and run[i][0] <= end + gap:
                    old.append(run[i])
                    start, end, n, h = min(start, run[i][0]), max(end, run[i][1]), n + run[i][2], h + run[i][3]
                    i += 1
                elif k < len(minis) and minis[k][0] <= end + gap:
                    _, e, m, x = minis[k]
                    end, n, new, h = max(end, e), n + m, new + m, h + x
                    k += 1
                else:
                    break
            merged.append([start, end, n, h, batch, new, len(old)])
            gone += [(v, batch, start) for v in old]
        run[low:i] = merged
        return gone


def sweep(gap: int):
    """The streaming function: rows (user, segment, batch, start_s, end_s, n, h), sorted, to versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing, key, minis, out = Standing(gap), None, [], []
        row = lambda user, v, by, at: (user, v[4], v[0], v[1], v[2], v[5], v[6], v[3], by, at)

        def take(new: tuple | None) -> None:
            nonlocal key, minis, standing
            if minis:
                out.extend(row(key[0], *gone) for gone in standing.merge(key[2], minis))
            if key and (new is None or new[:2] != key[:2]):
                out.extend(row(key[0], v, None, None) for v in standing.run)
                standing = Standing(gap)
            key, minis = new, []

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(NAMES)}, schema=ARROW)
            out.clear()
            return made

        for batch in batches:
            for user, segment, number, *mini in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user, segment, number) != key:
                    take((user, segment, number))
                minis.append(tuple(mini))
            if out:
                yield flushed()
        take(None)
        if out:
            yield flushed()

    return run


def session_versions(events: DataFrame, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """Every version of every session of events (user, batch, second, value), all long: when it came, what it holds, and what retracted it."""
    if block <= gap:
        raise ValueError("a block must be longer than the gap")
    scratch = Scratch(events.sparkSession, "sessions")
    minis = scratch.put(mini_sessions(events, gap, block), "minis")
    rows = with_segments(minis, gap, scratch).select("user", "segment", "batch", "start_s", "end_s", "n", "h")
    return rows.repartition("user", "segment").sortWithinPartitions("user", "segment", "batch", "start_s").mapInArrow(sweep(gap), VERSIONS)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns as events; rows without a turn or a conversation are none."""
    rows = conversations.where("turn IS NOT NULL AND conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("v"), F.col("turn").cast("long").alias("t"))
    text = F.col("v").cast("string")
    rows = rows.select("v", "t", F.crc32(text.cast("binary")).alias("c"), F.crc32(F.concat(text, F.lit(":"), F.col("t").cast("string")).cast("binary")).alias("value"))
    c, h = F.col("c"), F.col("value")
    rows = rows.select((2 * floor_div(F.col("v"), 8) + c % 2).alias("user"), (floor_div(c, 2) % 7200 + 300 * F.col("t") + h % 600).alias("second"), "value")
    g = floor_div(h, 600)
    return rows.withColumn("batch", floor_div(F.col("second"), 1800) + F.when(g % 3 == 0, g % 4).otherwise(0))


SESSIONS_SQL = """
WITH k AS (SELECT CAST(conv_id AS BIGINT) AS v, CAST(turn AS BIGINT) AS t, CAST(conv_id AS VARCHAR) AS s, conv_id || ':' || turn AS st FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
crc AS (SELECT v, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(s)), lambda i: (ascii(substr(s, CAST(i // 8 + 1 AS INT), 1)) >> (i % 8)::INT) & 1)), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) AS c,
               xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(st)), lambda i: (ascii(substr(st, CAST(i // 8 + 1 AS INT), 1)) >> (i % 8)::INT) & 1)), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) AS h FROM k),
w AS (SELECT CAST(2 * floor(v / 8.0) + c % 2 AS BIGINT) AS u, (c // 2) % 7200 + 300 * t + h % 600 AS s, h FROM crc),
ev AS (SELECT u, s, h, CAST(floor(s / 1800.0) AS BIGINT) + CASE WHEN h // 600 % 3 = 0 THEN h // 600 % 4 ELSE 0 END AS batch FROM w),
fin AS (SELECT *, sum(g) OVER (PARTITION BY u ORDER BY s, batch, h ROWS UNBOUNDED PRECEDING) AS comp FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u ORDER BY s, batch, h) <= 240 THEN 0 ELSE 1 END AS g FROM ev)),
sofar AS (SELECT b.batch AS now, e.u, e.comp, e.s, e.h, e.batch FROM (SELECT DISTINCT u, comp, batch FROM fin) b JOIN fin e ON e.u = b.u AND e.comp = b.comp AND e.batch <= b.batch),
part AS (SELECT *, sum(g) OVER (PARTITION BY u, comp, now ORDER BY s, batch, h ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, comp, now ORDER BY s, batch, h) <= 240 THEN 0 ELSE 1 END AS g FROM sofar)),
ver AS (SELECT u, comp, now AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (batch = now) AS n_new, sum(h) AS h_sum FROM part GROUP BY u, comp, now, p HAVING max(batch) = now),
gone AS (SELECT v.u, v.comp, v.batch, v.start_s, min((x.batch, x.start_s)) AS r FROM ver v JOIN ver x ON x.u = v.u AND x.comp = v.comp AND x.batch > v.batch AND x.start_s <= v.start_s AND x.end_s >= v.end_s GROUP BY ALL),
cnt AS (SELECT u, comp, r, count(*) AS n FROM gone GROUP BY ALL)
SELECT v.u AS "user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new, COALESCE(c.n, 0) AS n_retracted, CAST(v.h_sum AS BIGINT) AS h_sum, g.r[1] AS retracted_batch, g.r[2] AS retracted_start_s
FROM ver v LEFT JOIN gone g ON g.u = v.u AND g.comp = v.comp AND g.batch = v.batch AND g.start_s = v.start_s LEFT JOIN cnt c ON c.u = v.u AND c.comp = v.comp AND c.r = (v.batch, v.start_s)
"""
