"""Quality rules: a threshold table compiled into one projection.

Every metric is a native expression over the whole text; a `Rule` bounds one metric (or a
ratio of two), and `compile_rules` turns a table of rules into one boolean Column. Nothing is
shuffled, so the operator is a single scan whatever the number of documents.

Edge cases: a null text counts as an empty one, which has no words and so fails the base rules;
repeated rows are judged one by one; an empty table gives an empty result; columns of the input
other than `id_col` and `text_col` are ignored unless `keep_columns` is set, in which case those named as
one of `METRICS` are replaced by the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, barrier, words_of

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is was for that it on as with by at from this be are or an not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec "
    "el que y los se del las por con no una su para al lo como más o"
).split()

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= numerator / denominator <= high; with a denominator of 0 it passes."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(self.numerator).cast("double")
        if self.denominator:
            value = F.try_divide(value, F.col(self.denominator).cast("double"))
        out = F.lit(True)
        if self.low is not None:
            out = out & (value >= F.lit(float(self.low)))
        if self.high is not None:
            out = out & (value <= F.lit(float(self.high)))
        return F.coalesce(out, F.lit(True))


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2.0, high=25.0),
    Rule("symbols per word character", "n_symbols", "word_chars", high=0.08),
    Rule("exclamations per word", "n_shouts", "n_words", high=0.4),
    Rule("stop words per word", "n_stop_words", "n_words", low=0.06),
    Rule("duplicate lines per line", "n_dup_lines", "n_lines", high=0.5),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(True)
    for rule in rules:
        out = out & rule.passes()
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row per input row: id, METRICS; with keep_columns the input's columns as well."""
    n = 8  # words of a window
    docs = docs.drop(*[c for c in docs.columns if c in METRICS and c not in (id_col, text_col)])
    kept = [F.col(c) for c in docs.columns] if keep_columns else [F.col(id_col)]
    own = "__quality_"
    text, words, hashes, windows, ordered, at = (F.col(own + c) for c in ("text", "words", "hashes", "windows", "ordered", "at"))
    names = [F.col(c) for c in docs.columns] if keep_columns else [F.col(id_col)]
    step = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(own + "text"))
    step = step.select(*names, text, words_of(text).alias(own + "words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)).alias(own + "lines"))
    lines = F.col(own + "lines")
    counts = [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    ]
    done = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_shouts"]
    step = step.select(*names, *counts, barrier(F.transform(words, lambda w: F.xxhash64(w))).alias(own + "hashes"))
    # Each column that a lambda reads is referenced more than once, so that it is computed once and not within the lambda.
    window = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    step = step.select(*names, *done, F.when(F.size(hashes) >= n, window).otherwise(F.array().cast("array<bigint>")).alias(own + "windows"))
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*names, *done, F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias(own + "ordered"))
    twice = F.filter(ordered, lambda x, k: F.coalesce((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), F.get(ordered, k - 1)["h"] == x["h"], F.get(ordered, k + 1)["h"] == x["h"]))
    step = step.select(*names, *done, F.sort_array(F.transform(twice, lambda x: x["i"])).alias(own + "at"))
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))), F.lit(0), lambda a, b: a + b)
    step = step.select(*names, *done, barrier(covered.cast("long")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return step.select(*names, *METRICS)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The rules as a SQL condition (for the query's check)."""
    out = []
    for r in rules:
        value = f"CAST({r.numerator} AS DOUBLE)" + (f" / NULLIF(CAST({r.denominator} AS DOUBLE), 0)" if r.denominator else "")
        out += [f"COALESCE({value} >= {float(r.low)}, TRUE)"] if r.low is not None else []
        out += [f"COALESCE({value} <= {float(r.high)}, TRUE)"] if r.high is not None else []
    return " AND ".join(out) or "TRUE"


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_aggregate(list_slice(ws, i, i + 7), 'string_agg', ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
gaps AS (SELECT doc_id, LEAST(8, COALESCE(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM rep),
r AS (SELECT doc_id, sum(g) AS g FROM gaps GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS wc,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(COALESCE(r.g, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words,
             CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts
      FROM w LEFT JOIN r USING (doc_id)),
c AS (SELECT doc_id, n_words, COALESCE(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_shouts,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {rules_sql()}) AS kept FROM c
"""
