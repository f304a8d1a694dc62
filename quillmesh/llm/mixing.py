"""Mixing sources to target weights by Poisson replication.

With target weights w and N documents, source s is to hold N * w(s) rows; each of its n(s)
documents is repeated Poisson(N * w(s) / n(s)) times. The count inverts the Poisson distribution
at a number in [0, 1) hashed from seed and document id, so it depends on neither partitioning nor
retries. Each document is exploded by its count and the copies are ordered by a hash: a global
shuffle that any executor can repeat.

The cumulative distribution is tabulated once per source, over all counts of a probability above
2^-53 at rates of 64 or less; a higher rate is split in equal parts with a draw each, so no count is
capped. Sources without a target weight share the rest of the weights by their size (or the
weights are taken relative if they add up to 1 or more, such sources then get none).

Per-source tables are joined by broadcast where the number of sources is within
`max_broadcast_sources`, else by a shuffle that AQE splits where a source is hot.

Edge cases: a null source is a source of its own; a null id is hashed as the empty text; rows
with equal ids get equal counts; an empty table gives no rows; further columns are kept, but for columns
named `copy` or `shuffle_key`, which the operator's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Production parameters: weights of the mixture.
TARGET_WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.07}
SEED = "mix-1"
MAX_RATE = 64.0


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... up to the last count that 53 bits can tell from its successor."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["c"])


def source_rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate, parts, cdf): the target repetition rate of each source of the table."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    total = sum(weights.values())
    step = counts.withColumn("weight", F.try_element_at(given, F.coalesce("source", F.lit(""))))
    sums = counts.agg(F.sum("n_docs").alias("all_docs"), F.coalesce(F.sum(F.when(~F.coalesce(F.col("source").isin(list(weights)), F.lit(False)), F.col("n_docs"))), F.lit(0)).alias("rest_docs"))
    step = step.join(F.broadcast(sums))  # one row
    rest = max(0.0, 1.0 - total)
    share = F.coalesce(F.col("weight") / max(1.0, total), F.lit(rest) * F.col("n_docs") / F.col("rest_docs"))
    step = step.select("source", "n_docs", (F.col("all_docs") * share / F.col("n_docs")).alias("rate"))
    step = step.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    return step.withColumn("cdf", poisson_table(F.col("rate") / F.col("parts")))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True, max_broadcast_sources: int = 20_000
) -> DataFrame:
    """The input's columns, copy (1, 2, ...) and shuffle_key, in the order of shuffle_key."""
    if {id_col, source_col} & {"copy", "shuffle_key"}:
        raise ValueError("the id or the source cannot be named copy or shuffle_key")
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, TARGET_WEIGHTS if weights is None else weights, source_col).select(F.col("source").alias("__mix_source"), "parts", "cdf").withColumnsRenamed({"parts": "__mix_parts", "cdf": "__mix_cdf"})
    side = F.broadcast(rates) if rates.count() <= max_broadcast_sources else rates
    joined = docs.join(side, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col("__mix_parts")), lambda j: unit(F.lit(seed), key, j.cast("string")))
    drawn = joined.select(*docs.columns, F.col("__mix_cdf"), draws.alias("__mix_draws"))
    count = F.aggregate(F.col("__mix_draws"), F.lit(0), lambda a, u: a + F.size(F.filter(F.col("__mix_cdf"), lambda c: c <= u)))
    counted = drawn.select(*docs.columns, count.alias("__mix_n")).where("__mix_n > 0")
    copies = counted.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("copy"))
    out = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), key, F.col("copy").cast("string")).cast("binary")))
    return out.orderBy("shuffle_key") if shuffle else out


def mix_sql(docs: str, weights: dict[str, float] | None = None, seed: str = SEED) -> str:
    """The query's rows as SQL over a relation with doc_id, text, lang, source, n_chars."""
    weights = TARGET_WEIGHTS if weights is None else weights
    total = sum(weights.values())
    given = " ".join(f"WHEN '{k}' THEN CAST({v / max(1.0, total)!r} AS DOUBLE)" for k, v in weights.items())
    names = ", ".join(f"'{k}'" for k in weights)
    hashed = "md5('{seed}|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || {n})"
    return f"""
WITH docs AS ({docs}),
cnt AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
tot AS (SELECT sum(n) AS n_all, sum(CASE WHEN source IN ({names}) THEN 0 ELSE n END) AS n_rest FROM cnt),
rate AS (SELECT source, n_all * COALESCE(CASE source {given} END, CAST({max(0.0, 1.0 - total)!r} AS DOUBLE) * n / n_rest) / n AS r FROM cnt, tot),
part AS (SELECT source, r, GREATEST(1, CAST(ceil(r / {MAX_RATE}) AS INTEGER)) AS m FROM rate),
ks AS (SELECT source, r / m AS l, m, unnest(range(0, CAST(ceil(r / m + 12 * sqrt(r / m) + 24) AS INTEGER) + 1)) AS k FROM part),
pk AS (SELECT source, m, k, exp(-l) * COALESCE((SELECT product(l / j) FROM (SELECT unnest(range(1, ks.k + 1)) AS j)), 1) AS p FROM ks),
cdf AS (SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pk),
cdfs AS (SELECT source, max(m) AS m, list(c ORDER BY k) AS c FROM cdf GROUP BY source),
drawn AS (SELECT doc_id, source, text, lang, n_chars, c, unnest(range(1, m + 1)) AS j FROM docs JOIN cdfs USING (source)),
u AS (SELECT *, CAST(('0x' || substr({hashed.format(seed=seed, n="CAST(j AS VARCHAR)")}, 1, 13)) AS BIGINT) / CAST({2**52} AS DOUBLE) AS u FROM drawn),
num AS (SELECT doc_id, source, text, lang, n_chars, CAST(sum(len(list_filter(c, lambda x: x <= u))) AS INTEGER) AS n FROM u GROUP BY doc_id, source, text, lang, n_chars),
cp AS (SELECT doc_id, source, text, lang, n_chars, unnest(range(1, n + 1)) AS copy FROM num)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {hashed.format(seed=seed + "-order", n="CAST(copy AS VARCHAR)")} AS shuffle_key FROM cp
"""


MIX_SQL = mix_sql("SELECT doc_id, text, lang, source, n_chars FROM documents")
