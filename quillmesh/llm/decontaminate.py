"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of tokens: positions marked 1 are hashed, positions marked 0
are ignored, so a window still hits after a substitution at an ignored position. The hashes of
every window of the documents are joined with those of the benchmark; each hit fixes a diagonal
(document offset minus item offset). On each distinct diagonal item and document are compared token by token. A
window of `WINDOW` item tokens (of a shorter item, all of them) of which `min_share` and `min_matched` at
least are equal is an overlap; overlaps on a diagonal extend to one from the first to the last
such window. So a part of an item is found, and both parts of an item with a word put in.

Everything is native. The benchmark side is broadcast only when its row count times windows is
within `max_broadcast_seeds`; beyond it the join shuffles on the seed hash. Hits are distinct
(document, item, diagonal) triples, each verified once; texts are read again only for documents with hits.

Edge cases: null and empty texts have no tokens and are clean; items under `min_matched` tokens cannot be told from
chance and never match; a row is judged by its own text, whether its id is null or repeated; repeated benchmark
rows count once for their id, rows without an id not at all, and of an id with several texts each is searched; of
a pair's diagonals the one with most equal tokens is reported, of equal ones the leftmost in the document;
empty tables give clean documents or no rows; further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, barrier, doc_key, of_documents

SEEDS = ("10100111", "111101", "110111")
MIN_MATCHED = 8
MIN_SHARE = 0.75
WINDOW = 13
SEPARATORS = r"[^\p{L}\p{N}]+"
KEY = ("k1", "k2")


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def seed_hashes(hashes: Column, mask: str) -> Column:
    """Per window start, the hash of the positions that the mask keeps."""
    span, keep = len(mask), [k for k, bit in enumerate(mask) if bit == "1"]
    return F.when(
        F.size(hashes) >= span, F.transform(F.sequence(F.lit(0), F.size(hashes) - span), lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k in keep]))
    ).otherwise(F.array().cast("array<bigint>"))


def seed_rows(df: DataFrame, keys: tuple[str, ...], text: str, position: str, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(*keys, seed, position) for each window of each seed."""
    step = df.select(*keys, barrier(F.transform(tokens_of(F.col(text)), lambda w: F.xxhash64(w))).alias("hashes"))
    step = step.select(*keys, barrier(F.array(*[seed_hashes(F.col("hashes"), m) for m in seeds])).alias("by_seed"))
    return step.select(*keys, F.explode("by_seed").alias("windows")).select(*keys, F.posexplode("windows").alias(position, "seed"))


def _added(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda a, b: a + b)


def overlaps(pairs: DataFrame, min_matched: int, min_share: float, window: int) -> DataFrame:
    """pairs (k1, k2, item_id, diagonal, item, tokens) -> those that overlap: (k1, k2, item_id, diagonal, item_tokens, lo, hi, matched), the overlap in item tokens."""
    equal = F.transform("item", lambda w, i: F.when(w == F.get("tokens", i + F.col("diagonal")), 1).otherwise(0))
    step = pairs.select(*KEY, "item_id", "diagonal", F.size("item").alias("item_tokens"), F.least(F.size("item"), F.lit(window)).alias("width"), barrier(equal).alias("equal"))
    enough = lambda i: (_added(F.slice("equal", i + 1, F.col("width"))) >= F.greatest(F.lit(min_matched), F.ceil(F.lit(min_share) * F.col("width"))))
    step = step.withColumn("dense", barrier(F.filter(F.sequence(F.lit(0), F.col("item_tokens") - F.col("width")), enough))).where(F.size("dense") > 0)
    step = step.select(*KEY, "item_id", "diagonal", "item_tokens", "equal", F.array_min("dense").alias("lo"), (F.array_max("dense") + F.col("width")).alias("hi"))
    return step.select(*KEY, "item_id", "diagonal", "item_tokens", "lo", "hi", barrier(_added(F.slice("equal", F.col("lo") + 1, F.col("hi") - F.col("lo")))).alias("matched"))


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seeds: tuple[str, ...] = SEEDS, min_matched: int = MIN_MATCHED, min_share: float = MIN_SHARE, window: int = WINDOW, max_broadcast_seeds: int = 500_000,
) -> DataFrame:
    """One row per document (k1, k2: id and text) and item that overlap: equal tokens, the item's tokens, the overlap's start and end in document tokens."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id IS NOT NULL").distinct()
    items = items.withColumn("item_key", F.xxhash64("item_text"))
    item_seeds = seed_rows(items, ("item_id", "item_key"), "item_text", "item_pos", seeds)
    small = item_seeds.count() <= max_broadcast_seeds
    fit = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    texts = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("doc_text"))
    hits = seed_rows(texts, KEY, "doc_text", "doc_pos", seeds).join(fit(item_seeds), "seed")
    hits = scratch.put(hits.select(*KEY, "item_id", "item_key", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    item_tokens = items.select("item_id", "item_key", tokens_of(F.col("item_text")).alias("item"))
    found = of_documents(texts, hits.select(*KEY).distinct(), list(KEY)).dropDuplicates(list(KEY)).select(*KEY, barrier(tokens_of(F.col("doc_text"))).alias("tokens"))
    good = overlaps(hits.join(fit(item_tokens), ["item_id", "item_key"]).join(found, list(KEY)), min_matched, min_share, window)
    best = F.max(F.struct("matched", (-F.col("diagonal")).alias("d"), "lo", "hi", "item_tokens")).alias("best")
    start = F.greatest(F.col("best.lo") - F.col("best.d"), F.lit(0))
    out = good.groupBy(*KEY, "item_id").agg(best).select(*KEY, "item_id", F.col("best.matched").alias("matched"), "best.item_tokens", start.alias("start"), (F.col("best.hi") - F.col("best.d")).alias("end"))
    out = scratch.put(out, "overlaps")
    scratch.drop("hits")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_items, first_item (smallest item id), max_matched, contaminated."""
    found = find_overlaps(docs, benchmark, **options).groupBy(*KEY).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("matched").cast("long").alias("max_matched"))
    id_col = options.get("id_col", "doc_id")
    out = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, options.get("text_col", "text"))).join(found, list(KEY), "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", F.coalesce("max_matched", F.lit(0)).cast("long").alias("max_matched"), F.col("n_items").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 500_000, **options) -> DataFrame:
    """The input rows, all columns, without contaminated ones. The contaminated ones' keys are broadcast up to a counted number."""
    found = find_overlaps(docs, benchmark, **options).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    found = F.broadcast(found) if found.count() <= max_broadcast else found
    k1, k2 = doc_key(options.get("id_col", "doc_id"), options.get("text_col", "text"))
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    return keyed.join(found, ["__k1", "__k2"], "left_anti").select(*docs.columns)


def _sql_seeds(table: str, key: str, pos: str) -> str:
    parts = []
    for mask in SEEDS:
        keep = " || ' ' || ".join(f"t[i + {k}]" for k, bit in enumerate(mask) if bit == "1")
        parts.append(f"SELECT {key}, i AS {pos}, '{mask}' AS mask, {keep} AS seed FROM (SELECT {key}, t, unnest(range(1, len(t) - {len(mask)} + 2)) AS i FROM {table})")
    return " UNION ALL ".join(parts)


DECONTAMINATE_SQL = f"""
WITH dt AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
bt AS (SELECT DISTINCT item_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({_sql_seeds("dt", "doc_id", "p")}), bs AS ({_sql_seeds("bt", "item_id", "q")}),
hits AS (SELECT DISTINCT doc_id, item_id, p - q AS diagonal FROM ds JOIN bs USING (mask, seed)),
pos AS (SELECT doc_id, item_id, diagonal, d.t AS dt, b.t AS bt, unnest(range(1, len(b.t) + 1)) AS j FROM hits JOIN dt d USING (doc_id) JOIN bt b USING (item_id)),
eq AS (SELECT doc_id, item_id, diagonal, j, len(bt) AS n, least(len(bt), {WINDOW}) AS w, CASE WHEN j + diagonal >= 1 AND j + diagonal <= len(dt) AND dt[j + diagonal] = bt[j] THEN 1 ELSE 0 END AS e FROM pos),
win AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM eq),
den AS (SELECT doc_id, item_id, diagonal, min(j) AS lo, max(j) + max(w) - 1 AS hi FROM win WHERE j <= n - w + 1 AND s >= greatest({MIN_MATCHED}, ceil({MIN_SHARE} * w)) GROUP BY doc_id, item_id, diagonal),
good AS (SELECT doc_id, item_id, max(matched) AS matched FROM (SELECT doc_id, item_id, diagonal, sum(e) AS matched FROM eq JOIN den USING (doc_id, item_id, diagonal) WHERE j BETWEEN lo AND hi GROUP BY doc_id, item_id, diagonal) GROUP BY doc_id, item_id),
f AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(matched) AS max_matched FROM good GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, first_item, CAST(COALESCE(max_matched, 0) AS BIGINT) AS max_matched, n_items IS NOT NULL AS contaminated
FROM documents d LEFT JOIN f USING (doc_id)
"""
