"""Line deduplication: a suffix array over line ids by distributed prefix doubling, and its LCP intervals.

A document is the sequence of its lines that hold a word (blank lines are no part of it and are
never removed). Every line has an id, a 128-bit hash.

1. Prefix doubling names the run of `min_lines` lines at each position, then those of twice as many from
   the names of their halves, and so on. Positions with one name are an interval of the suffix array with at
   least that LCP; a position whose name no other has is unique from there on and takes no
   further part. The doubling ends when all names are unique.
2. The interval of `min_lines` lines gives each position its original, the first one in (id, text, line) order. Where
   position and original are not just the next ones of a pair before, a maximal run begins; its length is the LCP of the two
   suffixes, found by descent over the doubling's names.
3. All runs but the originals are removed. Of a copy that overlaps its original (`a a a`) only lines beyond
   the original's first `min_lines` lines go.

With `long_words`, a single line of more words than that is a run as well (a passage without line breaks); the registered
query, whose SQL knows runs of MIN_LINES only, leaves it out, the corpus pipeline sets it.

Scale: names of one document's lines are made within its row. All positions are shuffled once, as 128-bit names counted
before the shuffle (a hot run is one row a map task); the rounds carry only positions that repeat, and their joins have
exchanges that AQE splits where skewed. Texts are joined with the runs to cut by broadcast up to
`MAX_RUNS` runs, else by a shuffle.

Edge cases: null and empty texts have no lines and stay as they are; rows that are equal in id
and text count as one document, so none is the other's copy; rows without an id are documents by their text; ties cannot
occur between others, as (id, text, line) orders all; an empty table gives an empty result; further columns
are kept by `dedup_lines`, but for columns of REPORT, which the operator's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, Scratch, barrier, doc_key

MIN_LINES = 2
LONG_WORDS = 50
MAX_RUNS = 500_000
REPORT = ("n_lines", "n_removed", "n_runs")
KEY = ("k1", "k2")


def joined_name(left: str, right: str) -> list[Column]:
    """The name of two runs that follow each other."""
    return [F.xxhash64(f"{left}.a", f"{right}.a").alias("a"), F.xxhash64(F.lit(3), f"{left}.b", f"{right}.b").alias("b")]


def is_long(line: Column, words: int) -> Column:
    """Whether a line has more than so many words; a line too short for them is not split."""
    return F.when(F.length(line) > 2 * words, F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")) > words).otherwise(F.lit(False))


def _pair_names(k: int) -> Column:
    """The names of the runs at i and i + k of the array names, for every i."""

    def pair(i: Column) -> Column:
        x, y = F.get("names", i), F.get("names", i + k)
        return F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(F.lit(k), x["b"], y["b"]).alias("b"))

    return F.when(F.size("names") > k, F.transform(F.sequence(F.lit(0), F.size("names") - 1 - k), pair)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def positions(docs: DataFrame, min_lines: int, id_col: str, text_col: str, long_words: int | None = None) -> DataFrame:
    """(id, k1, k2, pos, length, a, b): the name of the run of min_lines lines at each position, with long_words also those of long single lines."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(WORD_CLASS))
    step = docs.select(F.col(id_col).alias("id"), *doc_key(id_col, text_col), barrier(lines).alias("lines"))
    ids = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    alone = [] if long_words is None else [barrier(F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("length"), F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(9), x).alias("b"), is_long(x, long_words).alias("long"))), lambda s: s["long"])).alias("alone")]
    step = step.select("id", *KEY, barrier(ids).alias("names"), *alone)
    length = 1
    while length < min_lines:
        k = min(length, min_lines - length)
        step = step.select("id", *KEY, barrier(_pair_names(k)).alias("names"), *(["alone"] if alone else []))
        length += k
    runs = F.transform("names", lambda x, i: F.struct(i.alias("pos"), F.lit(min_lines).alias("length"), x["a"].alias("a"), x["b"].alias("b")))
    if alone:
        runs = F.concat(runs, F.transform("alone", lambda x: F.struct(x["pos"].alias("pos"), x["length"].alias("length"), x["a"].alias("a"), x["b"].alias("b"))))
    return step.select("id", *KEY, F.explode(barrier(runs)).alias("r")).select("id", *KEY, "r.pos", "r.length", "r.a", "r.b")


def intervals(named: DataFrame) -> DataFrame:
    """Of the positions those whose name another has: (k1, k2, pos, length, a, b, o1, o2, opos), the original's document and position."""
    at = F.struct("id", *KEY, "pos")
    classes = named.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("NOT (first <=> last)")
    classes = classes.select("a", "b", F.col("first.k1").alias("o1"), F.col("first.k2").alias("o2"), F.col("first.pos").alias("opos"))
    return named.join(classes, ["a", "b"]).select(*KEY, "pos", "length", "a", "b", "o1", "o2", "opos").dropDuplicates([*KEY, "pos", "length"])


def doubled(level: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, pos, a, b) for runs of depth lines -> the same for runs of twice as many, those that repeat."""
    x, y = level.alias("x"), level.alias("y")
    same = (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & (F.col("x.pos") + depth == F.col("y.pos"))
    longer = x.join(y, same).select("x.k1", "x.k2", "x.pos", *joined_name("x", "y"))
    return longer.join(longer.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["a", "b"]).select(*KEY, "pos", "a", "b")


def with_lcp(starts: DataFrame, levels: list[DataFrame], min_lines: int) -> DataFrame:
    """starts (k1, k2, pos, o1, o2, opos), which share min_lines lines at least -> with lcp, the lines that both suffixes share."""

    def equal(rows: DataFrame, level: DataFrame, offset: Column, gain: int) -> DataFrame:
        """lcp + gain where both runs of the level's length at this offset have one name."""
        mine = level.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("pos").alias("pp"), F.col("a").alias("pa"), F.col("b").alias("pb"))
        its = level.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("pos").alias("qp"), F.col("a").alias("qa"), F.col("b").alias("qb"))
        rows = rows.withColumn("offset", offset)
        rows = rows.join(mine, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & (F.col("pos") + F.col("offset") == F.col("pp")), "left")
        rows = rows.join(its, (F.col("o1") == F.col("q1")) & (F.col("o2") == F.col("q2")) & (F.col("opos") + F.col("offset") == F.col("qp")), "left")
        hit = (F.col("pa") == F.col("qa")) & (F.col("pb") == F.col("qb"))
        return rows.select(*KEY, "pos", "o1", "o2", "opos", (F.col("lcp") + F.when(hit, gain).otherwise(0)).alias("lcp"))

    rows = starts.withColumn("lcp", F.lit(0))
    for j in reversed(range(len(levels))):
        rows = equal(rows, levels[j], F.col("lcp"), min_lines << j)
    part = 1 << (min_lines - 1).bit_length() >> 1 if levels else 0
    while part:  # fewer than min_lines lines are left: the run of min_lines that ends there
        if part < min_lines:
            rows = equal(rows, levels[0], F.col("lcp") + (part - min_lines), part)
        part >>= 1
    return rows


def later_copies(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """(k1, k2, start, length, o1, o2, opos): the maximal runs that an earlier position holds as well, and that position."""
    named = scratch.put(positions(docs, min_lines, id_col, text_col, long_words), "positions")
    members = scratch.put(intervals(named), "intervals")
    scratch.drop("positions")
    level, levels, depth = members.where(F.col("length") == min_lines).select(*KEY, "pos", "a", "b"), [], min_lines
    if min_lines == 1:
        level = level.dropDuplicates([*KEY, "pos"])
    while not level.isEmpty():
        levels.append(level)
        level = scratch.put(doubled(level, depth), f"level{depth * 2}")
        depth *= 2
    later = members.where(~(F.col("k1").eqNullSafe(F.col("o1")) & F.col("k2").eqNullSafe(F.col("o2")) & (F.col("pos") == F.col("opos"))))
    alone = later.where(F.col("length") != min_lines).select(*KEY, F.col("pos").alias("start"), "length", "o1", "o2", "opos")
    in_order = Window.partitionBy(*KEY).orderBy("pos")
    before = F.lag(F.struct("pos", "o1", "o2", "opos")).over(in_order)
    goes_on = before.eqNullSafe(F.struct((F.col("pos") - 1).alias("pos"), "o1", "o2", (F.col("opos") - 1).alias("opos")))
    starts = later.where(F.col("length") == min_lines).withColumn("goes_on", goes_on).where("NOT goes_on").select(*KEY, "pos", "o1", "o2", "opos")
    runs = with_lcp(starts, levels, min_lines).select(*KEY, F.col("pos").alias("start"), F.col("lcp").alias("length"), "o1", "o2", "opos")
    return runs.unionByName(alone) if long_words is not None else runs


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None) -> DataFrame:
    """The input's rows and columns, text without later copies of repeated runs, and REPORT."""
    if {id_col, text_col} & set(REPORT):
        raise ValueError(f"the id or the text cannot be named one of {REPORT}")
    docs = docs.drop(*REPORT)
    scratch = Scratch(docs.sparkSession, "line-dedup")
    runs = scratch.put(later_copies(docs, scratch, min_lines, id_col, text_col, long_words), "runs")
    scratch.drop(*[x for x in scratch.paths if x != "runs"])
    own = (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2"))
    begin = F.when(own, F.greatest("start", F.col("opos") + F.least("length", F.lit(min_lines)))).otherwise(F.col("start"))
    cut = runs.select(*KEY, F.struct(begin.alias("lo"), (F.col("start") + F.col("length")).alias("hi")).alias("run")).where("run.lo < run.hi")
    cut = cut.groupBy(*KEY).agg(F.collect_set("run").alias("__runs"))
    small = runs.count() <= MAX_RUNS
    columns = [F.col(c) for c in docs.columns]
    key = [c.alias("__" + n) for c, n in zip(doc_key(id_col, text_col), KEY, strict=True)]
    cut = cut.withColumnsRenamed({n: "__" + n for n in KEY})
    joined = docs.select(*columns, *key).join(F.broadcast(cut) if small else cut, ["__" + n for n in KEY], "left")
    lines, numbers, covered = (F.col("__" + c) for c in ("lines", "numbers", "covered"))
    step = joined.select(*columns, "__runs", barrier(F.split(F.col(text_col), "\n")).alias("__lines"))
    numbers_of = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(WORD_CLASS).alias("w"))), lambda s: s["w"]), lambda s: s["i"])
    spread = F.array_distinct(F.flatten(F.transform("__runs", lambda r: F.sequence(r["lo"], r["hi"] - 1))))
    step = step.select(*columns, "__lines", barrier(F.when(F.col("__runs").isNotNull(), numbers_of)).alias("__numbers"), barrier(F.sort_array(F.coalesce(spread, F.array().cast("array<int>")))).alias("__covered"))
    n_runs = F.size(F.filter(covered, lambda c, i: (i == 0) | (F.get(covered, i - 1) < c - 1)))
    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1))
    removed = F.transform(covered, lambda c: F.get(numbers, c))
    left = F.array_except(every, removed)
    text = F.when(F.size(covered) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(F.col(text_col))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return step.select(*out, F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.size(covered).cast("long").alias("n_removed"), n_runs.cast("long").alias("n_runs"))


def line_dedup_digest(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text"), min_lines).select("doc_id", *REPORT, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def dedup_ctes(source: str) -> str:
    """CTEs up to `kept` (doc_id, n_lines, n_removed, n_runs, text) over a relation with doc_id and text, for MIN_LINES = 2."""
    return f"""
ln AS (SELECT doc_id, md5(text) AS th, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {source})),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, th ORDER BY no) AS k FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
pr AS (SELECT doc_id, th, no, k, line AS l1, lead(line) OVER (PARTITION BY doc_id, th ORDER BY no) AS l2, lead(no) OVER (PARTITION BY doc_id, th ORDER BY no) AS no2 FROM nb),
fl AS (SELECT doc_id, th, no, no2, k, row_number() OVER w AS r, first_value(doc_id) OVER w = doc_id AND first_value(k) OVER w + 1 = k AS same_run
       FROM pr WHERE l2 IS NOT NULL WINDOW w AS (PARTITION BY l1, l2 ORDER BY doc_id, k)),
rm AS (SELECT DISTINCT doc_id, th, no FROM (SELECT doc_id, th, no FROM fl WHERE r > 1 AND NOT same_run UNION ALL SELECT doc_id, th, no2 FROM fl WHERE r > 1)),
mk AS (SELECT ln.doc_id, ln.th, ln.no, ln.line, rm.no IS NOT NULL AS gone, nb.k AS k FROM ln LEFT JOIN rm USING (doc_id, th, no) LEFT JOIN nb USING (doc_id, th, no)),
rn AS (SELECT doc_id, th, count(*) AS n FROM (SELECT doc_id, th, k - lag(k) OVER (PARTITION BY doc_id, th ORDER BY k) AS g FROM mk WHERE gone) WHERE g IS NULL OR g > 1 GROUP BY doc_id, th),
kept AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, COALESCE(max(rn.n), 0) AS n_runs, COALESCE(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
         FROM mk LEFT JOIN rn USING (doc_id, th) GROUP BY doc_id, th)"""


LINE_DEDUP_SQL = f"""
WITH {dedup_ctes("documents")}
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_runs AS BIGINT) AS n_runs, sha256(text) AS kept_sha256 FROM kept
"""
