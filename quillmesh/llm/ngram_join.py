"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles. Two sets A and B are similar if
100 |A n B| >= percent |A u B|, so a partner of A shares at least T = ceil(percent |A| / 100) of its shingles.
In any fixed order of all shingles a partner occurs at least M times in the first |A| - T + M lists,
and with both sizes known at least M + T(a, b) - max(T(a), T(b)) times, T(a, b) being the common
shingles of a similar pair of such sizes. These lists are the ones that are ever read; the order puts
rare shingles first (a count sketch of fixed size over all documents, ties by hash), so the lists of a
passage that many documents hold are left to the last step, which compares whole sets.

Steps: (1) One pass gives each document's set size, a 128-bit set signature and the sketch; equal
sets are one class from here on. (2) A second pass gives the lists; a document whose size rules out
all others of a list leaves it. (3) Every member of a list is compared with the list's centre, the
member that is in most lists (in a group of near copies one of the least edited); while lists that
span several components would still cost more than `WORK` times their length, those outside a list's
largest component are compared with a centre of their own. (4) Every document that is outside the largest
component of some list searches all its lists that span several components: DivideSkip heap-merges
the short ones, with the threshold lowered by the number of long ones, and binary-probes the long ones
for what the merge returns. Those that reach the required overlap are compared. (5) Components by star contraction.

No link is lost: equal sets apart, a similar pair shares at least 6 shingles (6 of 7 is the
smallest overlap of 0.85 without equality; 4 of 5 at 0.8, the least that is admitted), so M = 4 keeps the
guarantee. Of two documents in different components that share a list, one is outside the list's largest
component and so asks, in all lists they share. A pair that is already connected is never compared.

Scale: only prefixes, lists and candidates' sets are shuffled. A hot list is dealt to tasks by salt, cut into
chunks of `CHUNK` ids, and each asker gets only the part that it can be similar to and is not connected with;
hot comparison centres are salted. The sketch (2^17 counters) and up to 500,000 candidate ids are broadcast.

Edge cases: null, empty and blank texts have an empty set and link with nothing (not even with each
other); fewer words than a shingle's make one shingle; repeated rows are in one class; of rows with
one id and different texts the greatest text is searched and all share its component, each with its own
n_shingles; rows without an id link with nothing and have no component; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import Scratch, of_documents
from .components import connected_components
from .hashing import shingles, words_in

M = 4
CHUNK = 2048
WORK = 32
PERCENT = 85


def set_of(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(shingles(words_in(data)[2], k))


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    odd = np.uint64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        a, b = np.sum(s * odd, dtype=np.uint64), np.bitwise_xor.reduce((s ^ (s >> np.uint64(29))) * odd, initial=np.uint64(0)) + np.sum((s >> np.uint64(7)) * s, dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def min_shared(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def least_in_prefixes(a: int, b: int, percent: int) -> int:
    """In how many of both documents' lists a similar pair of such sizes is found at least: of T(a, b) common shingles all but max(T(a), T(b)) - M lie in both prefixes."""
    both = -(-percent * (a + b) // (100 + percent))
    return M + both - max(min_shared(a, percent), min_shared(b, percent))


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, block, cells): a row per document, and rows with the sketch only per task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), *sketch.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(sketch.CELLS, np.int64)
        for batch in batches:
            rows, held = [], 0
            some: list[np.ndarray] = []
            for text in batch.column(1):
                s = set_of(text.as_py(), k)
                rows.append((len(s), *signature(s)))
                some.append(s)
                held += len(s)
                if held > 1 << 20:
                    sketch.added(cells, np.concatenate(some))
                    some, held = [], 0
            if some:
                sketch.added(cells, np.concatenate(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
        yield sketch.rows_of(cells, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id bigint, n bigint, sig_a bigint, sig_b bigint, {sketch.COLUMNS}")


def ordered_set(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A set in the global order: rare cells first, then by hash."""
    return s[np.lexsort((s, cells[sketch.cell_of(s)]))]


def prefixes(docs: DataFrame, cells: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, salt, doc, n): the lists that a document is in, of equal sets in a task those of the first one."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        salts = sketch.salts_of(counts)

        def rows(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(p) for *_, p in parts]
            docs_of, n_of = (np.repeat(np.array([x[i] for x in parts], np.int64), sizes) for i in (0, 1))
            tokens = np.concatenate([p for *_, p in parts])
            salt = (docs_of * 0x9E3779B1 & 0x7FFFFFFF) % salts[sketch.cell_of(tokens)]
            return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(docs_of), pa.array(n_of)], schema=schema)

        for batch in batches:
            parts: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = set_of(text.as_py(), k)
                n = len(s)
                if n * (100 - percent) < percent or (sig := signature(s)) in seen:  # smaller sets have no similar one but equals: 6 at 85 percent, 4 at 80
                    continue
                seen.add(sig)
                parts.append((doc, n, ordered_set(s, counts)[: n - min_shared(n, percent) + M]))
                held += len(parts[-1][2])
                if held > 1 << 18:
                    yield rows(parts)
                    parts, held = [], 0
            if parts:
                yield rows(parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "token bigint, salt int, doc bigint, n bigint")


def shared_lists(postings: DataFrame, cells: np.ndarray, percent: int) -> DataFrame:
    """(token, doc, n): of each list the members with a neighbour by size that may be similar, which is all that can have a partner there; of lists dealt by salt all members.

    A stream over the sorted rows that holds back one row.
    """
    shared = postings.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salted = sketch.salts_of(shared.value) > 1
        last = np.zeros((3, 0), np.int64)
        linked = False  # whether the row that is held back fits the one before it

        def kept(rows: np.ndarray, ends: bool) -> pa.RecordBatch:
            nonlocal last, linked
            token, _, n = rows
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            wanted = np.zeros(len(token), bool)
            wanted[1:] |= near
            wanted[:-1] |= near
            if len(token):
                wanted[0] |= linked
                linked = bool(wanted[-1])
                wanted |= salted[sketch.cell_of(token.astype(np.uint64))]
            last = rows[:, -1:] if not ends else rows[:, :0]
            out = rows[:, : len(token) if ends else len(token) - 1][:, wanted[: len(token) if ends else len(token) - 1]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)

        for batch in batches:
            if batch.num_rows:
                yield kept(np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in ("token", "doc", "n")])], 1), False)
        yield kept(last, True)

    return postings.repartition("token", "salt").sortWithinPartitions("token", "n").select("token", "doc", "n").mapInArrow(run, "token bigint, doc bigint, n bigint")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc, shingles): sorted sets as little-endian 64-bit numbers."""
    schema = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                sets.append(set_of(text.as_py(), k).tobytes())
                held += len(sets[-1])
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, shingles binary")


def probe(center: np.ndarray, member: np.ndarray) -> int:
    """How many of the shorter set's shingles the longer one holds: binary search."""
    short, long_ = (center, member) if len(center) < len(member) else (member, center)
    at = np.searchsorted(long_, short)
    at[at == len(long_)] = 0
    return int((long_[at] == short).sum()) if len(long_) else 0


def _pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are similar. b's set is sent to its members' tasks; a hot b is salted over many."""
    pairs = scratch.put(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    texts = of_documents(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), ids, "doc")
    sets = sets_of(texts, k).dropDuplicates(["doc"])
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 1024).cast("int").alias("salts"))
    members = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a").alias("doc"), F.lit(1).alias("member"))
    centers = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("b").alias("doc"), F.lit(0).alias("member"))
    rows = members.unionByName(centers).join(sets, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            raw = batch.column("shingles")
            for i, (b, doc, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "doc", "member")), strict=True)):
                s = np.frombuffer(raw[i].as_py(), np.uint64)
                if not member:
                    center = s
                elif similar(probe(center, s), len(center), len(s), percent):
                    found.append((doc, b))
            yield _pairs_of(found)

    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member").select("b", "doc", "member", "shingles").mapInArrow(run, "a bigint, b bigint")


def t_occurrence(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, count) of the ids in at least so many of the sorted lists: a heap merge."""
    out = []
    for key, run in groupby(heapq.merge(*lists)):
        n = sum(1 for _ in run)
        if n >= least:
            out.append((key, n))
    return out


def divide_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, count) of the ids in at least so many of the sorted lists: the short ones are merged, the long ones probed."""
    lists = sorted(lists, key=len)
    n_long = min(int(least / (1 + math.log2(max(len(lists[-1]), 1)))), least - 1, len(lists) - 1) if lists else 0
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for key, n in t_occurrence(short, least - n_long):
        n += sum(1 for x in long_ if (at := bisect_left(x, key)) < len(x) and x[at] == key)
        if n >= least:
            out.append((key, n))
    return out


def searched(queries: DataFrame, percent: int) -> DataFrame:
    """queries (a, chunk, n, ids, sizes): per query a, the parts of its lists that a chunk of all ids holds. Candidates (a, b)."""

    def candidates(a: int, n: int, lists: list[list[int]], size: dict[int, int]) -> Iterator[tuple[int, int]]:
        least = min(least_in_prefixes(n, s, percent) for s in (min(size.values()), max(size.values())))  # between them the bound is no lower
        if len(lists) >= least:
            yield from ((a, b) for b, count in divide_skip(lists, least) if count >= least_in_prefixes(n, size[b], percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, lists, size = None, 0, [], {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            ids, sizes = batch.column("ids"), batch.column("sizes")
            for i, (*now, n_now) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "n")), strict=True)):
                if now != key:
                    if lists:
                        out += candidates(key[0], n, lists, size)
                    key, n, lists, size = now, n_now, [], {}
                lists.append(ids[i].values.to_pylist())
                size.update(zip(lists[-1], sizes[i].values.to_pylist(), strict=True))
            yield _pairs_of(out)
        yield _pairs_of(list(candidates(key[0], n, lists, size)) if lists else [])

    return queries.repartition("a", "chunk").sortWithinPartitions("a", "chunk").select("a", "chunk", "n", "ids", "sizes").mapInArrow(run, "a bigint, b bigint")


def labelled_lists(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return postings.withColumn("label", F.col("doc"))
    return postings.join(components.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "n", "weight", F.coalesce("component", "doc").alias("label"))


def mixed_lists(labelled: DataFrame) -> DataFrame:
    """(token, df, main, inside): the lists that span several components, their largest one and how many of the list are in it."""
    shares = labelled.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("token").agg(F.count("*").alias("labels"), F.sum("c").alias("df"), F.max(F.struct("c", "label")).alias("top")).where("labels > 1")
    return mixed.select("token", "df", F.col("top.label").alias("main"), F.col("top.c").alias("inside"))


def centre_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members (token, doc, n, weight, label) -> (a, b): each member with its list's centre, if it is in another component and they share enough of these lists."""
    centers = members.groupBy("token").agg(F.max(F.struct("weight", (-F.col("doc")).alias("d"), "n", "label")).alias("top")).select("token", (-F.col("top.d")).alias("b"), F.col("top.n").alias("m"), F.col("top.label").alias("other"))
    pairs = members.join(centers, "token").where((F.col("label") != F.col("other")) & _sizes_fit(F.col("n"), F.col("m"), percent))
    pairs = pairs.groupBy(F.col("doc").alias("a"), "b").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("m").alias("m"))
    bound = lambda x, per: F.ceil(percent * x / per)
    return pairs.where(F.col("c") >= M + bound(F.col("n") + F.col("m"), 100 + percent) - bound(F.greatest("n", "m"), 100)).select("a", "b")


def queries_of(rows: DataFrame, max_df: int, percent: int) -> DataFrame:
    """rows (token, doc, n, label, inside: in the list's largest component) -> `searched`'s queries: each document that is outside in some list asks in all its lists.

    Of each list it gets those in other components whose size fits; of two askers the smaller id asks.
    """
    chunks = -(-max_df // CHUNK)  # one number for all lists, so that an id is in the same chunk of each
    askers = rows.where("NOT inside").select("doc").distinct().withColumn("asks", F.lit(True))
    rows = rows.join(askers, "doc", "left").select("token", "doc", "n", "label", F.coalesce("asks", F.lit(False)).alias("asks"))
    chunk = F.pmod(F.xxhash64("doc"), F.lit(chunks)).alias("chunk")
    lists = rows.groupBy("token", chunk).agg(F.sort_array(F.collect_list(F.struct("doc", "n", "label", "asks"))).alias("l"))
    asked = rows.where("asks").select("token", F.col("doc").alias("a"), "n", "label").join(lists, "token")
    fits = F.filter("l", lambda x: (x["label"] != F.col("label")) & _sizes_fit(x["n"], F.col("n"), percent) & (~x["asks"] | (x["doc"] > F.col("a"))))
    asked = asked.select("a", "chunk", "n", fits.alias("l")).where(F.size("l") > 0)
    return asked.select("a", "chunk", "n", F.col("l.doc").alias("ids"), F.col("l.n").alias("sizes"))


def linked(docs: DataFrame, cells: np.ndarray, copies: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the class representatives that have a similar one. copies: (doc, class_id) of the other documents."""
    listed = shared_lists(prefixes(docs, cells, k, percent), cells, percent)
    mapped = scratch.put(listed.join(copies, "doc", "left").select("token", F.coalesce("class_id", "doc").alias("doc"), "n").dropDuplicates(["token", "doc"]), "mapped")
    weights = mapped.groupBy("doc").agg(F.count("*").alias("weight")).where(F.col("weight") >= M)
    postings = scratch.put(mapped.join(weights, "doc").select("token", "doc", "n", "weight"), "postings")
    scratch.drop("mapped")
    edges, components = None, None
    while True:
        labelled = labelled_lists(postings, components)
        if components is None:
            members = labelled
        else:
            mixed = scratch.put(mixed_lists(labelled), "mixed")
            total = mixed.agg(F.sum("df").alias("df"), F.sum((F.col("df") - F.col("inside")) * F.col("df")).alias("work"), F.max("df").alias("longest")).first()
            rows = labelled.join(mixed, "token").select("token", "doc", "n", "weight", "label", (F.col("label") == F.col("main")).alias("inside"))
            if not total["df"] or total["work"] <= WORK * total["df"] or rounds == 4:
                break
            members = rows.where("NOT inside")
        rounds = 1 if components is None else rounds + 1
        found = scratch.put(verified(centre_pairs(members, percent), docs, k, percent, scratch), f"links{rounds}")
        edges = found if edges is None else edges.unionByName(found)
        components = scratch.put(connected_components(edges, scratch), "components")
    if total["df"]:
        rows = scratch.put(rows, "rows")
        candidates = searched(queries_of(rows.drop("weight"), total["longest"], percent), percent)
        found = scratch.put(verified(candidates, docs, k, percent, scratch), "links")
        if not found.isEmpty():
            components = scratch.put(connected_components(edges.unionByName(found), scratch), "components")
    scratch.drop(*[x for x in scratch.paths if x not in ("components", "signed", "known", "classes")])
    return components


def similar_classes(docs: DataFrame, k: int = 4, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, class_id): class_id is the smallest id with an equal set, component_id the smallest one reachable over links."""
    if percent < 80:
        raise ValueError("the guarantee of M shared lists is proved for 80 percent or more")
    scratch = Scratch(docs.sparkSession, "ngram-join")
    signed = scratch.put(signatures(docs, k), "signed")
    rows = signed.where("block IS NULL").select("doc_id", "n", "sig_a", "sig_b")
    known, texts = rows.where("doc_id IS NOT NULL"), docs.where("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min(F.struct("n", "sig_a", "sig_b")).alias("low"), F.max(F.struct("n", "sig_a", "sig_b")).alias("high")).where("low <> high")
    one_text = several.isEmpty()
    if not one_text:
        texts = scratch.put(texts.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text")), "texts")
        known = scratch.put(signatures(texts, k), "known").where("block IS NULL").select("doc_id", "n", "sig_a", "sig_b")
    cells = sketch.merged(signed.where("block IS NOT NULL"))
    key = ["sig_a", "sig_b", "n"]
    classes = known.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last"))
    classes = scratch.put(classes, "classes")  # as a table of its own, so that the joins below have exchanges that AQE splits where a class is hot
    copies = known.join(classes.where("class_id <> last"), key).where("doc_id <> class_id").select(F.col("doc_id").alias("doc"), "class_id").distinct()
    components = linked(texts, cells, scratch.put(copies, "copies"), k, percent, scratch)
    of_class = classes.join(components.withColumnRenamed("node", "class_id"), "class_id", "left").select(*key, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    if one_text:
        out = rows.join(of_class, key, "left")
        known_id = F.col("doc_id").isNotNull()
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known_id, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known_id, F.coalesce("class_id", "doc_id")).alias("class_id"))
    by_id = known.join(of_class, key, "left").select("doc_id", "component_id", "class_id").distinct()
    return rows.join(by_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The input's rows, of each component the one with the smallest doc_id (documents with an empty set and rows without an id all stay)."""
    found = similar_classes(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["__gone"], "left_anti")
