"""The co-recipiency graph: edges, neighbours, PageRank, communities.

Edges are counted by a self-join of thread participants, after pairs are reduced to one row per
thread and participant; a thread of many participants is cut into tiles, so that its pairs are many
tasks' work. PageRank and communities (which grow by merges that raise modularity) are joins and aggregations
over all accounts at once, each round's tables written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import Stage
from . import rollups as R


def members(threads: DataFrame, messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """(account, thread_id, address): participants of threads without a list message that are contacts."""
    lists = messages.where(F.col("is_list")).select("account", "thread_id").distinct()
    rows = threads.join(lists, ["account", "thread_id"], "left_anti").select("account", "thread_id", F.explode("participants").alias("address")).distinct()
    return rows.join(contacts.select("account", "address"), ["account", "address"], "left_semi")


def members_of(messages: DataFrame, stage: Stage) -> DataFrame:
    """`members` of the messages' own threads and contacts, as a table of the stage: one pass over the people of messages and one over list messages."""
    rows = R.participations(messages).groupBy("account", "thread_id", "address").agg(F.max("placed").alias("placed"), F.max("contact").alias("contact"))
    rows = stage.put("people", rows)
    lists = messages.where(F.col("is_list")).select("account", "thread_id").distinct()
    placed = rows.where("placed")
    rest = placed.where("NOT contact")  # an account's own addresses as a rule: few that differ
    also = rest.select("account", "address").distinct().join(rows.where("contact").select("account", "address").distinct(), ["account", "address"], "left_semi")
    found = placed.where("contact").unionByName(rest.join(also, ["account", "address"], "left_semi"))
    out = stage.put("members", found.join(lists, ["account", "thread_id"], "left_anti").select("account", "thread_id", "address"))
    stage.drop("people")
    return out


#: Participants of a tile's side; a tile makes at most 2 * TILE * TILE pairs.
TILE = 256


def tiled(people: DataFrame, tile: int = TILE) -> DataFrame:
    """people with `block` (of its thread's participants), `row` and `col`: each participant once for each tile of the triangle that its block has a side of. A thread of up to `tile` participants is one tile."""
    large = people.groupBy("account", "thread_id").count().where(F.col("count") > tile).select("account", "thread_id", F.ceil(F.col("count") / tile).cast("int").alias("blocks"))
    rows = people.join(large, ["account", "thread_id"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("address"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("account", "thread_id", "address", "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"))


def edges(people: DataFrame, tile: int = TILE) -> DataFrame:
    """(account, src, dst, weight): src < dst, weight = threads shared."""
    sides = tiled(people, tile)
    a = sides.where("block = row").select("account", "thread_id", "row", "col", F.col("address").alias("a"))
    b = sides.where("block = col").select("account", "thread_id", "row", "col", F.col("address").alias("b"))
    pairs = a.join(b, ["account", "thread_id", "row", "col"]).where("row < col OR a < b")
    return pairs.groupBy("account", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("weight"))


def both_ways(found: DataFrame) -> DataFrame:
    return found.unionByName(found.select("account", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbours(found: DataFrame, limit: int = 15) -> DataFrame:
    """Per address the addresses that share most threads with it."""
    rank = F.row_number().over(W.partitionBy("account", "src").orderBy(F.desc("weight"), "dst"))
    return both_ways(found).withColumn("rank", rank).where(F.col("rank") <= limit).withColumnsRenamed({"src": "address", "dst": "neighbour", "weight": "shared_threads"})


def neighbours_of(people: DataFrame, address: str, limit: int = 15) -> DataFrame:
    """`neighbours` of one address, from the threads that it takes part in alone."""
    threads = people.where(F.col("address") == address).select("account", "thread_id").distinct()
    near = people.join(threads, ["account", "thread_id"], "left_semi").where(F.col("address") != address)
    near = near.groupBy("account", F.col("address").alias("neighbour")).agg(F.count("*").alias("shared_threads"))
    rank = F.row_number().over(W.partitionBy("account").orderBy(F.desc("shared_threads"), "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select("account", F.lit(address).alias("address"), "neighbour", "shared_threads", "rank")


#: Whether an account has settled is looked at after every so many steps; the ranks are written then.
SETTLED_EVERY = 10


def pagerank(people: DataFrame, found: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, iterations: int = 100) -> DataFrame:
    """(account, address, centrality): weighted PageRank per account, from equal ranks, until it moves by no more than its nodes times the tolerance.

    All accounts are iterated at once, whatever their sizes. Edges lead both ways, so a node that leads nowhere is reached from nowhere: all such
    nodes of an account have one rank (`lone`), which follows from itself, and what they spread needs no aggregation. Every node links to itself with
    share 0, which keeps it and carries its last rank along. So a step is a join with the links and an aggregation, one shuffle of partial
    sums. Accounts that have settled keep their ranks and leave.
    """
    stage, key = Stage(people.sparkSession, "pagerank"), ["account", "address"]
    nodes = stage.put("nodes", people.select(*key).distinct())
    edges_of = stage.put("links", both_ways(found.select("account", "src", "dst", "weight")).withColumnRenamed("src", "address"))
    totals = edges_of.groupBy(*key).agg(F.sum("weight").alias("total"))
    shares = edges_of.join(totals, key).select(*key, "dst", (F.col("weight") / F.col("total")).alias("share"))
    links = stage.put("shares", shares.unionByName(nodes.select(*key, F.col("address").alias("dst"), F.lit(0.0).alias("share"))))
    sizes = nodes.join(totals, key, "left").groupBy("account").agg(F.count("*").alias("n"), F.count_if(F.col("total").isNull()).alias("n_lone"))
    equal = F.lit(1.0) / F.col("n")
    ranks = stage.put("ranks", nodes.join(sizes, "account").select(*key, "n", "n_lone", equal.alias("rank"), equal.alias("lone"), equal.alias("before")))
    stage.drop("nodes", "links")
    settled: list[DataFrame] = []
    for step in range(1, iterations + 1):
        own = F.when(F.col("address") == F.col("dst"), F.col("rank"))
        flows = ranks.join(links, key).groupBy("account", F.col("dst").alias("address")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"), F.max(own).alias("before"), *[F.max(c).alias(c) for c in ("n", "n_lone", "lone")])
        jump = (1 - damping) / F.col("n") + damping * F.col("lone") * F.col("n_lone") / F.col("n")
        ranks = flows.select(*key, "n", "n_lone", (jump + damping * F.col("flow")).alias("rank"), jump.alias("lone"), "before")
        if step % SETTLED_EVERY == 0 and step < iterations:
            ranks = stage.put("ranks", ranks)
            moved = F.sum(F.abs(F.col("rank") - F.col("before")))
            moves = ranks.groupBy("account").agg((moved > F.first("n") * tolerance).alias("moves"))
            counts = {r["moves"]: r["count"] for r in moves.groupBy("moves").count().collect()}
            if counts.get(False):
                settled.append(stage.put(f"settled-{step}", ranks.join(moves.where("NOT moves"), "account").select(*key, "rank")))
                ranks = stage.put("ranks", ranks.join(moves.where("moves"), "account").drop("moves"))
            if not counts.get(True):
                break
    out = reduce(DataFrame.unionByName, settled, ranks.select(*key, "rank")).withColumnRenamed("rank", "centrality")
    out = stage.put("centrality", out)
    stage.drop(*[name for name in stage.paths if name != "centrality"])
    return out


def communities(people: DataFrame, found: DataFrame, rounds: int = 100) -> DataFrame:
    """(account, address, community): greedy modularity by parallel merges; a community is named by a member.

    Each round a community looks for the neighbour whose merger with it raises modularity most (ties by a hash of the two names, so that no chain of equals waits for its end). Of two that chose
    each other the one of higher degree is a head, and whoever chose a head joins it if that pays even after all others who chose it have
    joined; the other one of the two joins in any case. So every merger raises modularity, mergers of a round do not
    interfere, and a community is always connected. The merged graph is the next round's, until no merger pays. Weights are integers
    and so are all comparisons: twice the account's weight, times the weight between, against the product of degrees.
    """
    stage = Stage(people.sparkSession, "communities")
    links = stage.put("links", both_ways(found.select("account", "src", "dst", "weight")).withColumnsRenamed({"src": "a", "dst": "b", "weight": "w"}))
    degrees = links.groupBy("account", "a").agg(F.sum("w").alias("d"))
    totals = degrees.groupBy("account").agg(F.sum("d").alias("t"))
    nodes = stage.put("nodes", degrees.join(totals, "account"))
    member = stage.put("member", people.select("account", "address").distinct().withColumn("community", F.col("address")))
    for _ in range(rounds):
        joined = stage.put("joined", _mergers(links, nodes))
        if joined.isEmpty():
            break
        of = lambda name: joined.select("account", F.col("a").alias(name), F.col("head").alias("new_" + name))
        to = lambda name: F.coalesce("new_" + name, name).alias(name)
        merged = links.join(of("a"), ["account", "a"], "left").join(of("b"), ["account", "b"], "left").select("account", to("a"), to("b"), "w")
        links = stage.put("links", merged.where("a <> b").groupBy("account", "a", "b").agg(F.sum("w").alias("w")))
        nodes = stage.put("nodes", nodes.join(of("a"), ["account", "a"], "left").select("account", to("a"), "d", "t").groupBy("account", "a").agg(F.sum("d").alias("d"), F.first("t").alias("t")))
        member = stage.put("member", member.join(of("community"), ["account", "community"], "left").select("account", "address", to("community")))
    stage.drop("links", "nodes", "joined")
    return member


def _mergers(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(account, a, head): who joins whom in a round."""
    other = nodes.select("account", F.col("a").alias("b"), F.col("d").alias("d_b"))
    gains = links.join(nodes, ["account", "a"]).join(other, ["account", "b"]).withColumn("gain", F.col("t") * F.col("w") - F.col("d") * F.col("d_b")).where("gain > 0")
    tie = F.md5(F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b")).cast("binary"))
    best = gains.groupBy("account", "a").agg(F.min(F.struct((-F.col("gain")).alias("loss"), tie.alias("tie"), "b", "w", "d", "d_b", "t")).alias("m"))
    best = best.select("account", "a", "m.b", "m.w", "m.d", "m.d_b", "m.t")
    back = best.select("account", F.col("a").alias("b"), F.col("b").alias("choice"))
    heads = best.join(back, ["account", "b"]).where("choice = a").where("d > d_b OR (d = d_b AND a < b)")
    heads = heads.select("account", F.col("a").alias("head"), F.col("b").alias("partner"))
    suitors = best.withColumnRenamed("b", "head").join(heads, ["account", "head"])
    sums = suitors.groupBy("account", "head").agg(F.sum("d").alias("all_d"))
    pays = F.col("t") * F.col("w") > F.col("d") * (F.col("d_b") + F.col("all_d") - F.col("d"))
    return suitors.join(sums, ["account", "head"]).where((F.col("a") == F.col("partner")) | pays).select("account", "a", "head")


def modularity(member: DataFrame, found: DataFrame) -> DataFrame:
    """(account, modularity) of communities over the account's edges."""
    of = lambda name: member.select("account", F.col("address").alias(name), F.col("community").alias(name + "_of"))
    rows = found.join(of("src"), ["account", "src"]).join(of("dst"), ["account", "dst"])
    inside = rows.groupBy("account").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("src_of") == F.col("dst_of"), F.col("weight")).otherwise(0)).alias("inside"))
    ends = rows.select("account", F.explode(F.array("src_of", "dst_of")).alias("c"), "weight").groupBy("account", "c").agg(F.sum("weight").alias("d"))
    squares = ends.groupBy("account").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("s"))
    return inside.join(squares, "account").select("account", (F.col("inside") / F.col("m") - F.col("s") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def numbered(member: DataFrame) -> DataFrame:
    """(account, address, community_id): an account's communities numbered by their smallest member, from 0. Only communities, one row each, are ordered."""
    first = member.groupBy("account", "community").agg(F.min("address").alias("first_member"))
    first = first.withColumn("community_id", F.row_number().over(W.partitionBy("account").orderBy("first_member")).cast("long") - 1)
    return member.join(first, ["account", "community"]).select("account", "address", "community_id")


def louvain(people: DataFrame, found: DataFrame) -> DataFrame:
    """(account, address, community_id); a node without edges is a community of its own."""
    return numbered(communities(people, found))


def community_summary(labelled: DataFrame, ranks: DataFrame, top: int = 5) -> DataFrame:
    """Per community its size and its most central members."""
    rows = labelled.join(ranks, ["account", "address"])
    rank = F.row_number().over(W.partitionBy("account", "community_id").orderBy(F.desc("centrality"), "address"))
    return rows.withColumn("rank", rank).groupBy("account", "community_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "address")))).alias("top_members"))
