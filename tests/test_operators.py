"""Rollups against a plain fold, and the other operators on small mailboxes."""

import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import feed, graph, jobs, messages as M, rollups as R, runs, scoring, search
from quillmesh.plans import composites as C
from quillmesh.plans.tools import TOOLS, Archive, build_graph, call, fired, signature
from quillmesh.sources import ndjson, payload, schema
from quillmesh.sources.provider import TableSource

MAIL = "account string, gmail_message_id string, thread_id string, internal_date long, from_addr string, to_addr string, cc_addr string, subject string, labels array<string>, category string, is_list boolean, direction string, unread int, starred int, important int, body_state string, body_text string, summary_text string, summarized_at long, snippet string, own string"


def mail(spark, rows):
    base = {"account": "a", "thread_id": None, "internal_date": None, "from_addr": None, "to_addr": None, "cc_addr": None, "subject": None, "labels": [], "category": None, "is_list": False, "direction": "received", "unread": 0, "starred": 0, "important": 0, "body_state": "meta", "body_text": None, "summary_text": None, "summarized_at": None, "snippet": None, "own": "me@me.org"}
    names = [c.split()[0] for c in MAIL.split(", ")]
    return spark.createDataFrame([tuple({**base, "gmail_message_id": f"m{i:03d}", **r}[n] for n in names) for i, r in enumerate(rows)], MAIL)


def random_mail(seed, n=60):
    rng = random.Random(seed)
    people = ["p1@x.com", "Pat Two <p2@y.co.uk>", "p3@x.com", "me@me.org"]
    out = []
    for _ in range(n):
        sent = rng.random() < 0.4
        out.append({
            "thread_id": rng.choice([None, "", "t1", "t2", "t3", "t4"]), "internal_date": rng.choice([None, *range(0, 50, 5)]), "direction": "sent" if sent else "received", "from_addr": "me@me.org" if sent else rng.choice([*people, None]),
            "to_addr": ", ".join(rng.choices(people, k=rng.randrange(3))) if sent else "me@me.org", "cc_addr": rng.choice([None, rng.choice(people)]), "unread": rng.randrange(2), "subject": rng.choice([None, "s1", "s2"]),
        })
    return out


def fold(rows):
    """The rollup as a plain fold, oldest first."""
    from email.utils import parseaddr

    contacts, threads = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (-1 if x[1]["internal_date"] is None else x[1]["internal_date"], x[0])):
        t = threads.setdefault(r["thread_id"], {"n": 0, "from": set(), "people": set(), "subject": None, "at": -1}) if r["thread_id"] else None
        if t:
            t["n"] += 1
            if r["subject"] and (r["internal_date"] or 0) >= t["at"]:
                t["subject"], t["at"] = r["subject"], r["internal_date"] or 0
        address = lambda v: parseaddr(v or "")[1].lower()
        new = lambda: [0, 0, 0, 0, 0]
        if r["direction"] == "sent":
            if t:
                t["people"].add("me@me.org")
            for raw in [x.strip() for v in (r["to_addr"], r["cc_addr"]) for x in (v or "").split(",") if x.strip()]:
                a = address(raw)
                if a == "me@me.org":
                    continue
                c = contacts.setdefault(a, new())
                c[1] += 1
                if t:
                    t["people"].add(a)
                    c[3] += a in t["from"]
                    c[4] += a not in t["from"] and t["n"] == 1
        elif (a := address(r["from_addr"])) and a != "me@me.org":
            c = contacts.setdefault(a, new())
            c[0] += 1
            c[2] += not r["unread"]
            if t:
                t["people"].add(a)
                t["from"].add(a)
    return contacts, threads


@pytest.mark.parametrize("seed", range(3))
def test_rollups_equal_the_fold(spark, seed):
    rows = random_mail(seed)
    contacts, threads = fold(rows)
    df = mail(spark, rows)
    names = ("msgs_received", "msgs_sent", "read_count", "replied_count", "initiated_count")
    assert {r["address"]: [r[n] for n in names] for r in R.contacts_rollup(df).collect()} == contacts
    got = {r["thread_id"]: (r["msg_count"], r["participants"], r["subject"]) for r in R.threads_rollup(df).collect()}
    assert got == {k: (t["n"], sorted(t["people"]), t["subject"]) for k, t in threads.items()}


def test_cadence_and_domains(spark):
    day = 86_400_000
    df = mail(spark, [{"from_addr": "A <a@mail.brand.com>", "internal_date": 0}, {"from_addr": "b@news.brand.com", "internal_date": 30 * day}, {"from_addr": "a@mail.brand.com", "internal_date": 15 * day}, {"from_addr": "x@other.org", "internal_date": 5}, {"direction": "sent", "from_addr": "me@me.org", "to_addr": "a@mail.brand.com"}])
    rows = {r["domain"]: r for r in R.cadence(df).collect()}
    assert (rows["brand.com"]["msgs"], rows["brand.com"]["senders"], rows["brand.com"]["per_month"]) == (3, 2, 3.0) and rows["other.org"]["per_week"] == 7.0
    assert R.cadence(df, since_ms=20 * day).count() == 1
    domains = R.domains_rollup(R.contacts_rollup(df)).withColumn("category", F.when(F.col("domain") == "mail.brand.com", "travel"))
    assert [(r["domain"], r["msgs"]) for r in R.cadence(df, category="travel", domains=domains).collect()] == [("brand.com", 2)]


def test_scores_order_people(spark):
    now = 86_400_000 * 100
    rows = [{"thread_id": "t", "from_addr": "pal@x.com", "internal_date": now - 10}, {"thread_id": "t", "direction": "sent", "from_addr": "me@me.org", "to_addr": "pal@x.com", "internal_date": now - 5}]
    rows += [{"from_addr": "news@n.com", "category": "promotions", "unread": 1, "internal_date": now} for _ in range(5)]
    df = mail(spark, rows)
    scored = scoring.score_contacts(R.contacts_rollup(df), R.bulk_counts(df), now)
    got = {r["address"]: r for r in scored.collect()}
    assert got["pal@x.com"]["engagement_score"] > 2 and got["news@n.com"]["engagement_score"] < -3 and got["news@n.com"]["bulk_count"] == 5
    assert [r["suggested"] for r in scoring.propose_contacts(scored).orderBy("rank").collect()] == ["important" if got["pal@x.com"]["engagement_score"] >= 2 else "none", "muted"]
    assert scoring.snapshot(scored, now).count() == 2


def test_lattice(spark):
    df = mail(spark, [{"body_state": "full", "body_text": "B", "subject": "old"}, {"body_state": "meta"}])
    new = mail(spark, [{"body_state": "meta", "subject": "new"}, {"body_state": "full", "body_text": "X"}, {"body_state": "meta", "subject": "third"}]).withColumn("batch", F.lit(1))
    got = {r["gmail_message_id"]: (r["body_state"], r["body_text"], r["subject"]) for r in M.upsert(df, new).collect()}
    assert got == {"m000": ("full", "B", "new"), "m001": ("full", "X", None), "m002": ("meta", None, "third")}


def test_a_saved_summary_survives_syncs(spark):
    """A demoted message whose summary was saved comes again as metadata, then with a full body: state and summary stay, headers follow."""
    held = mail(spark, [{"body_state": "summary-only", "summary_text": "a summary", "summarized_at": 5, "subject": "old"}, {"body_state": "full", "body_text": "B"}])
    plain = mail(spark, [{"subject": "new"}, {}]).withColumn("batch", F.lit(1))
    bodies = mail(spark, [{"body_state": "full", "body_text": "again", "subject": "newer"}, {"summary_text": "late", "summarized_at": 9}]).withColumn("batch", F.lit(2))
    for batches in (plain, plain.drop("summary_text", "summarized_at"), plain.unionByName(bodies)):
        row = M.upsert(held, batches).where("gmail_message_id = 'm000'").first()
        assert (row["body_state"], row["body_text"], row["summary_text"], row["summarized_at"]) == ("summary-only", None, "a summary", 5)
    both = {r["gmail_message_id"]: (r["subject"], r["body_text"], r["summary_text"], r["summarized_at"]) for r in M.upsert(M.upsert(held, plain), bodies).collect()}
    assert both == {"m000": ("newer", None, "a summary", 5), "m001": (None, "B", "late", 9)}


def test_edits_of_one_message_are_folded(spark):
    df = mail(spark, [{"labels": ["INBOX", "X"]}, {"labels": ["INBOX"]}])
    rows = [("a", "m000", ["STARRED", "Y"], ["X"], 1), ("a", "m000", None, ["STARRED"], 2), ("a", "m000", ["Z"], None, 2), ("a", "m000", ["Z"], None, 2), ("a", "m009", ["Q"], None, 1)]
    edits = spark.createDataFrame(rows, "account string, gmail_message_id string, add array<string>, remove array<string>, seq int")
    got = {r["gmail_message_id"]: (sorted(r["labels"]), r["starred"]) for r in M.edit_labels(df, edits).collect()}
    assert got == {"m000": (["INBOX", "Y", "Z"], 0), "m001": (["INBOX"], 0)} and M.edit_labels(df, edits).count() == 2


def test_labels_and_reconcile(spark):
    df = mail(spark, [{"labels": ["INBOX", "UNREAD"]}, {"labels": ["INBOX"]}, {"labels": []}])
    live = spark.createDataFrame([("a", "m000"), ("a", "m002"), ("a", "m999")], "account string, gmail_message_id string")
    changes = M.reconcile(df, live)
    assert {(r["gmail_message_id"], r["change"]) for r in changes.collect()} == {("m001", "archived"), ("m002", "restored"), ("m999", "added")}
    after = {r["gmail_message_id"]: (r["labels"], r["category"], r["unread"]) for r in M.apply_reconcile(df, changes).collect()}
    assert after == {"m000": (["INBOX", "UNREAD"], "primary", 1), "m001": ([], None, 0), "m002": (["INBOX"], "primary", 0)}


def test_demotion_and_eviction(spark):
    base = {"body_state": "full", "body_text": "x", "summary_text": "s", "summarized_at": 5, "internal_date": 5}
    rows = [{**base, "category": "promotions", "from_addr": "n@n.com"}, {**base, "category": "promotions", "from_addr": "vip@v.com"}, {**base, "from_addr": "d@d.com"}, {**base, "is_list": True, "from_addr": "l@l.com", "thread_id": "t"}, {"direction": "sent", "thread_id": "t", "from_addr": "me@me.org"}, {**base, "category": "social", "from_addr": "x@sub.imp.com", "summary_text": None}]
    df = mail(spark, rows)
    contacts = spark.createDataFrame([("a", "vip@v.com", "important")], "account string, address string, curation string")
    domains = spark.createDataFrame([("a", "imp.com", "important")], "account string, domain string, curation string")
    chosen = M.demotable(df, contacts, domains, 10)
    assert [r["gmail_message_id"] for r in chosen.collect()] == ["m000"]
    assert M.demote(df, chosen).where("body_state = 'summary-only' AND body_text IS NULL").count() == 1
    old = M.evictable(df, contacts, domains, 10)
    assert sorted(r["gmail_message_id"] for r in old.collect()) == ["m000", "m002", "m005"]
    assert {r["gmail_message_id"]: r["body_state"] for r in M.evict(df, old).collect() if r["gmail_message_id"] in ("m000", "m005")} == {"m000": "summary-only", "m005": "meta"}


def plain_pagerank(people, tolerance, steps, damping=0.85):
    """Dense matrices, account by account."""
    out = {}
    for account in {a for a, _, _ in people}:
        names = sorted({p for a, _, p in people if a == account})
        threads = {t: {p for a, x, p in people if (a, x) == (account, t)} for t in {t for a, t, _ in people if a == account}}
        weight = np.array([[sum(x != y and x in m and y in m for m in threads.values()) for y in names] for x in names], float)
        total, n = weight.sum(1), len(names)
        share = weight / np.where(total > 0, total, 1)[:, None]
        ranks = np.full(n, 1 / n)
        for step in range(1, steps + 1):
            new = (1 - damping) / n + damping * (ranks @ share + ranks[total == 0].sum() / n)
            moved, ranks = np.abs(new - ranks).sum(), new
            if step % graph.SETTLED_EVERY == 0 and moved <= n * tolerance:
                break
        out |= {(account, name): r for name, r in zip(names, ranks.tolist())}
    return out


def test_graph_two_circles(spark):
    pairs = [("t1", ["hub", "a"]), ("t2", ["hub", "b"]), ("t3", ["hub", "c"]), ("t4", ["x", "y", "z"])]
    people = spark.createDataFrame([("a", t, p) for t, ps in pairs for p in ps], "account string, thread_id string, address string")
    found = graph.edges(people)
    assert found.count() == 6
    ranks = {r["address"]: r["centrality"] for r in graph.pagerank(people, found).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "hub"
    two = people.unionByName(spark.createDataFrame([("b", "t", "p"), ("b", "t", "q"), ("a", "t5", "alone"), ("a", "t6", "apart"), ("c", "t", "solo")], people.schema))  # b settles at once, a does not
    for tolerance, steps in ((0.0, 7), (1e-3, 15), (1e-6, 100)):
        got = graph.pagerank(two, graph.edges(two), tolerance=tolerance, iterations=steps).collect()
        wanted = plain_pagerank([tuple(r) for r in two.collect()], tolerance, steps)
        assert len(got) == len(wanted) and all(abs(wanted[r["account"], r["address"]] - r["centrality"]) < 1e-12 for r in got)
    assert graph.pagerank(people.limit(0), found.limit(0)).count() == 0
    labels = {r["address"]: r["community_id"] for r in graph.louvain(people, found).collect()}
    assert len(set(labels.values())) == 2 and labels["hub"] == labels["a"] == labels["b"] == labels["c"] and labels["x"] == labels["y"] == labels["z"]
    assert [(r["neighbour"], r["rank"]) for r in graph.neighbours(found).where("address = 'x'").orderBy("rank").collect()] == [("y", 1), ("z", 2)]
    assert sorted(map(str, graph.neighbours_of(people, "x").select("neighbour", "shared_threads", "rank").collect())) == sorted(map(str, graph.neighbours(found).where("address = 'x'").select("neighbour", "shared_threads", "rank").collect()))
    lonely = people.where("thread_id = 't9'").unionByName(spark.createDataFrame([("b", "t", "solo")], people.schema))
    assert graph.louvain(lonely, graph.edges(lonely)).count() == 1


def plain_mergers(links):
    """graph.communities for one account, with dictionaries."""
    import hashlib

    member, degree, weight = {}, {}, {}
    for a, b, w in links:
        for x, y in ((a, b), (b, a)):
            member[x], degree[x], weight[x, y] = x, degree.get(x, 0) + w, weight.get((x, y), 0) + w
    total = sum(degree.values())
    while True:
        choice = {}
        for (a, b), w in weight.items():
            gain = total * w - degree[a] * degree[b]
            if gain > 0:
                key = (-gain, hashlib.md5(f"{min(a, b)}:{max(a, b)}".encode()).hexdigest(), b)
                choice[a] = min(choice.get(a, key), key)
        chosen = {a: k[2] for a, k in choice.items()}
        heads = {a: b for a, b in chosen.items() if chosen[b] == a and (degree[a] > degree[b] or (degree[a] == degree[b] and a < b))} if chosen else {}
        if not heads:
            return member
        suitors = {h: [a for a, b in chosen.items() if b == h] for h in heads}
        joins = {a: h for h, l in suitors.items() for a in l if a == heads[h] or total * weight[a, h] > degree[a] * (degree[h] + sum(degree[x] for x in l) - degree[a])}
        to = lambda x: joins.get(x, x)  # noqa: E731, B023
        merged, sums = {}, {}
        for (a, b), w in weight.items():
            if to(a) != to(b):
                merged[to(a), to(b)] = merged.get((to(a), to(b)), 0) + w
        for x, d in degree.items():
            sums[to(x)] = sums.get(to(x), 0) + d
        member, degree, weight = {x: to(c) for x, c in member.items()}, sums, merged


def test_communities_against_plain_mergers(spark):
    rng = random.Random(3)
    groups = {"blocks": [(f"n{i:02d}", f"n{j:02d}", rng.randrange(1, 4)) for i in range(40) for j in range(i) if rng.random() < (0.5 if i % 4 == j % 4 else 0.03)]}
    groups["path"] = [(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(60)]
    groups["star"] = [("hub", f"n{i:03d}", 1) for i in range(50)]
    found = spark.createDataFrame([(g, min(a, b), max(a, b), w) for g, l in groups.items() for a, b, w in l], "account string, src string, dst string, weight long")
    people = found.select("account", F.col("src").alias("address")).union(found.select("account", "dst")).union(spark.createDataFrame([("none", "solo")], "account string, address string"))
    member = graph.communities(people, found)
    got = {(r["account"], r["address"]): r["community"] for r in member.collect()}
    assert got == {("none", "solo"): "solo"} | {(g, x): c for g, l in groups.items() for x, c in plain_mergers(l).items()}
    score = {r["account"]: r["modularity"] for r in graph.modularity(member, found).collect()}
    assert score["blocks"] > 0.55 and score["path"] > 0.7 and abs(score["star"]) < 1e-9
    for (g, _), c in got.items():  # every community is connected
        inside, seen = {x for (h, x), d in got.items() if h == g and d == c}, set()
        todo = [next(iter(inside))]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b, _ in groups.get(g, []) if x in (a, b) and {a, b} <= inside]
        assert seen == inside


def test_pairs_of_a_hot_thread_are_tiled(spark):
    people = spark.createDataFrame([("a", "hot", f"p{i:03d}") for i in range(300)] + [("a", "t", f"p{i:03d}") for i in range(5)] + [("b", "hot", "q"), ("b", "hot", "r")], "account string, thread_id string, address string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(graph.edges(people, tile=16)) == plain(graph.edges(people)) and graph.edges(people).count() == 300 * 299 // 2 + 1
    large = spark.range(20_000).select(F.lit("a").alias("account"), F.lit("t").alias("thread_id"), F.concat(F.lit("p"), "id").alias("address"))
    tiles = graph.tiled(large).groupBy("row", "col").agg(F.count_if(F.expr("block = row")).alias("n"), F.count_if(F.expr("block = col")).alias("m"))
    most = tiles.agg(F.count("*"), F.max(F.col("n") * F.col("m"))).first()
    assert most[0] == 79 * 80 // 2 and most[1] < 2 * graph.TILE**2


def test_search_equals_sqlite(spark):
    rng = random.Random(2)
    words = ["refund", "refunds", "invoice", "travel", "cat", "dog", "running", "runs", "bank"]
    docs = [{c: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for c in search.WEIGHTS} for _ in range(30)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(subject, sender, recipients, body, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, subject, sender, recipients, body) VALUES (?, ?, ?, ?, ?)", [(i, *d.values()) for i, d in enumerate(docs)])
    df = spark.createDataFrame([(i, *d.values()) for i, d in enumerate(docs)], "docid long, subject string, sender string, recipients string, body string")
    index = search.SearchIndex(df)
    for terms in (["refunds"], ["run"], ["cat dog"], ["bank", "travels"]):
        wanted = dict(db.execute("SELECT rowid, bm25(f, 10, 8, 4, 1) FROM f WHERE f MATCH ?", [search.build_match(terms)]).fetchall())
        got = {r["docid"]: r["score"] for r in index.search(terms).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_one_tokeniser_for_texts_and_queries(spark):
    """A composed and a decomposed word find each other; marks between letters do not split a word; keywords are stemmed phrases."""
    texts = ["un r\u00e9sum\u00e9 court", "un re\u0301sume\u0301 long", "resume", "Refunds for you", "for the refund", "re funds"]
    df = mail(spark, [{"subject": t, "internal_date": 9, "direction": "sent" if i == 4 else "received"} for i, t in enumerate(texts)])
    names = lambda rows: [r[0][-1] for r in sorted(rows.select("gmail_message_id").collect())]
    for query in ("r\u00e9sum\u00e9", "re\u0301sume\u0301", "RESUME"):
        assert names(search.with_phrases(df, [query])) == ["0", "1", "2"] == names(search.with_phrases(df, [query], prefix=True))
    assert names(C.catch_up_keywords(df, ["refund"], 0)) == ["3", "4"]
    assert names(C.catch_up_keywords(df, ["the refunds", "refunding for"], 0)) == ["3", "4"]
    assert names(C.catch_up_keywords(df, ["for refund", "\u0301", " "], 0)) == [] == names(C.catch_up_keywords(df, [], 0))


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "hoping": "hope", "generalizations": "gener", "sky": "sky", "happy": "happi", "electricity": "electr", "adjustable": "adjust"}
    assert {w: search.porter(w) for w in pairs} == pairs
    assert search.expand_query(["invoice", "receipt"]) == ["invoice", "receipt", "bill"]
    assert search.build_match(["deposit", " ", 'a"b']) == '"deposit"* OR "a""b"*'


def test_feed(spark):
    timed = feed.message_changes(mail(spark, [{"internal_date": 9 * 10**9}, {"internal_date": 5}, {}, {"internal_date": 7}]))
    order = feed.append(timed.limit(0).withColumn("sequence", F.lit(0).cast("long")), timed)
    assert [r["entity_key"] for r in order.orderBy("sequence").collect()] == ["m002", "m001", "m003", "m000"]
    events = feed.message_changes(mail(spark, [{"from_addr": "x@y.z"}, {"from_addr": "q@y.z"}]))
    empty = events.limit(0).withColumn("sequence", F.lit(0).cast("long"))
    one = feed.append(empty, events)
    two = feed.append(one, events)
    assert one.count() == two.count() == 2 and sorted(r["sequence"] for r in two.collect()) == [1, 2]
    first = feed.read_page(two, limit=1)
    assert first["has_more"] and len(feed.read_page(two, first["cursor"])["events"]) == 1 and not feed.read_page(two, accounts=["zz"])["events"]
    with pytest.raises(Exception, match="tombstone"):
        feed.append(one, events.withColumn("operation", F.lit("delete")).withColumn("dedupe_key", F.lit(None).cast("string"))).collect()


def test_ndjson_round_trip(spark, tmp_path):
    df = mail(spark, [{"from_addr": "x@y.z", "labels": ["INBOX"], "internal_date": 7}, {"account": "b", "internal_date": 9}])
    ndjson.export({"messages": df}, f"{tmp_path}/all")
    back = ndjson.import_rows(spark, f"{tmp_path}/all", {"messages": df.schema})["messages"]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert ndjson.export_lines({"messages": df}, "b").count() == 1
    held = mail(spark, [{"body_state": "full", "body_text": "B", "subject": "old"}])
    labels = spark.createDataFrame([("a", "1", "One"), ("a", "2", "Two")], "account string, id string, name string")
    tables = ndjson.merged({"messages": held, "labels": labels}, {"messages": df, "labels": labels.where("id = '2'").withColumn("name", F.lit("New")), "sync_runs": labels.limit(0)})
    twice = ndjson.merged(tables, {"messages": df})
    assert {(r["account"], r["gmail_message_id"], r["body_state"], r["subject"]) for r in twice["messages"].collect()} == {("a", "m000", "full", None), ("b", "m001", "meta", None)}
    assert {(r["id"], r["name"]) for r in tables["labels"].collect()} == {("1", "One"), ("2", "New")} and tables["sync_runs"].count() == 0
    runs = spark.createDataFrame([("a", 1, "failed"), ("c", None, None)], "account string, finished_at long, error string")
    dated = df.unionByName(mail(spark, [{"account": "c", "internal_date": 4}, {"account": "d"}, {"account": "e", "internal_date": 0}]))
    assert sorted((r["account"], r["finished_at"]) for r in ndjson.watermarks(dated, runs).collect()) == [("b", 9), ("c", 4)]
    with pytest.raises(ValueError):
        ndjson.export_lines({"secrets": df})


def test_ndjson_stream_of_one_file(spark, tmp_path):
    """The header comes first, blank lines are skipped, and the last of repeated rows wins, however the file is split."""
    row = lambda i, name: json.dumps({"type": "labels", "row": {"account": "a", "id": str(i % 50), "name": name}})
    lines = [json.dumps({"type": "header", "schema_version": ndjson.SCHEMA_VERSION}), ""] + [row(i, f"n{i}") for i in range(2000)]
    (tmp_path / "all.ndjson").write_text("\n".join(lines) + "\n")
    schema = {"labels": "account string, id string, name string"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = ndjson.import_rows(spark, f"{tmp_path}/all.ndjson", schema)["labels"]
        assert {(r["id"], r["name"]) for r in got.collect()} == {(str(i % 50), f"n{i}") for i in range(1950, 2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bad in (lines[2:], [lines[0].replace(str(ndjson.SCHEMA_VERSION), "1")], [lines[0], '{"type": "secrets", "row": {}}'], []):
        (tmp_path / "bad.ndjson").write_text("\n".join(bad))
        with pytest.raises(ValueError):
            ndjson.import_rows(spark, f"{tmp_path}/bad.ndjson", schema)


def test_payloads(spark):
    line = '{"id":"i1","threadId":"t","labelIds":["INBOX","UNREAD"],"internalDate":"12","snippet":"s","payload":{"mimeType":"multipart/mixed","headers":[{"name":"FROM","value":"A <a@b.c>"},{"name":"List-Id","value":"x"}],"parts":[{"mimeType":"multipart/alternative","parts":[{"mimeType":"text/plain","body":{"data":"aMOpbGxv"}},{"mimeType":"text/html","body":{"data":"PGI-"}}]},{"mimeType":"application/pdf","filename":"f.pdf","body":{"attachmentId":"att","size":10}},{"mimeType":"image/png","filename":"i.png","body":{"data":"AA"}}]}}'
    parsed = payload.parse(spark.createDataFrame([(line,)], "value string"))
    row = payload.metadata(parsed, "acc", ["me@x.y"]).first()
    assert (row["from_addr"], row["is_list"], row["category"], row["unread"], row["direction"], row["internal_date"]) == ("A <a@b.c>", True, "primary", 1, "received", 12)
    assert payload.bodies(parsed).first().asDict() == {"id": "i1", "text": "héllo", "html": "<b>"}
    assert {(r["attachment_id"], r["filename"]) for r in payload.attachments(parsed).collect()} == {("att", "f.pdf"), ("inline:2", "i.png")}
    assert [r["status"] for r in payload.storable(parsed, "acc").collect()] == []  # a list's mail


def test_bytes_of_folded_and_broken_base64(spark):
    rows = [("aMOpbGxv", "héllo".encode()), ("aM\r\nOp bGxv", "héllo".encode()), ("_-8=", b"\xff\xef"), ("_-8", b"\xff\xef"), ("aGkAA", b"hi\0"), ("a", b""), ("", None), (None, None)]
    got = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(rows)], "i int, d string").select("i", payload.binary(F.col("d")).alias("b")).collect()
    assert {r["i"]: None if r["b"] is None else bytes(r["b"]) for r in got} == {i: b for i, (_, b) in enumerate(rows)}


def test_payload_trees_of_any_depth(spark):
    leaf = {"mimeType": "text/plain", "body": {"data": "aMOpbGxv"}}
    files = [{"mimeType": "application/x-dosexec", "filename": "a.exe", "body": {"attachmentId": "e", "size": 3}}, {"mimeType": " ", "filename": "Füße (1).txt", "body": {"data": "aGk"}}, {"mimeType": "text/plain", "filename": "f", "body": {"attachmentId": "big", "size": 26 * 1024 * 1024}}, {"filename": "none", "body": {}}, {"mimeType": "text/plain", "filename": "apart", "body": {"attachmentId": "p", "size": 2}}]
    tree = {"mimeType": "multipart/mixed", "parts": [leaf, *files]}
    for _ in range(40):
        tree = {"mimeType": "multipart/mixed", "headers": [{"name": "X", "value": "y"}], "parts": [tree]}
    lines = [json.dumps({"id": "deep", "labelIds": ["INBOX"], "payload": tree}), json.dumps({"id": "auto", "payload": {**tree, "headers": [{"name": "Auto-Submitted", "value": "yes"}]}}), json.dumps({"id": "junk", "labelIds": ["spam"], "payload": tree}), json.dumps({"id": "bare"})]
    parsed = payload.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["id"]: r["text"] for r in payload.bodies(parsed).collect()} == {"deep": "héllo", "auto": "héllo", "junk": "héllo", "bare": None}
    stored = {r["filename"]: r for r in payload.storable(parsed, "a b", spark.createDataFrame([("deep", "p", "aGk=")], "id string, attachment_id string, data string")).collect()}
    assert {k: r["status"] for k, r in stored.items()} == {"a.exe": "rejected_by_policy", "Füße (1).txt": "stored", "f": "rejected_by_policy", "apart": "stored"}
    one = stored["Füße (1).txt"]
    assert (bytes(one["content"]), one["stored_name"], one["attachment_id"], one["mime_type"]) == (b"hi", "F__e__1_.txt", "inline:" + "0." * 40 + "2", "application/octet-stream")
    assert stored["apart"]["storage_key"] == "crm/a%20b/deep/p-apart"
    events = payload.attachment_events(payload.storable(parsed, "a b"), "a b").collect()
    assert sorted(json.loads(r["payload"])["importStatus"] for r in events) == ["rejected_by_policy", "rejected_by_policy", "stored"]
    assert {r["dedupe_key"] for r in events} >= {"attachment:a b:deep:e:rejected"}


def test_triggers(spark):
    df = mail(spark, [{"from_addr": "Ann <ann@x.com>", "category": "updates", "labels": ["L"], "subject": "Refund due"}, {"from_addr": "bob@y.com", "category": "updates", "labels": ["L"]}])
    contacts = spark.createDataFrame([("a", "ann@x.com", 1, "important")], "account string, address string, msgs_sent int, curation string")
    domains = spark.createDataFrame([], "account string, domain string, curation string")
    rule = [("category", "updates"), ("is_list", False), ("correspondent", True), ("interest_profile", "important"), ("label", "L"), ("from_addr", "ANN@x.com"), ("from_domain", "x.com"), ("subject_fts", ["refund"])]
    assert [r["gmail_message_id"] for r in M.matching(df, contacts, domains, rule).collect()] == ["m000"]
    assert M.matching(df, contacts, domains, [("from_addr", "ann@x.com")], strict=True).count() == 0


def test_tools(spark):
    day = 86_400_000
    rows = [
        {"thread_id": "t1", "from_addr": "Pal <pal@x.com>", "internal_date": 10 * day, "subject": "refund now", "labels": ["INBOX"], "snippet": "hi"},
        {"thread_id": "t1", "direction": "sent", "from_addr": "me@me.org", "to_addr": "pal@x.com, kim@x.com", "internal_date": 11 * day, "labels": ["SENT"]},
        {"thread_id": "t1", "from_addr": "pal@x.com", "internal_date": 12 * day, "labels": ["INBOX"]},
        {"from_addr": "news@n.com", "category": "promotions", "is_list": True, "unread": 1, "internal_date": 12 * day},
    ]
    a = Archive(spark, mail(spark, rows), {"a": ["me@me.org"]}, 13 * day)
    assert len(TOOLS) == 35
    assert [r["ref"] for r in call(a, "search", query="refunds")["result"].collect()] == ["a:m000"]
    assert call(a, "list_labeled", label="INBOX")["result"].count() == 2
    assert call(a, "get_contact", address="pal@x.com")["result"]["contact"]["replied_count"] == 1
    assert call(a, "get_contact", address="zz")["result"]["contact"] is None
    assert call(a, "interest_set", account="a", contacts={"pal@x.com": "important", "unknown@q": "muted"}, keywords=["refund"])["result"] == {"contacts": {"pal@x.com": "important"}, "domains": {}, "keywords": ["refund"]}
    feeds = call(a, "catch_up", account="a", since="5d")["result"]
    assert feeds["from_important"].count() == 2 and feeds["user_threads"].count() == 2 and feeds["keywords"].count() == 1
    assert [(r["address"], r["issues"]) for r in call(a, "digest_sources", account="a", since="30d")["result"].collect()] == [("news@n.com", 1)]
    assert call(a, "archive_message", ref="a:m000")["result"]["labels"] == []
    assert call(a, "graph_neighbors", address="pal@x.com")["result"]["fallback"] is False
    assert call(a, "graph_communities")["result"].count() == 1
    with_graph = {r["address"]: r for r in build_graph(a).contacts().collect()}
    assert with_graph["pal@x.com"]["centrality"] > 0 and with_graph["pal@x.com"]["community_id"] == with_graph["kim@x.com"]["community_id"] and with_graph["news@n.com"]["centrality"] is None
    assert call(a, "list_contacts", sort="community")["result"].count() == 3
    call(a, "trigger_rule_save", rule_id="r", account="a", conditions=[("from_domain", "n.com")])
    assert fired(a, a.messages.select("account", "gmail_message_id"))["r"].count() == 1
    assert call(a, "settings_set", account="a", body_window_months=3)["result"]["body_window_months"] == 3
    assert call(a, "settings_set", account="a", retention="off", backfill_cursor="2020-01-01")["result"] == {"body_window_months": 3, "retention": "off", "onboarding_completed_at": None, "backfill_cursor": "2020-01-01", "backfill_done": False}
    walk = [call(a, "onboarding", account="a")["result"]["step"]]
    for step, answer in (("accounts", "yes"), ("retention", 6), ("interests", "skip"), ("backfill", "now")):
        walk.append(call(a, "onboarding", account="a", step=step, answer=answer)["result"]["step"])
    assert walk == ["accounts", "retention", "interests", "backfill", "done"] and call(a, "onboarding", account="a")["result"]["step"] == "done"
    assert (a.settings["a"]["body_window_months"], a.settings["a"]["retention"]) == (6, "window")
    with pytest.raises(ValueError):
        call(a, "onboarding", account="a", step="curate")
    for bad in ([], [("category", "spam")], [("is_list", "yes")], [("subject_fts", [" "])], [("label", " ")], [("size", 3)]):
        with pytest.raises(ValueError):
            call(a, "trigger_rule_save", rule_id="x", account="a", conditions=bad)
    assert call(a, "webhook_consumer_register", consumer_id="c", url="https://h/x", secret="k")["result"] == {"id": "c", "url": "https://h/x", "signed": True}
    assert signature("key", "The quick brown fox jumps over the lazy dog") == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    counts = call(a, "relay_menu_status")["result"]
    assert (counts["messages"], counts["any_syncing"]) == (4, False)
    assert call(a, "list_threads", contact="kim@x.com")["result"].count() == 1
    with pytest.raises(ValueError):
        call(a, "save_summary", ref="a:m000", text=" ")
    with pytest.raises(KeyError):
        call(a, "get_message", ref="a:none")


def test_profile_backlog(spark):
    df = mail(spark, [{"from_addr": "v@v.com"}, {"from_addr": "k@k.com", "subject": "big refund"}, {"from_addr": "m@m.com", "subject": "refund"}, {"from_addr": "o@o.com"}])
    contacts = spark.createDataFrame([("a", "v@v.com", "important"), ("a", "m@m.com", "muted")], "account string, address string, curation string")
    domains = spark.createDataFrame([], "account string, domain string, curation string")
    assert sorted(r["gmail_message_id"] for r in C.profile_backlog(df, contacts, domains, ["refund"]).collect()) == ["m000", "m001"]


def test_backlog_selectors(spark):
    rows = [{"from_addr": "A <a@x.com>", "internal_date": 30, "subject": "Refunds (due"}, {"from_addr": "l@l.com", "is_list": True, "internal_date": 20, "snippet": "a refund"}, {"from_addr": "p@p.com", "category": "promotions", "internal_date": 40}, {"from_addr": "a@x.com", "body_state": "full", "internal_date": 50}, {"from_addr": "a@x.com"}]
    df = mail(spark, rows)
    pick = lambda **by: [r["gmail_message_id"] for r in M.select_backlog(df, **by).orderBy("rank").collect()]
    assert pick() == ["m000", "m004"] and pick(rule="all") == ["m002", "m000", "m001", "m004"]
    assert pick(rule="all", limit=1) == ["m002"] and pick(sender="L@L.com") == ["m001"] and pick(sender="l@l.com", rule="direct") == []
    assert pick(match=["refund"]) == ["m000", "m001"] and pick(match=["(due"], rule="all") == ["m000"] and pick(rule="all", since_ms=30) == ["m002", "m000"]
    assert C.enrich_batch(df, 10, 1).count() == 1


def test_runs_and_identity(spark):
    hour = 3_600_000
    empty = spark.createDataFrame([], "id long, account string, phase string, selector string, started_at long, finished_at long, error string, fetched long, indexed long")
    table, first = runs.acquire(empty, "a", "sync", 100 * hour)
    with pytest.raises(runs.RunError):
        runs.acquire(table, "a", "sync", 101 * hour)
    assert [(r["account"], r["id"]) for r in runs.active_runs(table, 101 * hour).collect()] == [("a", 1)] and runs.active_runs(table, 101 * hour, first).isEmpty()
    table, second = runs.acquire(table, "a", "sync", 107 * hour)  # the first one has gone stale
    closed = runs.finish(table, second, 108 * hour, 5, 4, "broken")
    assert runs.active_runs(closed, 108 * hour).isEmpty() and closed.where("error = 'broken' AND fetched = 5").count() == 1
    known = runs.guard_identity({}, "a", "Me@x.com", "one")
    assert runs.guard_identity(known, "a", "me@X.com", "two") == {"a": ("Me@x.com", "two")}
    with pytest.raises(runs.RunError):
        runs.guard_identity(known, "a", "you@x.com", "one")
    jobs = spark.createDataFrame([("a", "sync", "done", 5), ("a", "graph", "queued", 9), ("a", "sync", "running", 7)], "account string, kind string, status string, created_at long")
    assert [tuple(r) for r in runs.queue_status(jobs).collect()] == [("a", 2, 7)]


def test_table_source(spark):
    day = 86_400_000
    df = mail(spark, [{"from_addr": "p@x.com", "labels": ["INBOX"], "internal_date": 5 * day}, {"from_addr": "me@me.org", "labels": ["SENT"], "internal_date": 6 * day}, {"from_addr": "Q <q@x.com>", "labels": [], "internal_date": 7 * day}])
    source = TableSource(df, "me@me.org", 8 * day)
    ids = lambda **by: [r["gmail_message_id"] for r in source.list_ids(**by).collect()]
    assert ids() == ["m002", "m001", "m000"] and ids(limit=1) == ["m002"] and ids(include_sent=False) == ["m002", "m000"]
    assert ids(query="in:inbox") == ["m000"] and ids(since="2d", until="1970-01-08") == ["m001"] and ids(query="from:{q@x.com p@x.com}") == ["m002", "m000"]
    wanted = spark.createDataFrame([("m002", 0), ("zz", 1), ("m000", 2)], "gmail_message_id string, position int")
    assert [r["gmail_message_id"] for r in source.metadata(wanted).collect()] == ["m002", "m000"] and "body_text" not in source.metadata(wanted).columns
    assert source.full("m001")["from_addr"] == "me@me.org" and source.full("zz") is None and source.check()["ok"]
    catalogue = spark.createDataFrame([("a", "L1", "One", "user"), ("b", "L2", "Two", "user")], "account string, id string, name string, type string")
    listed = spark.createDataFrame([("L3", "Three", "user")], "id string, name string, type string")
    assert sorted(r["id"] for r in runs.replace_labels(catalogue, "a", listed).collect()) == ["L2", "L3"]
    assert runs.replace_labels(catalogue, "a", listed.limit(0)).count() == 2


def test_backfill_slices_and_sweeps(spark):
    df = mail(spark, [{"from_addr": "pal@x.com", "internal_date": 5}, {"from_addr": "bulk@x.com", "internal_date": 5}, {"direction": "sent", "from_addr": "me@me.org", "internal_date": 6}, {"from_addr": "pal@x.com", "internal_date": 10}])
    contacts = spark.createDataFrame([("a", f"p{i:02d}@x.com", 50 - i, 0) for i in range(30)] + [("a", "pal@x.com", 99, 1), ("a", "bulk@x.com", 0, 0)], "account string, address string, msgs_sent int, replied_count int")
    assert sorted(r["gmail_message_id"] for r in C.backfill_slice(df, contacts, 0, 10).collect()) == ["m000", "m002"]
    queries = [r["query"] for r in C.correspondent_queries(contacts).orderBy("chunk").collect()]
    assert queries[0].startswith("from:{pal@x.com p00@x.com ") and len(queries) == 2 and queries[1].count("@") == 6
    none = spark.createDataFrame([], "account string, address string, curation string")
    old = mail(spark, [{"body_state": "full", "body_text": "x", "internal_date": i, "from_addr": "z@z.com"} for i in range(3)])
    assert [r["gmail_message_id"] for r in C.retention_batch(old, none, none.withColumnRenamed("address", "domain"), 9, 2).orderBy("rank").collect()] == ["m000", "m001"]


def job_table(spark, rows):
    names = [f.split()[0] for f in jobs.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"params": "{}", "terminal": False, **r}.get(c) for c in names) for r in rows], jobs.SCHEMA)


def test_jobs(spark):
    minute = 60_000
    now = 100 * minute
    table = job_table(
        spark,
        [
            {"id": "1", "kind": "sync", "account": "a", "status": "running", "created_at": 20 * minute, "started_at": now - 15 * minute},  # at its lease's end, not beyond
            {"id": "2", "kind": "sync", "account": "b", "status": "running", "created_at": 20 * minute, "started_at": now - 15 * minute - 1},
            {"id": "3", "kind": "graph", "account": "a", "status": "queued", "created_at": now - 20 * minute},  # older than the other lease
            {"id": "4", "kind": "graph", "account": "b", "status": "queued", "created_at": now - 50 * minute - 1},
            {"id": "5", "kind": "sync", "account": "c", "status": "done", "created_at": 1, "terminal": True},
            {"id": "6", "kind": "sync", "account": "a", "status": "queued", "created_at": now - minute},
            {"id": "7", "kind": "sync", "account": "z", "status": None, "created_at": None},
        ],
    )
    closed = {r["id"]: (r["status"], r["error"]) for r in jobs.expired(table, now).collect()}
    assert closed["2"] == ("failed", jobs.RUNNING_EXPIRED) and closed["4"] == ("failed", jobs.QUEUED_EXPIRED)
    assert [closed[k][0] for k in "13567"] == ["running", "queued", "done", "queued", None]
    asked = spark.createDataFrame([("sync", "a", "x"), ("sync", "b", "y"), ("sync", "b", "x"), ("sync", "c", "x")], "kind string, account string, params string")
    after, answers = jobs.enqueue(table, asked, now)
    found = {r["account"]: (r["id"], r["is_new"]) for r in answers.collect()}
    assert found["a"] == ("6", False) and found["b"][1] and found["c"][1] and len({x for x, _ in found.values()}) == 3
    rows = {r["id"]: r for r in after.collect()}
    assert len(rows) == 9 and rows["2"]["status"] == "failed" and rows["2"]["finished_at"] == now and rows["4"]["status"] == "queued"  # a kind that was not asked for
    assert (rows[found["b"][0]]["status"], rows[found["b"][0]]["params"]) == ("queued", "x")
    again, same = jobs.enqueue(after, asked, now + 1)
    assert again.count() == 9 and {r["account"]: r["id"] for r in same.collect()} == {k: v for k, (v, _) in found.items()}
    assert {r["id"] for r in jobs.started(table, now, 2).where("status = 'running'").collect()} == {"1", "2", "3", "4"}  # both slots of syncs are taken
    assert {r["id"] for r in jobs.started(table, now, 1).where("status = 'running' AND kind = 'graph'").collect()} == {"4"}
    report = spark.createDataFrame([("1", None), ("3", "broken"), ("5", "late")], "id string, error string")
    ended = {r["id"]: (r["status"], r["error"], r["terminal"]) for r in jobs.finished(table, report, now).collect()}
    assert (ended["1"], ended["3"], ended["5"]) == (("done", None, True), ("failed", "broken", True), ("done", None, True))
    runs_ = spark.createDataFrame([("a", 50, None, "sync"), ("a", 90, "broken", "sync"), ("b", 5, None, "sync"), ("a", 95, None, "enrich")], "account string, finished_at long, error string, phase string")
    accounts = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "invalid_grant")], "account string, auth_error string")
    assert {r["account"]: r["since"] for r in jobs.due_syncs(accounts, runs_, 10).collect()} == {"a": 50, "b": 10, "c": 10}


def test_stale_reads_ask_for_a_sync(spark):
    day = 86_400_000
    ran = spark.createDataFrame([(1, "a", "sync", 8 * day, 9 * day, None)], "id long, account string, phase string, started_at long, finished_at long, error string")
    archive = Archive(spark, mail(spark, [{"internal_date": 8 * day}]), {"a": ["me@me.org"]}, 10 * day + 5, runs=ran, jobs=job_table(spark, []))
    first = call(archive, "list_labeled", label="INBOX")
    assert first["sync_started"] and first["freshness"]["syncing"] and first["freshness"]["age_seconds"] == 86_400
    job = archive.jobs.collect()
    assert [(r["kind"], r["account"], r["params"], r["id"]) for r in job] == [("sync", "a", '{"since": "2d"}', first["freshness"]["refresh_command"]["job_id"])]
    assert call(archive, "sync_now", account="a")["result"]["job_id"] == job[0]["id"] and archive.jobs.count() == 1
    archive.auth_errors["a"] = 7
    refused = call(archive, "list_labeled", label="INBOX", account="a")
    assert "sync_started" not in refused and refused["freshness"]["auth"] == "needs_reauth" and refused["freshness"]["refresh_command"]["status"] == "blocked"
    assert call(archive, "sync_now", account="a")["result"]["started"] is False
    archive.auth_errors.clear()
    archive.now_ms = 9 * day + 5
    assert "sync_started" not in call(archive, "list_labeled", label="INBOX") and archive.jobs.count() == 1


def test_migrations(spark):
    df = spark.createDataFrame([("x", 1)], "id string, n int")
    steps = [schema.Migration(2, lambda t: t | {"m": t["m"].withColumn("extra", F.lit(None).cast("string"))}), schema.Migration(1, lambda t: t | {"m": df})]
    stored = []
    tables, version = schema.migrate({}, 0, steps, lambda t, v: stored.append(v) or t)
    assert version == 2 and stored == [1, 2] and tables["m"].columns == ["id", "n", "extra"]
    assert schema.migrate(tables, 2, steps) == (tables, 2)

    def broken(_):
        raise OSError

    with pytest.raises(OSError):
        schema.migrate({}, 0, [*steps, schema.Migration(3, broken)], lambda t, v: stored.append(v) or t)
    assert stored == [1, 2, 1, 2]  # what went before is published
    with pytest.raises(schema.SchemaError):
        schema.migrate({}, 3, steps)
    wide = spark.createDataFrame([], "id string, n long, note string").schema
    assert schema.conform(df, wide).schema == wide and schema.conform(df, wide).first()["n"] == 1
    for bad in ("n string", "id string, n int, d date not null"):
        with pytest.raises(schema.SchemaError):
            schema.conform(df, spark.createDataFrame([], bad).schema)
