"""Session merging, fill-in-middle and the passage classifier against plain versions and their SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import fim, passage_quality, sessions
from quillmesh.llm.fim import EliasFano, boundaries, fill_in_middle, fim_digest, restored
from quillmesh.llm.passage_quality import Model, describe, fit, passages_of
from quillmesh.llm.sessions import NAMES, conversation_events, session_versions

EVENTS = "user long, batch long, second long, value long, segment string, n long"


def plain_versions(events, gap):
    """After each batch all events so far are cut into sessions anew."""
    out = []
    for user in sorted({e[0] for e in events}):
        mine = sorted((e for e in events if e[0] == user), key=lambda e: e[2])
        standing = []
        for batch in sorted({e[1] for e in mine}):
            groups = []
            for e in (e for e in mine if e[1] <= batch):
                if groups and e[2] - groups[-1][-1][2] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                new = sum(e[1] == batch for e in g)
                if not new:
                    continue
                start, end = g[0][2], g[-1][2]
                old = [v for v in standing if start <= v["start_s"] and v["end_s"] <= end]
                for v in old:
                    v.update(retracted_batch=batch, retracted_start_s=start)
                standing = [v for v in standing if v not in old]
                made = {"user": user, "batch": batch, "start_s": start, "end_s": end, "n_events": len(g), "n_new": new, "n_retracted": len(old), "h_sum": sum(e[3] or 0 for e in g), "retracted_batch": None, "retracted_start_s": None}
                standing.append(made)
                out.append(made)
    return sorted(tuple(v[n] for n in NAMES) for v in out)


def got_versions(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=lambda t: t[:3])


def test_versions_against_plain_sessions(spark):
    rng = random.Random(5)
    events = [(rng.randrange(4), rng.randrange(6), rng.randrange(-900, 5000), rng.randrange(9), "x", 1) for _ in range(260)]
    events += [(9, i % 5, i * 30, 1, "x", 1) for i in range(400)]  # within the gap for many blocks: no cut inside
    events += [(10, 3 - i // 8, i * 41, None, "x", 1) for i in range(30)] + [events[0]] * 3
    events += [(11, 0, 100, 1, "x", 1), (11, 0, 140, 1, "x", 1), (11, 1, 181, 1, "x", 1), (11, 2, 140, 1, "x", 1)]  # exactly the gap, and one second more
    df = spark.createDataFrame([*events, (None, 1, 1, 1, "x", 1), (1, None, 1, 1, "x", 1), (1, 1, None, 1, "x", 1)], EVENTS)
    wanted = sorted(plain_versions(events, 40), key=lambda t: t[:3])
    for block in (64, 10_000):
        assert got_versions(session_versions(df, gap=40, block=block)) == wanted
    assert session_versions(df.limit(0), gap=40, block=64).count() == 0


def test_conversation_events_and_sql(spark):
    rng = random.Random(6)
    rows = [(c, t, "user", "x") for c in range(40) for t in range(rng.randrange(1, 9))] + [(3, 1, None, None), (3, 1, None, None), (5, None, "user", "y"), (7, 90_000, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("role", "batch")
    events = []
    for conv, turn, *_ in rows:
        if turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            second, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            events.append((2 * (conv // 8) + c % 2, second // 1800 + (g % 4 if g % 3 == 0 else 0), second, h))
    versions = session_versions(conversation_events(df))
    got = got_versions(versions)
    assert got == sorted(plain_versions(events, 240), key=lambda t: t[:3])
    assert conversation_events(spark.createDataFrame([(None, 1)], "conv_id long, turn long")).count() == 0
    conversations = df.toPandas()  # noqa: F841
    sql = duckdb.sql("WITH conversations AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM conversations) " + sessions.SESSIONS_SQL.strip().replace("WITH k AS", ", k AS", 1))
    assert sql.columns == list(NAMES) == versions.columns
    assert sorted(sql.fetchall(), key=lambda t: t[:3]) == got


# --- fill-in-middle

DOCS = "doc_id long, text string, key long, part string, form string"


def plain_fim(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_slices(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é\n漢😀<>P") for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(500, "has <S> inside"), (501, None), (502, ""), (503, "ü漢" * 40_000), (None, "no id"), (7, texts[7]), (7, texts[7])]
    rows += [(1000 + i, "one text of many copies") for i in range(200)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    made = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()), key=repr)
    assert got == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=repr)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    assert made.where("form <> 'plain'").count() == made.where("form <> 'plain' AND length(back) = n").count()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = sorted((tuple(r) for r in fim_digest(df).collect()), key=repr)
    assert digest == sorted(((i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in rows), key=repr)
    documents = df.toPandas()  # noqa: F841
    sql = duckdb.sql("WITH documents AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents) " + fim.FIM_SQL.strip().replace("WITH d AS", ", d AS", 1))
    assert sql.columns == fim_digest(df).columns and sorted(sql.fetchall(), key=repr) == digest
    assert fill_in_middle(df.limit(0)).count() == 0


def test_hot_copies_are_divided(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = fim.grouped(df, "doc_id", "text").select("key", F.spark_partition_id().alias("p")).groupBy("key").agg({"p": "approx_count_distinct"}).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r[1] for r in parts) > 1


def test_elias_fano_lists():
    rng = np.random.default_rng(3)
    for n, top in ((1, 0), (1, 900), (5, 3), (3000, 2999), (700, 100_000), (5000, 20_000)):
        values = np.sort(rng.integers(0, top + 1, n))
        found = EliasFano(values)
        assert [found.select(i) for i in range(n)] == values.tolist()
    marks = boundaries("aé漢😀".encode())
    assert [marks.select(i) for i in range(marks.n)] == [0, 1, 3, 6, 10]


# --- passages


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    rows, starts, labels = rng.normal(size=(9, passage_quality.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 0, 1])
    weights = {n: np.asarray(rng.normal(0, 0.3, s)) for n, s in Model.SHAPES.items()}
    model = Model(np.zeros(passage_quality.N_FEATURES), np.ones(passage_quality.N_FEATURES), weights)

    def loss():
        p = model.forward(rows, starts)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads = model.backward(model.forward(rows, starts), labels)
    for name in Model.SHAPES:
        at = tuple(rng.integers(0, s) for s in Model.SHAPES[name])
        kept = weights[name].copy()
        weights[name][at] = kept[at] + 1e-5
        up = loss()
        weights[name][at] = kept[at] - 1e-5
        down = loss()
        weights[name][...] = kept
        assert abs((up - down) / 2e-5 - np.asarray(grads[name])[at]) < 1e-6


def labelled(seed, n):
    """Documents of one to twelve passages; a poor one has a single passage of junk, anywhere."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(48 * rng.randrange(1, 13))]
        poor = rng.random() < 0.3
        if poor:
            at = 48 * rng.randrange(len(words) // 48)
            words[at : at + 48] = [w.upper() + "!!" for w in words[at : at + 48]] if rng.random() < 0.5 else [words[at]] * 48
        out.append((i, " ".join(words), 0 if poor else 1))
    return out


LABELS = "doc_id long, quality int, toxic int"


def test_poor_passages_are_found_in_held_out_documents(spark):
    rows = labelled(2, 900)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows], LABELS)
    got = {r["doc_id"]: r for r in passage_quality.passage_quality(docs, labels).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert len(held) > 100 and sum(y == p for y, p in held) / len(held) > 0.95
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in passage_quality.passage_quality(docs, other).collect()}
    assert all(again[i] == got[i]["score"] for i in got)  # labels of held-out rows are not learnt from


def test_attention_rests_on_the_telling_passage():
    rows = labelled(3, 500)
    model = fit([describe(passages_of(t)) for _, t, _ in rows], np.array([float(y) for *_, y in rows]))
    words = ["abc", "defg", "hij", "cab"] * 120
    words[96:144] = [w.upper() + "!!" for w in words[96:144]]
    out = model.forward(describe(passages_of(" ".join(words))), np.array([0]))
    assert out["e"].argmax() == 2 and out["p"][0] < 0.3


def test_passage_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (4, " \n\t"), (None, "x"), (5, "a " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    got = passage_quality.passage_quality(docs, none).collect()
    assert len(got) == 7 and {round(r["score"], 6) for r in got} == {0.5}
    assert {r["n_passages"] for r in got} == {1, -(-200_000 // 48)}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (4, 7, 0)], LABELS)
    assert {r["score"] > 0.99 for r in passage_quality.passage_quality(docs, one).collect()} == {True}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], LABELS)
    blank = {r["score"] for r in passage_quality.passage_quality(docs, both).where("doc_id IN (2, 3, 4)").collect()}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1
    assert passage_quality.passage_quality(docs.limit(0), both).count() == 0
    assert Model(np.zeros(passage_quality.N_FEATURES), np.ones(passage_quality.N_FEATURES), fit([describe([[]])], np.array([1.0])).weights).scores([[[]]])[0] > 0.9
