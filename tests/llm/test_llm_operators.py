"""The other training-data operators on small fixtures."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quillmesh.llm.chat import PROBE_TEXT, Template, format_conversations, read_back
from quillmesh.llm.common import Scratch
from quillmesh.llm.decontaminate import clean_documents, decontaminate
from quillmesh.llm.licenses import TEMPLATES, Index, align, scan, scan_licenses, tokens
from quillmesh.llm.line_dedup import dedup_lines, later_copies
from quillmesh.llm.mixing import mix, source_rates
from quillmesh.llm.quality import quality
from quillmesh.llm.toxicity import fit, toxicity
from quillmesh.llm.warc import assemble, read_warc, records_in, warc_round_trip, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0) for i, t in enumerate(texts)], DOCS)


# --- quality


def test_quality_counts(spark):
    text = "one two three four five six seven eight " * 3
    rows = {r["doc_id"]: r for r in quality(frame(spark, [text, None, "", " \n\t", "#a $b", "x\nx\n\n \ny\nx"])).collect()}
    assert (rows[0]["n_words"], rows[0]["n_repeat_words"], rows[0]["base_failed"]) == (24, 24, True)
    assert all((rows[i]["n_words"], rows[i]["word_chars"], rows[i]["kept"]) == (0, 0, False) for i in (1, 2, 3))
    assert (rows[4]["n_symbols"], rows[5]["n_dup_lines"]) == (2, 2)
    assert quality(frame(spark, [])).count() == 0


def test_quality_repeat_words_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        assert got[i] == len({p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 8)})


def test_quality_clashing_columns_and_long_texts(spark):
    docs = frame(spark, ["the word and more of it " * 30_000, "x"]).selectExpr("doc_id", "text", "'a' kept", "'b' n_words", "source")
    rows = {r["doc_id"]: r for r in quality(docs, keep_columns=True).collect()}
    assert (rows[0]["n_words"], rows[0]["kept"], rows[0]["source"]) == (180_000, False, "s") and rows[0]["n_repeat_words"] == 180_000


# --- line dedup


def test_line_runs_later_copies_go(spark):
    texts = ["a x\nb x\nc x", "q\na x\nb x\nz", "a x\nz", "b x\n\nc x", None, ""]
    rows = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in dedup_lines(frame(spark, texts)).collect()}
    assert rows[0] == ("a x\nb x\nc x", 0, 0) and rows[1] == ("q\nz", 2, 1) and rows[2] == ("a x\nz", 0, 0)
    assert rows[3] == ("", 2, 1) and rows[4] == (None, 0, 0) and rows[5] == ("", 0, 0)


def brute_lines(texts, least):
    """Lines left by ids 0, 1, ...: every run of `least` lines that starts at an earlier place as well goes, but for lines of that first place's run."""
    first, wanted = {}, {}
    for i, t in enumerate(texts):
        ls = [x for x in (t or "").split("\n") if x.strip()]
        gone = set()
        for k in range(len(ls) - least + 1):
            d, at = first.setdefault(tuple(ls[k : k + least]), (i, k))
            if (d, at) != (i, k):
                gone |= {x for x in range(k, k + least) if d != i or x >= at + least}
        wanted[i] = ([x for k, x in enumerate(ls) if k not in gone], len(gone), sum(1 for x in gone if x - 1 not in gone))
    return wanted


@pytest.mark.parametrize(("least", "letters"), [(1, "abcd"), (2, "abcd"), (3, "abcd"), (4, "abcd"), (2, "a"), (3, "ab"), (5, "ab")])
def test_line_runs_against_brute_force(spark, least, letters):
    rng = random.Random(least)
    draw = lambda n: [rng.choice(letters) + "!" for _ in range(n)]
    passage = [f"p{i}" for i in range(37)]
    texts = ["\n".join(draw(rng.randrange(12))) for _ in range(12)]
    texts += ["\n".join(draw(2) + passage[a : a + n] + draw(2) + ["", "x"]) for a, n in ((0, 37), (0, 37), (3, 20), (10, 27), (30, 7))]
    texts += [texts[-1], None, "", " \n\n", "a!\n" * 9]
    got = {r["doc_id"]: ([x for x in (r["text"] or "").split("\n") if x.strip()], r["n_removed"], r["n_runs"]) for r in dedup_lines(frame(spark, texts), min_lines=least).collect()}
    assert got == brute_lines(texts, least)


def test_maximal_line_runs_have_their_lcp(spark):
    """The runs that the LCP gives are maximal: 41 lines of one document in another, and 5 in a third."""
    passage = [f"line {i}" for i in range(41)]
    texts = ["\n".join(x) for x in (["a", *passage, "b"], ["c", *passage, "d"], ["e", *passage[7:12], "f"])]
    runs = later_copies(frame(spark, texts), Scratch(spark, "test")).collect()
    assert sorted((r["start"], r["length"], r["opos"]) for r in runs) == [(1, 5, 8), (1, 41, 1)]


def test_long_single_lines_are_runs_in_the_pipeline(spark):
    long_, fifty = " ".join(f"w{i}" for i in range(51)), " ".join(f"v{i}" for i in range(50))
    texts = [f"a\n{long_}\nb\n{fifty}", f"c\n{long_}\nd\n{fifty}\ne", long_, f"x\n{long_}\n{long_}", f"y\n{long_}\nb\nz", None]
    docs = frame(spark, texts).selectExpr("doc_id", "text", "'en' lang", "source", "cast(length(text) as long) n_chars")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: f"c\nd\n{fifty}\ne", 3: "x", 4: "y\nz", 5: None}
    rows = {r["doc_id"]: (r["n_removed"], r["n_runs"]) for r in dedup_lines(docs, long_words=50).collect()}
    assert rows == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (2, 1), 5: (0, 0)}


def test_line_dedup_repeated_rows_and_clashing_columns(spark):
    same = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (2, "a b\nc d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in dedup_lines(same).collect()) == [(1, 0), (1, 0), (2, 2)]
    with pytest.raises(ValueError):
        dedup_lines(same.withColumnRenamed("doc_id", "n_runs"), id_col="n_runs")
    clashing = same.selectExpr("doc_id", "text", "'x' n_runs", "'y' k1", "'z' pos")
    assert sorted((r["doc_id"], r["n_removed"], r["n_runs"], r["k1"]) for r in dedup_lines(clashing).collect()) == [(1, 0, 0, "y"), (1, 0, 0, "y"), (2, 2, 1, "y")]
    none = spark.createDataFrame([(None, "a b\nc d"), (3, "a b\nc d"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in dedup_lines(none).collect()) == [(0, 0), (0, 0), (3, 2)]
    long_ = "\n".join(f"l{i}" for i in range(30_000))
    two = spark.createDataFrame([(1, long_), (2, "q\n" + long_ + "\nz")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_removed"], r["n_runs"], r["text"][:9]) for r in dedup_lines(two).collect()} == {1: (0, 0, "l0\nl1\nl2\n"[:9]), 2: (30_000, 1, "q\nz")}


# --- decontamination


def test_substitutions_are_tolerated(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item)], "item_id long, text string")
    changed = item.replace("delta", "xx").replace("kilo", "yy")
    docs = frame(spark, ["before " + item.upper() + " after", changed, "alpha bravo charlie", None, "", item[: len(item) // 2]])
    rows = {r["doc_id"]: (r["contaminated"], r["n_items"], r["max_matched"]) for r in decontaminate(docs, bench).collect()}
    assert rows[0] == (True, 2, 14) and rows[1] == (True, 2, 12)
    assert not any(rows[i][0] for i in (2, 3, 4, 5))
    assert {r["doc_id"] for r in clean_documents(docs, bench).collect()} == {2, 3, 4, 5}
    assert clean_documents(docs, bench.limit(0)).count() == 6 and decontaminate(docs.limit(0), bench).count() == 0


def test_part_of_an_item_is_enough_in_the_pipeline(spark, tmp_path):
    item = [f"t{i}" for i in range(59)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    parts = [item[5:45], item[:30] + ["x"] + item[30:], item[:29] + item[30:], item[20:26] + ["x"] + item[27:33], item[20:26] + ["x"] + item[27:34], item]
    docs = frame(spark, ["a b " + " ".join(p) + " c d" for p in parts]).selectExpr("doc_id", "text", "'en' lang", "source", "n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()} == set()
    short = frame(spark, ["a b " + " ".join(item[20:29]) + " c d", "e f g"]).selectExpr("doc_id", "text", "'en' lang", "source", "n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, short, str(tmp_path)).collect()} == {0, 1}


def brute_overlap(doc, item):
    """Equal tokens of the best overlap over all diagonals, 0 without any."""
    low = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, b, best = low(doc), low(item), 0
    width = min(len(b), 13)
    for diagonal in range(-len(b), len(d) + 1):
        equal = [0 <= j + diagonal < len(d) and d[j + diagonal] == w for j, w in enumerate(b)]
        dense = [i for i in range(len(b) - width + 1) if width and sum(equal[i : i + width]) >= max(8, 0.75 * width)]
        if dense:
            best = max(best, sum(equal[dense[0] : dense[-1] + width]))
    return best


def test_overlaps_against_brute_force(spark):
    """Items with substitutions, insertions, deletions and cuts, null and repeated ids; every diagonal compared, without seeds."""
    rng = random.Random(9)
    items = {i: [f"w{rng.randrange(400)}" for _ in range(n)] for i, n in enumerate((7, 8, 9, 13, 14, 20, 59))}
    texts = [None, "", "a b c", " ".join(items[3] * 3)]
    for words in items.values():
        for kind in range(12):
            part = list(words)
            for _ in range(kind // 4):
                part[rng.randrange(len(part))] = "x"
            if kind % 4 == 1:
                part.insert(len(part) // 2, "y")
            if kind % 4 == 2:
                del part[len(part) // 2]
            if kind % 4 == 3:
                part = part[len(part) // 3 :]
            texts.append(" ".join([f"w{rng.randrange(400)}" for _ in range(5)] + part + ["z"]))
    ids = [None if i % 9 == 0 else 5 if i % 9 == 1 else 100 + i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, k1 long, seed string")
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(3, " ".join(items[3]), "y"), (None, texts[-1], "")], "item_id long, text string, tokens string")
    order = lambda rows: sorted(rows, key=repr)
    wanted = []
    for i, t in zip(ids, texts, strict=True):
        found = {k: n for k, w in items.items() if (n := brute_overlap(t, " ".join(w)))}
        wanted.append((i, len(found), min(found, default=None), max(found.values(), default=0)))
    missed = [x for x in zip(order(wanted), order((r["doc_id"], r["n_items"], r["first_item"], r["max_matched"]) for r in decontaminate(docs, bench).collect()), strict=True) if x[0] != x[1]]
    assert not missed
    assert sum(x[1] > 0 for x in wanted) > 25


# --- mixing


def test_mixing_reaches_the_weights(spark):
    docs = frame(spark, ["t"] * 3000, "a").unionByName(frame(spark, ["t"] * 30, "b").withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_id") + 9000))
    out = mix(docs, {"a": 0.5, "b": 0.5})
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["a"] - 1515) < 150 and abs(counts["b"] - 1515) < 150
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)
    rates = {r["source"]: r for r in source_rates(docs, {"a": 0.999, "b": 0.001}).collect()}
    assert rates["a"]["parts"] == 1 and abs(rates["a"]["cdf"][-1] - 1) < 1e-12


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(None, "t", None), (1, None, "a"), (1, None, "a")], "doc_id long, text string, source string")
    counts = {}
    for r in mix(rows, {}).collect():
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    assert counts.get("a", 0) % 2 == 0
    assert mix(rows.limit(0)).count() == 0
    clashing = mix(rows.withColumnRenamed("text", "copy"), {"a": 1.0})
    assert clashing.columns == ["doc_id", "source", "copy", "shuffle_key"] and {r["copy"] for r in clashing.collect()} <= set(range(1, 60))
    with pytest.raises(ValueError):
        mix(rows.withColumnRenamed("doc_id", "copy"), id_col="copy")
    wide = spark.createDataFrame([(i, "é" * 300_000, "a") for i in range(6)], "doc_id long, text string, source string")
    assert {len(r["text"]) for r in mix(wide, {}).collect()} <= {300_000}


# --- licenses


def test_license_spans(spark):
    body = "words before. " + TEMPLATES["MIT"].replace("free of charge", "at no charge") + " words after"
    texts = [body, "Nothing here", None, "", "Released under the MIT License.\nx\nReleased under the MIT License."]
    rows = [r.asDict() for r in scan_licenses(frame(spark, texts)).collect()]
    mit = next(r for r in rows if r["doc_id"] == 0 and r["license"] == "MIT")
    assert mit["coverage"] > 0.9 and body[mit["start"] : mit["end"]].startswith("Permission is hereby") and body[mit["start"] : mit["end"]].endswith("to do so")
    assert [r["start"] for r in rows if r["doc_id"] == 4] == [0, 34] and {r["doc_id"] for r in rows} == {0, 4}


def full_alignment(template, part):
    """Local alignment (match 2, else -1) of everything: the best score, and the equal tokens of the best paths by the cells where they end."""
    best, ends = 0, set()
    row = [(0, 0)] * (len(part) + 1)
    for word in template:
        new = [(0, 0)]
        for j, x in enumerate(part):
            new.append(max((0, 0), (row[j][0] + (2 if x == word else -1), row[j][1] + (x == word)), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1])))
            if new[-1][0] > best:
                best, ends = new[-1][0], set()
            if new[-1][0] == best and best:
                ends.add(new[-1][1])
        row = new
    return best, ends


def test_alignment_against_full_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(60):
        t = rng.integers(0, 6, 20).astype(np.uint64)
        part = np.concatenate([t[:8], rng.integers(0, 6, int(rng.integers(0, 3))).astype(np.uint64), t[8:]])
        part[rng.integers(0, len(part))] = 9
        n, a, b = align(t, part, 0, band=len(part) + len(t))
        score, ends = full_alignment(t.tolist(), part.tolist())
        assert n in ends and full_alignment(t.tolist(), part[a:b].tolist())[0] == score
    assert scan("x y z", Index(TEMPLATES)) == []


def test_every_substitution_within_the_coverage_is_found():
    """Each token of each template in turn, and random and regular sets of as many tokens as the coverage allows, replaced by others: found whenever the alignment at the right place covers enough."""
    rng = random.Random(11)
    index, held = Index(TEMPLATES), 0
    for name, template in TEMPLATES.items():
        words = re.findall(r"[A-Za-z0-9]+", template)
        n = len(words)
        allowed = n - -int(-0.8 * n // 1)
        cases = [{i} for i in range(n)] if allowed else []
        cases += [set(rng.sample(range(n), allowed)) for _ in range(60)] + [set(list(range(k, n, -(-n // allowed)))[:allowed]) for k in range(3) if allowed]
        for changed in cases:
            text = "before it " + " ".join(f"zz{i}" if i in changed else w for i, w in enumerate(words)) + " after it"
            enough = align(index.words[index.names.index(name)], tokens(text)[2], 2)[0] >= 0.8 * n
            held += enough
            assert len(changed) > 1 or enough
            assert not enough or name in {m["license"] for m in scan(text, index)}, (name, changed)
    assert held > 500


def test_license_scan_against_brute_force(spark):
    """Without index, winnowing or band: every template aligned with every whole text."""
    rng = random.Random(12)
    low = lambda t: [w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    texts = ["", None, noise(3000) + " " + TEMPLATES["ISC"] + " " + noise(2000)]
    for text in TEMPLATES.values():
        words = text.split(" ")
        texts.append(noise(20) + " " + text + " " + noise(10))
        changed = list(words)
        for i in range(4, len(words), 15):
            changed[i] = "zz"
        texts += [noise(5) + "\n" + " ".join(changed), " ".join(words[: len(words) // 2]) + " " + noise(30), text.upper()]
    docs = frame(spark, [*texts, texts[3], texts[3]]).withColumn("license", __import__("pyspark").sql.functions.lit("x"))
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    wanted = {}
    for i, t in enumerate([*texts, texts[3], texts[3]]):
        part = low(t or "")
        for name, template in TEMPLATES.items():
            words = low(template)
            if part and max(full_alignment(words, part)[1], default=0) >= 0.8 * len(words):
                wanted.setdefault(i, set()).add(name)
    assert got == wanted and len(wanted) > 30
    assert scan_licenses(docs.limit(0)).collect() == []


# --- toxicity


def test_subwords_generalise_to_misspellings(spark):
    rng = random.Random(6)
    words = ["w%03d" % i for i in range(300)]
    text = lambda bad: " ".join([rng.choice(words) for _ in range(30)] + ([rng.choice(["grumbly", "nasty"]) + rng.choice(["", "s", "est"])] if bad else []) + [rng.choice(words) for _ in range(30)])
    texts = [text(i % 3 == 0) for i in range(600)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(3, None)], "doc_id long, toxic int")
    rows = toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and 60 < len(held) < 180
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    model = fit(texts, np.array([int(i % 3 == 0) for i in range(600)]))
    assert model.score(" ".join(words[:40]) + " grumblyyy " + " ".join(words[40:80])) > model.score(" ".join(words[:80]))
    assert 0 <= model.score(None) <= 1 and model.score("") == model.score(None)
    assert {r["predicted"] for r in toxicity(docs.limit(5), labels.limit(0)).collect()} == {0}


def test_toxicity_scores_equal_a_plain_version(spark):
    """Scores of Spark, cached and vectorised, against loops over n-grams and windows; null, empty, long, repeated and extra."""
    import zlib

    from quillmesh.llm.toxicity import BUCKETS, STRIP, training_rows

    texts = ["you vile grub " * 3 + f"word{i}" if i % 2 else f"a calm day {i} in the garden with tea" for i in range(60)] + [None, "", "  ", "tea and cake " * 4000, "so VILE!", "so VILE!"]
    docs = frame(spark, texts).withColumnRenamed("start", "toxic")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    model = fit(*training_rows(docs, labels, 1500, 3000))

    def plain(text):
        words = (text or "").lower().split()
        values = []
        for word in words:
            bare = f"<{word.strip(STRIP)}>".encode()
            grams = [bare] + [bare[i : i + k] for k in (3, 4, 5) for i in range(len(bare) - k + 1)]
            values.append(sum(model.gram[zlib.crc32(g) % BUCKETS] for g in grams) / len(grams))
        size = min(8, len(values))
        peak = max(sum(values[i : i + size]) / size for i in range(len(values) - size + 1)) + model.bias if values else 0.0
        z = model.curve[0] * peak + model.curve[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    assert all(abs(rows[i] - plain(t)) < 1e-9 for i, t in enumerate(texts)) and len(rows) == len(texts)
    assert rows[64] == rows[65] and toxicity(docs.limit(0), labels).collect() == []
    blank = frame(spark, ["", "", " ", ""])
    marks = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    assert {0 <= r["score"] <= 1 for r in toxicity(blank, marks).collect()} == {True}
    assert fit(["", ""], np.array([0, 1])).score("") == pytest.approx(0.5)


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 20
    rows = [(5, "http://a/\r\nx", big), (3, "http://b/", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_round_trip(pages, f"file://{tmp_path}/w").collect()}
    n = len(big.encode())
    assert got == {5: (n, "revisit", 3), 3: (n, "response", None), 9: (n, "revisit", 3), 1: (5, "response", None), 2: (5, "response", None), 4: (0, "response", None)}
    records = read_warc(spark, f"file://{tmp_path}/w")
    nested = assemble(records).collect()
    assert len(nested) == 6 and all(r["request"] and r["metadata"] and r["capture"]["digest_ok"] for r in nested)
    assert sorted(bytes(r["capture"]["payload"]).decode() for r in nested if r["capture"]["type"] == "response") == sorted([big, "short", "short", ""])
    write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_parser_rejects_broken_records():
    with pytest.raises(ValueError):
        list(records_in(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    assert list(records_in(b"")) == []


# --- chat


def test_chat_round_trip(spark):
    t = Template()
    for role, text in [("user", PROBE_TEXT), ("a:b\\", "\\\\###</turn>\n"), ("", ""), ("assistant", "####\\"), ("x", "</turn>\n### user: y")]:
        whole = "".join(s for s, _ in t.segments(role, text))
        assert t.parse_turn(whole + "rest") == (role, text, "rest")
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, 0, "assistant", "a"), (2, 0, None, "b"), (None, 3, "user", "n"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_back(format_conversations(df)).collect()}
    assert {k: (r["n_turns"], r["valid"], r["loss_chars"]) for k, r in got.items()} == {1: (2, True, 3), 2: (2, False, 1), None: (1, True, 0), 3: (2, False, 0)}
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_chat_long_and_clashing(spark):
    """A conversation of 4,000 turns, one turn of a million characters, a real conversation -7 (the probe's turns join it) and extra columns."""
    from quillmesh.llm.chat import with_probe

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(4000)] + [(2, 0, "user", "q"), (2, 1, "assistant", "é###" * 250_000), (-7, 5, "user", "own")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' segments", "1 seq")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["valid"]) for r in read_back(format_conversations(with_probe(df))).collect()}
    assert got[1] == (4000, sum(len(f"t{i}") for i in range(1, 4000, 2)), True) and got[2] == (2, 1_000_000, True) and got[-7] == (3, len(PROBE_TEXT), True)


def test_warc_null_and_repeated_rows(spark):
    big = "z" * 200
    rows = [(None, "u", big), (4, "u", big), (4, "u", big), (2, "u", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' payload", "'y' record_type")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc_round_trip(pages).collect()), key=repr)
    assert len(got) >= 3 and (False, 2, "response", None) in got and {x[1:] for x in got if x[1] == 4} <= {(4, "response", None), (4, "revisit", 4)}
