"""run() of the corpus pipeline against a brute-force version of its stages."""

import hashlib
import math
import random
import re

import corpus_pipeline
from quillmesh.llm.quality import RULES, STOP_WORDS

WORDS = "the of and to in for with that this amber birch cedar delta ember fjord grove heath islet jetty knoll larch marsh north ocean prism quartz ridge slate thorn".split()


def documents(seed=3):
    rng = random.Random(seed)
    line = lambda n=12: " ".join(rng.choice(WORDS) for _ in range(n))
    text = lambda k: "\n".join(line() for _ in range(k))
    bases = [text(rng.randrange(3, 9)) for _ in range(30)]
    header = [line(), line()]
    out = list(bases)
    out += [b.replace("amber", "onyx", 1) for b in bases[:8]] + bases[5:9]
    out += ["\n".join([header[0], header[1], text(4)]) for _ in range(6)]
    leak = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    out += [text(3) + "\n" + leak + "\n" + text(2), "short text", "", None, "### " * 40, text(1) * 3]
    return [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(out)], leak


def good(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)})
    if len(words) < 20 or 100 * repeated > 30 * len(words):
        return False
    lines = [x for x in t.split("\n") if x.strip()]
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_shouts": t.count("!"), "n_stop_words": sum(w.lower() in STOP_WORDS for w in words), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines)}
    return all((r.low is None or m[r.numerator] / m[r.denominator] >= r.low) and (r.high is None or m[r.numerator] / m[r.denominator] <= r.high) for r in RULES)


def cut_lines(docs):
    seen, out = set(), []
    for d in sorted(docs):
        lines = d[1].split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(at, at[1:], strict=False):
            if (lines[a], lines[b]) in seen:
                gone |= {a, b}
            seen.add((lines[a], lines[b]))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            out.append((d[0], left, d[2], d[3], len(left) if gone else d[4]))
    return out


def one_of_each(docs, k=5):
    sets, parent = {}, {d[0]: d[0] for d in docs}
    for d in docs:
        w = d[1].lower().split()
        sets[d[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [d for d in docs if find(d[0]) == d[0]]


def poisson(rate, u):
    n, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        n += 1
        p *= rate / n
        c += p
    return n


def mixed(docs):
    from quillmesh.llm.mixing import SEED, TARGET_WEIGHTS

    sizes, out = {}, []
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + 1
    rest = sum(n for s, n in sizes.items() if s not in TARGET_WEIGHTS)
    for d in docs:
        share = TARGET_WEIGHTS.get(d[3], (1 - sum(TARGET_WEIGHTS.values())) * sizes[d[3]] / max(rest, 1))
        u = int(hashlib.md5(f"{SEED}|{d[0]}|1".encode()).hexdigest()[:13], 16) / 2**52
        out += [(d[0], d[1], c + 1) for c in range(poisson(len(docs) * share / sizes[d[3]], u))]
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    rows, leak = documents()
    names = list(corpus_pipeline.COLUMNS)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*names).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [d for d in rows if good(d[1] or "")]
    assert 30 < len(docs) < len(rows)
    docs = cut_lines(docs)
    docs = one_of_each(docs)
    docs = [d for d in docs if leak not in d[1]]
    got = sorted((r["doc_id"], r["text"], r["copy"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == mixed(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, leak = documents(4)
    docs = spark.createDataFrame(rows[:12], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == corpus_pipeline.COLUMNS


def test_stages_take_nulls_empty_tables_and_clashing_columns(spark, tmp_path):
    rows, leak = documents(5)
    odd = [(None, rows[0][1], None, None, None), (None, None, None, None, None), (900, "", "en", None, 0), (901, "x " * 70_000, "en", "src1", 140_000), (902, rows[1][1], "en", "src1", 5), (902, rows[1][1], "en", "src1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows[:10], *odd], schema)
    for name in ("n_removed", "component_id", "contaminated", "copy", "kept", "doc"):
        docs = docs.withColumn(name, docs["text"])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path)).select(*corpus_pipeline.COLUMNS).collect()
        ids = [r["doc_id"] for r in out]
        if name == "n-gram Jaccard join":
            assert ids.count(None) == 2 and 902 not in ids and {900, 901, 1} <= set(ids)
        if name == "decontamination":
            assert ids.count(None) == 2 and ids.count(902) == 2
        if name == "line dedup":
            assert {r["doc_id"]: r["text"] for r in out}[900] == ""
