"""The n-gram join and suffix dedup against brute force on small fixtures."""

import functools
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quillmesh.llm.ngram_join import divide_skip, keep_one, set_of, similar, similar_classes, t_occurrence
from quillmesh.llm.suffix_dedup import LENGTH, suffix_dedup, suffix_dedup_digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, label long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in texts], DOCS)


def near_texts(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (12, 40, 90, 300)]
    out = []
    for base in bases:
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(30))
    out += [" ".join(rng.choice(words) for _ in range(20)) + " " + passage for _ in range(15)]
    out += ["one two three", "One TWO\tthree", "", None, "  \n", "a b c d", "a  b c d", out[0], out[0].upper()]
    return list(enumerate(out, 10))


def brute_components(texts, k, percent=85):
    sets = {}
    for i, t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in texts]
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and sets[y]:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_components_equal_brute_force(spark, seed, k):
    texts = near_texts(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(frame(spark, texts), k=k).collect()}
    assert got == brute_components(texts, k)


def revision_chains(seed, families=12, length=6):
    """Texts of 100 shingles of four words; of each chain only neighbours (92 in common) are similar."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        text = [f"f{f}w{i}" for i in range(103)]
        places = rng.sample(range(4, 99, 5), 2 * (length - 1))
        for r in range(length):
            for i in places[2 * r - 2 : 2 * r] if r else ():
                text[i] = f"f{f}r{r}w{i}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_revision_chains_equal_brute_force(spark, seed):
    texts = revision_chains(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 4) and len({c for _, c in got.values()}) == 12


def test_pipeline_stage_takes_80_percent(spark):
    """5-word sets: 4 of 5 in common (80 percent), 46 of 56 (82 percent) and 7 of 10 (70)."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    texts = [words("a", 8), words("a", 9), words("b", 55), words("b", 55).replace("b25 ", "x "), words("c", 12), words("c", 11) + " x y"]
    docs = frame(spark, list(enumerate(texts)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in brute_components(list(enumerate(texts)), 5, 80).items() if i == c} == {0, 2, 4, 5}


def test_keep_one_keeps_the_smallest_of_each_component(spark):
    texts = near_texts(3)[:30]
    wanted = {i for i, (_, c) in brute_components(texts, 5).items() if i == c}
    assert {r["doc_id"] for r in keep_one(frame(spark, texts), k=5).collect()} == wanted


def test_empty_table_and_columns(spark):
    assert similar_classes(frame(spark, [])).collect() == []
    assert suffix_dedup_digest(frame(spark, [])).collect() == []


def test_ids_and_long_texts_in_the_join(spark):
    """Rows without an id, one id with several texts, repeated rows, a very long text and clashing columns."""
    rng = random.Random(3)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(n)] for x, n in (("a", 60), ("b", 60), ("c", 40_000)))
    near = lambda w: " ".join([*w[:30], "zz", *w[31:]])
    rows = [(None, " ".join(a)), (1, " ".join(a)), (2, near(a)), (3, " ".join(b)), (3, "~ " + " ".join(a)), (4, near(b)), (5, " ".join(c)), (6, near(c)), (6, near(c)), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, token string, label long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_classes(docs).collect()), key=repr)
    # the greater text stands for 3: "~ a..." is similar to 1 and 2, so 4 is alone with its own text
    assert got == sorted([(None, 57, None), (1, 57, 1), (2, 57, 1), (3, 57, 1), (3, 58, 1), (4, 57, 4), (5, 39_997, 5), (6, 39_997, 5), (6, 39_997, 5), (None, 0, None), (7, 0, 7)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_edit_chains_of_any_kind(spark, seed):
    """Each text made from an earlier one by a replaced word: chains whose ends are far apart."""
    rng = random.Random(100 + seed)
    texts = []
    for family in range(8):
        out = [[f"f{family}w{i}" for i in range(rng.choice([45, 90, 150]))]]
        for r in range(13):
            copy = list(rng.choice(out))
            copy[rng.randrange(len(copy))] = f"f{family}r{r}"
            out.append(copy)
        texts += [" ".join(x) for x in out]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 4)


def test_divide_skip_equals_counting():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.choice([1, 3, 10, 35]))) for _ in range(rng.randrange(1, 14))]
        least = rng.randrange(1, len(lists) + 2)
        counts = {i: sum(i in x for x in lists) for i in range(40)}
        assert sorted(divide_skip(lists, least)) == [(i, n) for i, n in counts.items() if n >= least]


def test_lists_dealt_by_salt(spark, monkeypatch):
    """Every list dealt over three tasks, and lists of one chunk per three ids: the result stays."""
    import quillmesh.llm.ngram_join as J

    monkeypatch.setattr(J.sketch, "salts_of", lambda cells: np.full(len(cells), 3))
    monkeypatch.setattr(J, "CHUNK", 3)
    monkeypatch.setattr(J, "WORK", 0)
    texts = near_texts(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_classes(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 4)


def test_t_occurrence():
    assert t_occurrence([[1, 2, 5], [2, 5], [5, 9]], 2) == [(2, 2), (5, 3)]
    assert similar(6, 7, 6, 85) and not similar(5, 6, 6, 85)
    assert len(set_of("a b c d e", 4)) == 2 and len(set_of("A b", 4)) == 1 and len(set_of(None, 4)) == 0


def suffix_texts(seed, letters):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = draw(2500)
    out = []
    for _ in range(14):
        a, n = rng.randrange(1500), rng.randrange(200, 1000)
        piece = list(base[a : a + n])
        for _ in range(rng.randrange(3)):
            piece[rng.randrange(len(piece))] = "é"
        out.append(draw(rng.randrange(300)) + "".join(piece) + draw(rng.randrange(200)))
    return [*enumerate([*out, out[3], out[3], "z" * 1000, None, "", "x" * 399, base[:400], base[1:401]])]


def brute_cut(texts):
    raw = {i: (t or "").encode() for i, t in texts}
    seen: dict[bytes, int] = {}
    for b in raw.values():
        for s in range(len(b) - LENGTH + 1):
            seen[b[s : s + LENGTH]] = seen.get(b[s : s + LENGTH], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if seen[b[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "letters"), [(1, "abcdefghij"), (2, "ab"), (3, "a")])
def test_suffix_dedup_equals_brute_force(spark, seed, letters):
    texts = suffix_texts(seed, letters)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup_digest(frame(spark, texts)).collect()}
    assert got == brute_cut(texts)


@pytest.mark.parametrize(("block", "per_task"), [(1, 50_000), (3, 50_000), (16384, 1)])
def test_crowded_and_salted_buckets(spark, monkeypatch, block, per_task):
    """Hashes with more contexts than a block holds, and all hashes dealt by salt."""
    import quillmesh.llm.suffix_dedup as S

    salts = np.full(S.sketch.CELLS, 3) if per_task == 1 else np.ones(S.sketch.CELLS, np.int64)
    monkeypatch.setattr(S, "ranked", functools.partial(ranked_with, S.ranked, block, salts))
    texts = suffix_texts(3, "abcdef")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup(frame(spark, texts)).collect()}
    assert got == {i: x[1:3] for i, x in brute_cut(texts).items()}


def ranked_with(real, block, salts, found, cells):
    """`ranked`, under another block size and other salts; the workers see neither patch, so what they need is set in the closure."""
    import quillmesh.llm.suffix_dedup as S

    rows = found.collect()
    out = []
    for salt in range(int(salts.max())):
        stream = S._Ranked(salts > 1)
        some = sorted((r["hash"], r["ctx"], r["doc"], r["mark"], r["place"]) for r in rows if r["ctx"] % int(salts.max()) == salt)
        keep, S.BLOCK = S.BLOCK, block
        for lo in range(0, len(some), 7):
            part = list(zip(*some[lo : lo + 7], strict=True))
            out += stream.take([np.array(part[i], t) for i, t in ((2, np.int64), (3, np.int32), (4, np.int64), (0, np.int64), (1, np.int64))]).to_pylist()
        out += stream.take([x[:0] for x in stream.rows], ends=True).to_pylist()
        S.BLOCK = keep
    return found.sparkSession.createDataFrame([(r["doc"], r["mark"], r["place"], r["hash"], r["what"]) for r in out], "doc long, mark int, place long, hash long, what int")


def test_ranked_stream_equals_groups():
    """The stream over batches of any size against plain groups."""
    import quillmesh.llm.suffix_dedup as S

    rng = random.Random(5)
    for size in (1, 2, 3, 10, 1000):
        rows = sorted((rng.randrange(12), rng.randrange(3)) for _ in range(60))
        stream, got = S._Ranked(np.zeros(S.sketch.CELLS, bool)), []
        for lo in range(0, 60, size):
            part = rows[lo : lo + size]
            got += stream.take([np.arange(lo, lo + len(part)), np.zeros(len(part), np.int32), np.zeros(len(part), np.int64), np.array([x[0] for x in part]), np.array([x[1] for x in part])]).to_pylist()
        got += stream.take([x[:0] for x in stream.rows], ends=True).to_pylist()
        covered = sorted(r["doc"] for r in got if r["what"] == S.COVERED)
        assert covered == [i for i, x in enumerate(rows) if rows.count(x) > 1]
        stands = sorted(rows[r["doc"]] for r in got if r["what"] == S.REPRESENTATIVE)
        assert stands == sorted(x for x in set(rows) if len({c for h, c in rows if h == x[0]}) > 1)


def test_suffix_dedup_ids_and_long_texts(spark):
    """Rows without an id, one id with two texts, equal rows, a text of several segments and extra columns."""
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    a, b, long_ = draw(500), draw(700), draw((1 << 20) + 3000)
    seam = (1 << 20) - 400
    texts = [(None, a), (1, a), (2, b), (2, draw(800)), (None, draw(600)), (3, draw(450)), (3, draw(10) + b), (4, long_), (5, "q" * 5 + long_[seam - 700 : seam + 900]), (6, long_[-600:]), (7, b + "x")]
    texts += [(8, t := draw(400)), (8, t)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, doc long, hash string")
    wanted = brute_cut(list(enumerate(t for _, t in texts)))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup_digest(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((False, texts[i][0], *x) for i, x in wanted.items() if texts[i][0] is not None)
    assert sorted(r["n_removed"] for r in suffix_dedup_digest(docs).where("doc_id IS NULL").collect()) == [0, 500]


@pytest.mark.parametrize(("remembered", "tasks"), [(0, 4), (500_000, 1)])
def test_passages_of_over_50_words_are_marked(spark, monkeypatch, remembered, tasks):
    """51 words that another document holds too, though shorter than 400 bytes, in front, inside and behind; not 50 words, nor a text's own repetitions."""
    import quillmesh.llm.suffix_dedup as S

    monkeypatch.setattr(S, "REMEMBERED", remembered)
    rng = random.Random(11)
    draw = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(100)) for _ in range(n)]
    around = lambda words, at=20: [*draw(at), *words, *draw(17)]
    a, b, c, d, own = draw(51), draw(51), draw(50), draw(90), draw(60)
    texts = [" ".join(x) for x in (around(a), around(a, 0), a, around(c), around(c), own + draw(3) + own, draw(80), d[:70], d[19:], ["x"] * 200, around(["y"] * 60), around(["y"] * 55), *(around(b, i) for i in range(6)), draw(52), draw(50))]
    texts += [copy := " ".join(draw(51)), copy, None, "", " ".join(a).replace(" ", "\n\t "), "é " * 50 + "é"]
    windows = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in (re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts)]
    marked = [any(w & v for j, v in enumerate(windows) if j != i) for i, w in enumerate(windows)]
    got = {r["doc_id"]: (r["shares_passage"], r["n_removed"]) for r in suffix_dedup_digest(frame(spark, list(enumerate(texts))).coalesce(tasks)).collect()}
    assert {i: x for i, (x, _) in got.items()} == dict(enumerate(marked))
    assert marked[:6] == [True, True, True, False, False, False] and got[0][1] == got[2][1] == 0


def test_no_text_of_suffix_dedup_is_shuffled(spark, monkeypatch):
    """Also where nothing is small enough to be broadcast by itself; cut in several passes the result stays."""
    import quillmesh.llm.suffix_dedup as S

    texts, plans, real = suffix_texts(4, "abcdef"), [], S.Scratch.put
    explain = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    monkeypatch.setattr(S.Scratch, "put", lambda self, df, name: plans.append(explain(df)) or real(self, df, name))
    monkeypatch.setattr(S, "RUNS", 3, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup_digest(frame(spark, texts))
        plans.append(explain(out))
        got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute_cut(texts)
    shuffles = [part for plan in plans for part in plan.split("\n\n") if ") Exchange\n" in part]
    assert shuffles and not [s for s in shuffles if "text#" in s]


def test_a_filter_loses_no_hash(spark):
    from quillmesh.llm import sketch
    from quillmesh.llm.hashing import mixed

    own, others = mixed(np.arange(50_000, dtype=np.uint64)), mixed(np.arange(50_000, 150_000, dtype=np.uint64))
    bits = sketch.filter_of(spark.createDataFrame([(int(x),) for x in own.astype(np.int64)], "h long"), len(own))
    assert len(bits) == 1 << 17 and sketch.passes(bits, own).all() and 0 < sketch.passes(bits, others).mean() < 0.02
    assert not sketch.passes(sketch.filter_of(spark.createDataFrame([], "h long"), 0), others).any()
