"""Stored marks: the last word counts, transactions are whole, plans keep their size, sessions share them."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.overlays import FOLD_AFTER, SYNC, Marks, Overlays
from quillmesh.plans.tools import Archive, TOOLS, build_graph, with_messages

from test_operators import mail


def plan_size(df):
    return len(df._jdf.queryExecution().analyzed().toString().splitlines())


@pytest.fixture()
def store(spark, tmp_path):
    return Overlays(spark, f"file://{tmp_path}/marks")


def test_last_word_counts_over_folds_and_sessions(spark, store):
    marks = Marks(store, "category")
    assert store.last() == 0 and marks.items() == [] and len(marks) == 0
    sizes, messages = set(), mail(spark, [{"labels": ["INBOX"]}, {"labels": ["INBOX", "L"]}])
    for i in range(FOLD_AFTER + 6):
        marks[("a", f"k{i % 3}")] = f"v{i}"
        store.put([("label", "a", "m000", f"L{i % 5}", "add" if i % 2 else "remove")])
        if i % 40 == 1:
            sizes.add(plan_size(store.on_messages(messages)))
    n = FOLD_AFTER + 6
    wanted = [(("a", f"k{k}"), f"v{max(i for i in range(n) if i % 3 == k)}") for k in range(3)]
    assert marks.items() == wanted and store.last() == 2 * n
    other = Marks(Overlays(spark.newSession(), store.path), "category")  # another session
    assert other.items() == wanted and other[("a", "k1")] == wanted[1][1]
    labels = {r["gmail_message_id"]: set(r["labels"]) for r in store.on_messages(messages).collect()}
    assert labels == {"m000": {"INBOX"} | {f"L{k}" for k in range(5) if max(i for i in range(n) if i % 5 == k) % 2}, "m001": {"INBOX", "L"}}
    assert len(store._numbers("log")) <= 2 * FOLD_AFTER and len(store._bases()) <= 2
    assert max(sizes) - min(sizes) <= 8  # with a base, and without
    del other[("a", "k1")]
    assert [k for k, _ in marks.items()] == [("a", "k0"), ("a", "k2")] and ("a", "k1") not in marks
    with pytest.raises(KeyError):
        del marks[("a", "k1")]
    store.fold()
    store.fold()
    assert [k for k, _ in marks.items()] == [("a", "k0"), ("a", "k2")]


def test_a_transaction_is_whole_and_has_one_writer(spark, store):
    store.put([("x", "a", "k", "", "1"), ("x", "a", "l", "", "2")])
    store._fs().createNewFile(store._at("claims", "2"))  # a writer that died with its claim: its number stays unused
    assert store.put([("x", "a", "k", "", "3")]) == 3 and {(r["key"], r["value"]) for r in store.read("x").collect()} == {("k", "3"), ("l", "2")}
    class Late(Overlays):  # has listed the folders before another one committed
        def _numbers(self, folder):
            return [n for n in super()._numbers(folder) if n < 3]

    with pytest.raises(ValueError, match="another writer"):
        Late(spark, store.path).put([("x", "a", "k", "", "9")])
    store._fs().create(store._at("staged-x", "part.json")).close()  # a run that broke off before its commit
    assert {(r["key"], r["value"]) for r in store.read().collect()} == {("k", "3"), ("l", "2")}
    assert store.put([]) == 3


def test_odd_texts_come_back(store):
    marks = Marks(store, "rule", single=True)
    for key, value in (("a\nb", {"q": 'x"\\  é', "n": [1, None]}), ("", "empty"), ("null", ["null"])):
        marks[key] = value
        assert marks[key] == value
    assert dict(marks.items()) == {"": "empty", "a\nb": {"q": 'x"\\  é', "n": [1, None]}, "null": ["null"]}
    text = Marks(store, "category")
    text[("a", "d")] = 'say "hi" \\ é'
    assert [tuple(r) for r in store.of("category", "domain", "category").collect()] == [("a", "d", 'say "hi" \\ é')]


def test_an_archive_keeps_its_marks(spark, store):
    rows = mail(spark, [{"thread_id": "t", "from_addr": "Pal <pal@x.com>", "internal_date": 5, "labels": ["INBOX"]}, {"from_addr": "q@y.com", "internal_date": 6, "labels": ["INBOX", "CATEGORY_UPDATES"], "category": "promotions"}])
    own = {"a": ["me@me.org"]}
    first = Archive(spark, rows, own, 10, overlays=store)
    TOOLS["interest_set"](first, "a", {"pal@x.com": "important", "ghost@q.z": "muted"}, {"y.com": "blocked"}, ["refund"])
    with pytest.raises(ValueError):
        TOOLS["interest_set"](first, "a", {"pal@x.com": None}, {"y.com": "bogus"})
    TOOLS["save_summary"](first, "All fine.", ref="a:m000")
    TOOLS["save_summary"](first, "A thread.", account="a", thread_id="t")
    TOOLS["save_domain_category"](first, "a", "X.com", "work")
    TOOLS["modify_labels"](first, "a:m000", add=["STARRED"], remove=["INBOX"])
    TOOLS["modify_labels"](first, "a:m000", add=["L"])
    again = Archive(spark, rows, own, 10, overlays=Overlays(spark, store.path))
    for archive in (first, again, build_graph(again)):
        assert TOOLS["interest_get"](archive, "a") == {"contacts": {"pal@x.com": "important"}, "domains": {"y.com": "blocked"}, "keywords": ["refund"]}
        got = {r["gmail_message_id"]: r for r in archive.messages.collect()}
        assert (sorted(got["m000"]["labels"]), got["m000"]["starred"], got["m000"]["summary_text"]) == (["L", "STARRED"], 1, "All fine.")
        assert (got["m001"]["labels"], got["m001"]["category"], got["m001"]["summary_text"]) == (["INBOX", "CATEGORY_UPDATES"], "promotions", None)  # nothing of an unedited message is derived anew
        assert [r["summary"] for r in archive.threads().where("thread_id = 't'").collect()] == ["A thread."]
        assert {r["domain"]: (r["curation"], r["category"]) for r in archive.domains().collect()} == {"x.com": (None, "work"), "y.com": ("blocked", None)}
    synced = with_messages(again, rows)  # the provider's labels are the newer ones; a summary stays
    row = synced.messages.where("gmail_message_id = 'm000'").first()
    assert row["labels"] == ["INBOX"] and row["summary_text"] == "All fine."
    TOOLS["interest_set"](synced, "a", {"pal@x.com": None})
    assert TOOLS["interest_get"](first, "a")["contacts"] == {} and store.read(SYNC).count() == 1
    changes = TOOLS["refresh_inbox"](synced, "a", ["m001", "new"])
    assert (changes["archived"], changes["added"]) == (1, 1) and synced.messages.where(F.array_contains("labels", "INBOX")).count() == 1
