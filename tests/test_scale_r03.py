"""What the operators compute once, and that the shorter ways give what the longer ones gave."""

from pyspark.sql import functions as F
from test_operators import mail, random_mail

from quillmesh.functions import scalars as S
from quillmesh.operators import graph, rollups as R, search
from quillmesh.plans import composites as C
from quillmesh.session import Stage
from quillmesh.sources.mailbox import mailbox
from quillmesh.streaming.kept import KeptRollups


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_not_broadcast_to_the_few_tasks_of_the_people(spark):
    text = mailbox(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [o_custkey" in text


def test_addresses_are_looked_for_once(spark):
    values = ["Pat <P@x.com>", "<>", "<a> b@c", " x@y ", "", None, "n", "a@b, <c@d>", "  Q <q@r>", "'N' <n@m>", "@", "a@ "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in df.select(S.extract_address(F.col("v")), S.display_name(F.col("v")), S.host_of(F.col("v")), S.js_trim(F.col("v"))).collect()]
    assert [r[0] for r in got] == ["p@x.com", None, None, "x@y", None, None, None, "c@d", "q@r", "n@m", None, None]
    assert [r[1] for r in got] == ["Pat", None, None, None, None, None, None, "a@b,", "Q", "N", None, None]
    assert got[8][3] == "Q <q@r>" and got[3][3] == "x@y"
    assert plan(df.select(S.extract_address(F.col("v")).alias("x"))).count("regexp_extract") == 2


def test_members_of_messages_are_members(spark):
    for seed in range(3):
        rows = random_mail(seed) + [{"thread_id": "t1", "direction": None, "from_addr": "late@x.com"}, {"thread_id": "t2", "is_list": True, "from_addr": "l@x.com"}, {"thread_id": "t3", "direction": "sent", "from_addr": "alias@me.org", "to_addr": "p1@x.com"}, {"from_addr": "Alias@me.org"}]
        m = mail(spark, rows)
        long = graph.members(R.threads_rollup(m), m, R.contacts_rollup(m))
        found = graph.members_of(m, Stage(spark, "members"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, long.select(*found.columns).collect()))
        assert ("a", "t3", "alias@me.org") in map(tuple, found.collect())


def test_domains_bring_their_correspondents(spark):
    contacts = R.contacts_rollup(mail(spark, random_mail(5)))
    blank = lambda d: d.withColumn("category", F.lit(None).cast("string"))
    names = ["account", "domain", "correspondents", "msgs", "rank"]
    short = C.domains_to_categorize(contacts, blank(R.domains_rollup(contacts, with_correspondents=True))).select(*names)
    long = C.domains_to_categorize(contacts, blank(R.domains_rollup(contacts))).select(*names)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect())) and short.count()
    assert "Join" not in plan(short)


def test_phrases_without_an_index_are_found_without_a_join(spark):
    m = mail(spark, [{"subject": "The Ernting of it"}, {"subject": "ernting the"}, {"subject": "an érnting"}, {"subject": None, "from_addr": "Onths <o@x.com>"}])
    m = m.withColumns({c: F.lit(None).cast("string") for c in ("snippet", "body_text", "summary_text") if c not in m.columns})
    found = search.with_phrases(m, ["The Ernting", "onths"])
    assert sorted(r["gmail_message_id"] for r in found.collect()) == ["m000", "m003"] and "Join" not in plan(found)
    assert [r["gmail_message_id"] for r in search.with_phrases(m, ["erntings"]).orderBy("gmail_message_id").collect()] == ["m000", "m001", "m002"]
    assert search.with_phrases(m, ["", "--"]).columns == ["account", "gmail_message_id"] and not search.with_phrases(m, [""]).count()


def test_a_kept_batch_is_computed_once(spark):
    m, seen = mail(spark, random_mail(7)), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    KeptRollups(spark, Stage(spark, "kept").root, parts=2).apply(m.mapInArrow(count, m.schema))
    assert seen.value == m.count()
