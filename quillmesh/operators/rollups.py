"""Contact, domain and thread rollups, sender cadence and small aggregates.

The rollups depend on the order of messages (a reply follows an earlier message of the contact in
the thread). The order (internal_date nulls first, id) is compared as a struct, so no global
numbering is needed: the first message of a thread and the first one received from a contact in it are
minimums over the thread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S

DAY_MS = 86_400_000


def order_key() -> Column:
    return F.struct(F.coalesce("internal_date", F.lit(-(2**62))).alias("d"), F.col("gmail_message_id").alias("id"))


def _thread() -> Column:
    return S.blank_to_null(F.col("thread_id"))


def received_events(messages: DataFrame) -> DataFrame:
    """One row per received message from an address that is not the account's own."""
    rows = messages.where("direction <> 'sent'").withColumn("address", S.extract_address(F.col("from_addr")))
    rows = rows.where(F.col("address").isNotNull() & ~F.coalesce(F.col("address") == F.lower("own"), F.lit(False)))
    return rows.select(
        "account", "address", _thread().alias("thread_id"), "internal_date", order_key().alias("seq"), F.lit(0).alias("pos"), S.display_name(F.col("from_addr")).alias("name"),
        F.lit(1).alias("received"), F.lit(0).alias("sent"), (1 - F.col("unread")).alias("read"), "starred", "important",
    )


def sent_events(messages: DataFrame) -> DataFrame:
    """One row per recipient (repeats kept) of a sent message, but for the account's own address."""
    people = F.concat(S.split_recipients(F.col("to_addr")), S.split_recipients(F.col("cc_addr")))
    rows = messages.where("direction = 'sent'").select("account", "own", _thread().alias("thread_id"), "internal_date", order_key().alias("seq"), F.posexplode(people).alias("pos", "raw"))
    rows = rows.withColumn("address", S.extract_address(F.col("raw"))).where(F.col("address").isNotNull() & ~F.coalesce(F.col("address") == F.lower("own"), F.lit(False)))
    zero = [F.lit(0).alias(c) for c in ("read", "starred", "important")]
    return rows.select("account", "address", "thread_id", "internal_date", "seq", "pos", S.display_name(F.col("raw")).alias("name"), F.lit(0).alias("received"), F.lit(1).alias("sent"), *zero)


def contact_events(messages: DataFrame) -> DataFrame:
    """One scan: a row per message and correspondent (a message without one keeps a row with a null address), with the minimums that replies depend on.

    first_in is the thread's first message, first_from the first one received from the address in the thread; both come from
    windows over one shuffle by thread, in which a message without a thread is a thread of its own.
    """
    sent = F.col("direction") == "sent"
    recipients = F.transform(F.concat(S.split_recipients(F.col("to_addr")), S.split_recipients(F.col("cc_addr"))), lambda x, i: F.struct(i.alias("pos"), x.alias("raw")))
    people = F.when(sent, recipients).otherwise(F.array(F.struct(F.lit(0).alias("pos"), F.col("from_addr").alias("raw"))))
    known = {"is_list": F.coalesce(F.col("is_list"), F.lit(False)), "category": F.coalesce(F.col("category").isin("promotions", "social"), F.lit(False))}
    bulk = reduce(lambda a, b: a | b, [v for k, v in known.items() if k in messages.columns], F.lit(False))
    marks = {"received": ~sent, "sent": sent, "bulk": bulk & ~sent}
    received = {"read": 1 - F.col("unread"), "starred": F.col("starred"), "important": F.col("important")}
    rows = messages.select(
        "account", F.lower("own").alias("own"), _thread().alias("thread_id"), "gmail_message_id", "internal_date", order_key().alias("seq"),
        *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in marks.items()], *[F.when(sent, 0).otherwise(v).alias(k) for k, v in received.items()], F.explode_outer(people).alias("p"),
    )
    address = S.extract_address(F.col("p.raw"))
    rows = rows.withColumn("address", F.when(~F.coalesce(address == F.col("own"), F.lit(False)), address))
    rows = rows.withColumn("__thread", F.coalesce("thread_id", F.concat(F.lit("\x00"), "gmail_message_id"))).withColumn("__in", F.col("thread_id").isNotNull()).drop("thread_id", "gmail_message_id", "own")
    in_thread = F.col("__in")
    first_from = F.min(F.when((F.col("received") == 1) & F.col("address").isNotNull(), F.col("seq"))).over(W.partitionBy("account", "__thread", "address"))
    first_in = F.min("seq").over(W.partitionBy("account", "__thread"))
    rows = rows.withColumn("first_from", F.when(in_thread, first_from)).withColumn("first_in", F.when(in_thread, first_in))
    return rows.select("account", F.col("__thread").alias("thread"), "address", "internal_date", "seq", F.col("p.pos").alias("pos"), S.display_name(F.col("p.raw")).alias("name"), *marks, *received, "first_from", "first_in")


SUMS = {"msgs_received": "received", "msgs_sent": "sent", "read_count": "read", "replied_count": "replied", "initiated_count": "initiated", "starred_count": "starred", "important_count": "important"}


def _counted(messages: DataFrame) -> DataFrame:
    events = contact_events(messages).where("address IS NOT NULL")
    sent = F.col("sent") == 1
    replied = sent & F.coalesce(F.col("first_from") < F.col("seq"), F.lit(False))
    initiated = sent & ~replied & F.coalesce(F.col("first_in") == F.col("seq"), F.lit(False))
    return events.withColumns({"replied": replied.cast("int"), "initiated": initiated.cast("int")})


def _first_name() -> Column:
    return F.min(F.when(F.col("name").isNotNull(), F.struct("seq", "pos", "name")))


def contacts_rollup(messages: DataFrame, with_bulk: bool = False) -> DataFrame:
    """One row per correspondent; with_bulk adds how many bulk messages it sent (bulk_count)."""
    sums = SUMS | ({"bulk_count": "bulk"} if with_bulk else {})
    out = _counted(messages).groupBy("account", "address").agg(_first_name()["name"].alias("display_name"), *[F.sum(v).cast("long").alias(k) for k, v in sums.items()], F.min("internal_date").alias("first_seen"), F.max("internal_date").alias("last_seen"))
    return out.withColumn("domain", S.host_of(F.col("address")))


def contact_shares(messages: DataFrame) -> DataFrame:
    """What each thread gives to each correspondent: states that `contacts_of` merges. Replies depend on nothing outside their thread, so a thread's shares follow from its messages alone."""
    sums = SUMS | {"bulk_count": "bulk"}
    return _counted(messages).groupBy("account", "thread", "address").agg(_first_name().alias("named"), *[F.sum(v).cast("long").alias(k) for k, v in sums.items()], F.min("internal_date").alias("first_seen"), F.max("internal_date").alias("last_seen"))


def contacts_of(shares: DataFrame) -> DataFrame:
    """contacts_rollup (with bulk_count) from shares."""
    sums = [*SUMS, "bulk_count"]
    out = shares.groupBy("account", "address").agg(F.min("named")["name"].alias("display_name"), *[F.sum(c).alias(c) for c in sums], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.withColumn("domain", S.host_of(F.col("address")))


def domains_rollup(contacts: DataFrame, with_correspondents: bool = False) -> DataFrame:
    """One row per domain; with_correspondents adds how many of its contacts were written to (correspondents)."""
    also = [F.count_if(F.col("msgs_sent") > 0).alias("correspondents")] if with_correspondents else []
    rows = contacts.where("domain IS NOT NULL").groupBy("account", "domain").agg(F.sum(F.col("msgs_received") + F.col("msgs_sent")).alias("msgs"), F.count("*").alias("distinct_contacts"), *also)
    return rows.withColumn("registrable_domain", S.registrable_domain(F.col("domain")))


def participations(messages: DataFrame) -> DataFrame:
    """(account, thread_id, address, placed, contact), one scan and a row per message and person: placed if the thread has the person as a participant (threads_rollup), contact if this makes it a contact (contacts_rollup)."""
    sent = F.col("direction") == "sent"
    person = lambda raw, other: F.struct(raw.alias("raw"), F.lit(other).alias("other"))
    recipients = F.transform(F.concat(S.split_recipients(F.col("to_addr")), S.split_recipients(F.col("cc_addr"))), lambda x: person(x, True))
    people = F.when(sent, F.concat(recipients, F.array(person(F.col("from_addr"), False)))).otherwise(F.array(person(F.col("from_addr"), True)))
    rows = messages.select("account", F.lower("own").alias("own"), _thread().alias("thread_id"), F.col("direction").isNotNull().alias("known"), F.explode(people).alias("p"))
    rows = rows.withColumn("address", S.extract_address(F.col("p.raw"))).where(F.col("address").isNotNull() & (~F.col("p.other") | ~F.coalesce(F.col("address") == F.col("own"), F.lit(False))))
    return rows.select("account", "thread_id", "address", (F.col("known") & F.col("thread_id").isNotNull()).alias("placed"), F.col("p.other").alias("contact"))


def threads_rollup(messages: DataFrame) -> DataFrame:
    rows = messages.where(_thread().isNotNull())
    subject = F.when(F.col("subject").isNotNull(), F.struct(F.coalesce("internal_date", F.lit(0)).alias("d"), order_key().alias("seq"), "subject")) if "subject" in messages.columns else F.lit(None)
    facts = rows.groupBy("account", "thread_id").agg(
        F.count("*").alias("msg_count"), F.sum("unread").cast("long").alias("unread_count"), F.max((F.col("direction") == "sent").cast("int")).alias("user_participated"),
        F.max(subject).alias("top"), F.min("internal_date").alias("first_at"), F.max("internal_date").alias("last_at"),
    )
    facts = facts.withColumn("subject", F.col("top.subject") if "subject" in messages.columns else F.lit(None).cast("string")).drop("top")
    people = received_events(messages).select("account", "thread_id", "address").unionByName(sent_events(messages).select("account", "thread_id", "address"))
    people = people.unionByName(rows.where("direction = 'sent'").select("account", _thread().alias("thread_id"), S.extract_address(F.col("from_addr")).alias("address")))
    people = people.where("thread_id IS NOT NULL AND address IS NOT NULL").distinct().groupBy("account", "thread_id").agg(F.array_sort(F.collect_list("address")).alias("participants"))
    return facts.join(people, ["account", "thread_id"], "left").withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))


def cadence(messages: DataFrame, since_ms: int | None = None, category: str | None = None, domains: DataFrame | None = None) -> DataFrame:
    """Per brand: messages received, distinct senders, first and last, rates; the category filter tests the exact host."""
    rows = messages.where("direction = 'received'").withColumn("sender", S.extract_address(F.col("from_addr"))).withColumn("host", S.host_of(F.col("sender"))).where("host IS NOT NULL")
    if since_ms is not None:
        rows = rows.where(F.col("internal_date") >= since_ms)
    brand = S.registrable_domain(F.col("host"))
    if domains is not None:
        rows = rows.join(domains.select("account", F.col("domain").alias("host"), F.col("category").alias("host_category"), F.col("registrable_domain").alias("stored")), ["account", "host"], "left")
        brand = F.coalesce("stored", brand)
        if category is not None:
            rows = rows.where(F.col("host_category") == category)
    elif category is not None:
        raise ValueError("a category filter needs the domains")
    out = rows.groupBy("account", F.coalesce(brand, F.col("host")).alias("domain")).agg(F.count("*").alias("msgs"), F.countDistinct("sender").alias("senders"), F.min("internal_date").alias("first_ms"), F.max("internal_date").alias("last_ms"))
    span = F.coalesce(F.greatest(F.lit(1.0), (F.col("last_ms") - F.col("first_ms")) / float(DAY_MS)), F.lit(1.0))
    return out.withColumn("per_week", F.col("msgs") * 7 / span).withColumn("per_month", F.col("msgs") * 30 / span)


BODY_STATES = ("meta", "full", "summary-only")


def body_state_counts(messages: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("body_state") == s).alias(s.replace("-", "_")) for s in BODY_STATES]
    return messages.groupBy("account").agg(*counts, F.count("*").alias("messages"))


def index_as_of(runs: DataFrame) -> DataFrame:
    """Per account its last finished run without error; over accounts the earliest of these."""
    last = runs.where("finished_at IS NOT NULL AND error IS NULL").groupBy("account").agg(F.max("finished_at").alias("as_of"))
    return last.unionByName(last.agg(F.min("as_of").alias("as_of")).select(F.lit(None).cast("string").alias("account"), "as_of"))


def bulk_counts(messages: DataFrame) -> DataFrame:
    """Per contact the received bulk messages (lists, promotions, social)."""
    bulk = F.coalesce(F.col("is_list"), F.lit(False)) | F.coalesce(F.col("category").isin("promotions", "social"), F.lit(False))
    rows = messages.where((F.col("direction") == "received") & bulk).withColumn("address", S.extract_address(F.col("from_addr")))
    return rows.where("address IS NOT NULL").groupBy("account", "address").agg(F.count("*").alias("bulk_count"))
