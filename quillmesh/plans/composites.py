"""Composite queries: per-account shortlists built from messages and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import messages as M
from ..operators.search import Matcher, with_phrases


def top(rows: DataFrame, limit: int | None, *order: Column, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """The first rows of each account, with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def newest(messages: DataFrame, limit: int) -> DataFrame:
    return top(messages, limit, F.desc("internal_date"), F.col("gmail_message_id"))


def catch_up_important(messages: DataFrame, contacts: DataFrame, domains: DataFrame, since_ms: int, limit: int = 25) -> DataFrame:
    recent = messages.where((F.col("direction") == "received") & (F.col("internal_date") >= since_ms))
    return newest(M.important_senders(recent, contacts, domains).where("from_important"), limit)


def catch_up_user_threads(messages: DataFrame, since_ms: int, limit: int = 25) -> DataFrame:
    recent = messages.where((F.col("direction") == "received") & (F.col("internal_date") >= since_ms))
    return newest(recent.join(M.user_threads(messages), ["account", "thread_id"], "left_semi"), limit)


def catch_up_keywords(messages: DataFrame, keywords: list[str], since_ms: int, limit: int = 25, index: Matcher | None = None) -> DataFrame:
    """Recent messages, sent ones too, that hold a keyword: whole stemmed words at consecutive places of subject, sender, recipients or body."""
    recent = messages.where(F.col("internal_date") >= since_ms)
    return newest(recent.join(with_phrases(recent, keywords, index), ["account", "gmail_message_id"], "left_semi"), limit)


def digest_sources(messages: DataFrame, contacts: DataFrame, since_ms: int, limit: int = 20) -> DataFrame:
    rows = messages.where((F.col("direction") == "received") & (F.col("internal_date") >= since_ms) & M.is_digest_bulk()).withColumn("address", S.extract_address(F.col("from_addr")))
    found = rows.groupBy("account", "address").agg(F.count("*").alias("issues"), F.sum("unread").cast("long").alias("unread"), F.count_if(F.col("summary_text").isNull()).alias("unsummarized"))
    return top(contacts.join(found, ["account", "address"]), limit, F.desc_nulls_last("engagement_score"), F.desc("issues"), F.col("address"))


SORTS = {"engagement": "engagement_score", "volume": "volume", "recency": "last_seen", "community": "community_id"}


def list_contacts(contacts: DataFrame, only: str | None = None, sort: str = "engagement", limit: int = 20) -> DataFrame:
    """only: correspondent or a curation; an unknown filter is ignored."""
    rows = contacts.withColumn("volume", F.col("msgs_received") + F.col("msgs_sent"))
    if only == "correspondent":
        rows = rows.where("msgs_sent > 0")
    elif only in ("important", "muted", "blocked"):
        rows = rows.where(F.col("curation") == only)
    key = SORTS[sort]
    return top(rows, limit, F.asc_nulls_last(key) if sort == "community" else F.desc_nulls_last(key), F.col("address"))


def find_person(contacts: DataFrame, hint: str, limit: int = 10) -> DataFrame:
    """Contacts whose name, address or domain holds the hint; correspondents first."""
    low = hint.strip().lower()
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(low) for c in ("display_name", "address", "domain")])
    return top(contacts.where(hit), limit, F.desc(F.col("msgs_sent") > 0), F.desc_nulls_last("engagement_score"), F.col("address"))


def domains_to_categorize(contacts: DataFrame, domains: DataFrame, limit: int = 20) -> DataFrame:
    """domains may have its correspondents (domains_rollup), or they are counted among the contacts."""
    rows = domains.where("category IS NULL")
    if "correspondents" not in domains.columns:
        rows = rows.join(contacts.groupBy("account", "domain").agg(F.count_if(F.col("msgs_sent") > 0).alias("correspondents")), ["account", "domain"])
    return top(rows, limit, F.desc("correspondents"), F.desc("msgs"), F.col("domain"))


def domain_samples(contacts: DataFrame, limit: int = 5) -> DataFrame:
    rows = contacts.where("domain IS NOT NULL").withColumn("volume", F.col("msgs_received") + F.col("msgs_sent"))
    ranked = top(rows, limit, F.desc("volume"), F.col("address"), keys=("account", "domain"))
    return ranked.groupBy("account", "domain").agg(F.array_sort(F.collect_list(F.struct("rank", "address"))).alias("s")).select("account", "domain", F.col("s.address").alias("samples"))


def recent_subjects(messages: DataFrame, limit: int = 3) -> DataFrame:
    rows = messages.where("direction = 'received' AND subject IS NOT NULL").withColumn("domain", S.host_of(S.extract_address(F.col("from_addr")))).where("domain IS NOT NULL")
    return top(rows, limit, F.desc("internal_date"), F.col("gmail_message_id"), keys=("account", "domain")).select("account", "domain", "rank", "subject")


def profile_backlog(messages: DataFrame, contacts: DataFrame, domains: DataFrame, keywords: list[str], index: Matcher | None = None) -> DataFrame:
    """Metadata-only messages that the profile wants: important senders or keywords, but not of muted or blocked contacts or domains."""
    rows = messages.where(F.col("body_state") == "meta")
    named = with_phrases(rows, keywords, index).withColumn("__named", F.lit(True)).dropDuplicates(["account", "gmail_message_id"])
    rows = M.important_senders(rows, contacts, domains).join(named, ["account", "gmail_message_id"], "left")
    rows = rows.where(F.col("from_important") | F.col("__named").isNotNull()).drop("from_important", "__named")
    rows = rows.withColumn("address", S.extract_address(F.col("from_addr"))).withColumn("domain", S.host_of(F.col("address")))
    unwanted = F.col("curation").isin("muted", "blocked")
    rows = rows.join(contacts.where(unwanted).select("account", "address"), ["account", "address"], "left_anti")
    return rows.join(domains.where(unwanted).select("account", "domain"), ["account", "domain"], "left_anti").select(*messages.columns)


def correspondents(contacts: DataFrame, cap: int) -> DataFrame:
    """Addresses the user writes to, strongest ties first."""
    return top(contacts.where("msgs_sent > 0"), cap, F.desc("msgs_sent"), F.desc("replied_count"), F.col("address"))


# How much one run of a sweep takes on, and how correspondents are asked for.
RETENTION_BATCH, BACKFILL_BATCH, INLINE_ENRICH_BATCH, FEED_BATCH = 200, 100, 50, 200
CORRESPONDENT_CHUNK, CORRESPONDENT_CAP = 25, 500


def retention_batch(messages: DataFrame, contacts: DataFrame, domains: DataFrame, cutoff_ms: int, limit: int = RETENTION_BATCH) -> DataFrame:
    """The next bodies of each account to evict, oldest first; the sweep is done once none is left."""
    return top(M.evictable(messages, contacts, domains, cutoff_ms), limit, F.asc("internal_date"), F.col("gmail_message_id"))


def enrich_batch(messages: DataFrame, cutoff_ms: int | None, limit: int = BACKFILL_BATCH) -> DataFrame:
    """The next messages of each account to enrich: direct ones in the window, newest first."""
    return M.select_backlog(messages, since_ms=cutoff_ms, limit=limit)


def correspondent_queries(contacts: DataFrame, cap: int = CORRESPONDENT_CAP, chunk: int = CORRESPONDENT_CHUNK) -> DataFrame:
    """(account, chunk, query): an account's correspondents in provider queries of so many addresses each."""
    rows = correspondents(contacts, cap).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk).cast("int"))
    found = rows.groupBy("account", "chunk").agg(F.sort_array(F.collect_list(F.struct("rank", "address"))).alias("l"))
    return found.select("account", "chunk", F.concat(F.lit("from:{"), F.array_join("l.address", " "), F.lit("}")).alias("query"))


def backfill_slice(source_messages: DataFrame, contacts: DataFrame, since_ms: int, until_ms: int, cap: int = CORRESPONDENT_CAP) -> DataFrame:
    """What a slice of history [since, until) brings in: everything sent, and what the correspondents of each account sent."""
    rows = source_messages.where((F.col("internal_date") >= since_ms) & (F.col("internal_date") < until_ms))
    people = correspondents(contacts, cap).select("account", F.col("address").alias("__address"))
    theirs = rows.where("direction <> 'sent'").withColumn("__address", S.extract_address(F.col("from_addr"))).join(people, ["account", "__address"], "left_semi")
    return rows.where("direction = 'sent'").unionByName(theirs.select(*rows.columns))
