"""Message state: lattice upserts, label edits, demotion, eviction, reconciliation, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions.scalars import all_of, blank_to_null

RANK = {"meta": 0, "full": 1, "summary-only": 2}
BODY = ("body_state", "body_text")
SUMMARY = ("summary_text", "summarized_at")
RETAINED = ("reply_to", "origin_from")


def state_rank(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), state)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (account, id): metadata of the last batch, body and state of the highest rank (the later of equals), retained headers and the summary (text and time together) by the last batch that brings one. batch numbers order incoming rows.

    A sync never has summaries, so it keeps those that were saved; only demotion, eviction and a newer summary change them.
    """
    columns = [c for c in stored.columns if c not in ("account", "gmail_message_id")]
    rows = stored.withColumn("batch", F.lit(-1)).unionByName(incoming, allowMissingColumns=True)
    body = [c for c in BODY if c in columns]
    summary = [c for c in SUMMARY if c in columns]
    kept = [c for c in RETAINED if c in columns]
    meta = [c for c in columns if c not in (*body, *summary, *kept)]
    last = lambda names, key: F.max(F.struct(*key, F.struct(*names).alias("v")))["v"]
    groups = [last(meta, [F.col("batch")]).alias("m"), last(body, [state_rank(F.col("body_state")), F.col("batch")]).alias("b")]
    if summary:
        groups.append(F.max(F.when(F.col(summary[0]).isNotNull(), F.struct("batch", F.struct(*summary).alias("v"))))["v"].alias("s"))
    groups += [F.max(F.when(F.col(c).isNotNull(), F.struct("batch", c)))[c].alias(c) for c in kept]
    out = rows.groupBy("account", "gmail_message_id").agg(*groups)
    of = {**dict.fromkeys(meta, "m."), **dict.fromkeys(body, "b."), **dict.fromkeys(summary, "s."), **dict.fromkeys(kept, "")}
    return out.select("account", "gmail_message_id", *[F.col(of[c] + c).alias(c) for c in columns])


def with_labels(messages: DataFrame, labels: Column) -> DataFrame:
    """Labels replaced; category and flags follow."""
    out = messages.withColumn("labels", labels)
    flags = {f: S.flag(F.col("labels"), f.upper()) for f in ("unread", "starred", "important")}
    return out.withColumns({"category": S.classify_category(F.col("labels")), **flags})


def folded_edits(edits: DataFrame) -> DataFrame:
    """One edit a message: of each label named by several the last word counts (by `seq`, without one all edits are as of one time; at one time adding wins)."""
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    empty = F.array().cast("array<string>")
    wanted = lambda name, on: F.transform(F.coalesce(name, empty), lambda x: F.struct(x.alias("label"), F.lit(on).alias("on")))
    rows = edits.select("account", "gmail_message_id", seq.alias("seq"), F.explode(F.concat(wanted("add", True), wanted("remove", False))).alias("e")).where("e.label IS NOT NULL")
    rows = rows.groupBy("account", "gmail_message_id", F.col("e.label").alias("label")).agg(F.max(F.struct("seq", "e.on"))["on"].alias("on"))
    told = lambda on: F.sort_array(F.collect_list(F.when(F.col("on") == on, F.col("label"))))
    return rows.groupBy("account", "gmail_message_id").agg(told(True).alias("add"), told(False).alias("remove"))


def edit_labels(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (account, gmail_message_id, add array, remove array, maybe seq), several a message or none; messages without one are unchanged."""
    rows = messages.join(folded_edits(edits), ["account", "gmail_message_id"], "left")
    empty = F.array().cast("array<string>")
    labels = F.array_union(F.array_except("labels", F.coalesce("remove", empty)), F.coalesce("add", empty))
    return with_labels(rows, labels).drop("add", "remove")


def reconcile(messages: DataFrame, live: DataFrame) -> DataFrame:
    """messages against the live inbox ids (account, gmail_message_id): one row per change: archived, restored or added."""
    inbox = F.array_contains("labels", "INBOX")
    both = messages.select("account", "gmail_message_id", inbox.alias("stored")).join(live.distinct().withColumn("live", F.lit(True)), ["account", "gmail_message_id"], "full_outer")
    change = F.when(F.col("stored").isNull(), "added").when(F.col("stored") & F.col("live").isNull(), "archived").when(~F.col("stored") & F.col("live"), "restored")
    return both.select("account", "gmail_message_id", change.alias("change")).where("change IS NOT NULL")


def apply_reconcile(messages: DataFrame, changes: DataFrame) -> DataFrame:
    edits = changes.where("change <> 'added'").select(
        "account", "gmail_message_id", F.when(F.col("change") == "restored", F.array(F.lit("INBOX"))).alias("add"), F.when(F.col("change") == "archived", F.array(F.lit("INBOX"))).alias("remove")
    )
    return edit_labels(messages, edits)


# --- predicates


def is_direct() -> Column:
    return ~F.coalesce(F.col("is_list"), F.lit(False)) & (F.col("category").isNull() | ~F.col("category").isin("promotions", "social"))


def is_bulk() -> Column:
    """Bulk as scoring and demotion see it."""
    return F.coalesce(F.col("is_list"), F.lit(False)) | F.coalesce(F.col("category").isin("promotions", "social"), F.lit(False))


def is_digest_bulk() -> Column:
    """Bulk as digests see it: wider."""
    return F.coalesce(F.col("is_list"), F.lit(False)) | F.coalesce(F.col("category").isin("promotions", "social", "updates", "forums"), F.lit(False))


def important_senders(messages: DataFrame, contacts: DataFrame, domains: DataFrame) -> DataFrame:
    """messages with `from_important`: the sender, or the exact host of the sender, is curated as important. Two left joins on equality, no theta join."""
    address = S.extract_address(F.col("from_addr"))
    rows = messages.withColumn("__address", address).withColumn("__host", S.host_of(F.col("__address")))
    c = contacts.where("curation = 'important'").select("account", F.col("address").alias("__address"), F.lit(True).alias("__c")).distinct()
    d = domains.where("curation = 'important'").select("account", F.col("domain").alias("__host"), F.lit(True).alias("__d")).distinct()
    rows = rows.join(c, ["account", "__address"], "left").join(d, ["account", "__host"], "left")
    return rows.withColumn("from_important", F.coalesce("__c", F.lit(False)) | F.coalesce("__d", F.lit(False))).drop("__address", "__host", "__c", "__d")


def user_threads(messages: DataFrame) -> DataFrame:
    return messages.where((F.col("direction") == "sent") & blank_to_null(F.col("thread_id")).isNotNull()).select("account", "thread_id").distinct()


def demotable(messages: DataFrame, contacts: DataFrame, domains: DataFrame, cutoff_ms: int) -> DataFrame:
    """Full bodies with an aged summary, of bulk senders that are not important, in threads the user took no part in."""
    aged = messages.where((F.col("body_state") == "full") & F.col("summary_text").isNotNull() & (F.col("summarized_at") <= cutoff_ms) & is_bulk())
    aged = important_senders(aged, contacts, domains).where("NOT from_important").drop("from_important")
    return aged.join(user_threads(messages), ["account", "thread_id"], "left_anti")


def demote(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen full bodies become summary-only and lose their text."""
    rows = messages.join(chosen.select("account", "gmail_message_id", F.lit(True).alias("__hit")).distinct(), ["account", "gmail_message_id"], "left")
    hit = F.col("__hit").isNotNull() & (F.col("body_state") == "full")
    return rows.withColumns({"body_text": F.when(~hit, F.col("body_text")), "body_state": F.when(hit, "summary-only").otherwise(F.col("body_state"))}).drop("__hit")


def evictable(messages: DataFrame, contacts: DataFrame, domains: DataFrame, cutoff_ms: int) -> DataFrame:
    """Full bodies before the cutoff, not of important senders, in threads the user took no part in."""
    aged = messages.where((F.col("body_state") == "full") & (F.col("internal_date") < cutoff_ms))
    aged = important_senders(aged, contacts, domains).where("NOT from_important").drop("from_important")
    return aged.join(user_threads(messages), ["account", "thread_id"], "left_anti")


def evict(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen bodies go; the state is summary-only with a summary, else meta."""
    rows = messages.join(chosen.select("account", "gmail_message_id", F.lit(True).alias("__hit")).distinct(), ["account", "gmail_message_id"], "left")
    hit = F.col("__hit").isNotNull()
    state = F.when(hit, F.when(F.col("summary_text").isNotNull(), "summary-only").otherwise("meta")).otherwise(F.col("body_state"))
    return rows.withColumns({"body_text": F.when(~hit, F.col("body_text")), "body_state": state}).drop("__hit")


def active_selector(rule: str | None = None, sender: str | None = None, match: list[str] | None = None) -> str | None:
    """Which rule holds: `direct` unless another is named or the selection is narrowed by sender or match."""
    return rule or (None if sender or match else "direct")


def select_backlog(messages: DataFrame, rule: str | None = None, sender: str | None = None, match: list[str] | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Metadata-only messages to enrich, newest first, by all the selectors given: rule (direct or all), sender's address, search terms, earliest date; of each account at most limit, with their rank."""
    rows = messages.where(F.col("body_state") == "meta")
    if active_selector(rule, sender, match) == "direct":
        rows = rows.where(is_direct())
    if sender:
        rows = rows.where(S.extract_address(F.col("from_addr")) == sender.lower())
    if since_ms is not None:
        rows = rows.where(F.col("internal_date") >= since_ms)
    if match:
        rows = rows.join(matching_terms(rows, match), ["account", "gmail_message_id"], "left_semi")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("account").orderBy(F.desc_nulls_last("internal_date"), "gmail_message_id")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def matching_terms(messages: DataFrame, terms: list[str]) -> DataFrame:
    """(account, gmail_message_id) of the messages that the search index finds for any term (stemmed, as a prefix)."""
    from .search import with_phrases

    return with_phrases(messages, [t.strip() for t in terms if t.strip()], prefix=True)


def with_terms(messages: DataFrame, terms: list[str]) -> DataFrame:
    """The messages that hold any term; of a stream by their own texts."""
    from .search import holds_phrase

    if messages.isStreaming:
        return holds_phrase(messages, [t.strip() for t in terms if t.strip()], prefix=True)
    return messages.join(matching_terms(messages, terms), ["account", "gmail_message_id"], "left_semi")


# --- trigger rules

# What conditions may name.
CATEGORIES = ["promotions", "social", "updates", "forums", "personal", "primary"]
CURATIONS = ["important", "muted", "blocked"]


def check_conditions(conditions: list[tuple[str, object]]) -> None:
    """ValueError unless a rule has conditions and each is valid."""
    if not conditions:
        raise ValueError("a rule needs a condition")
    for kind, value in conditions:
        if kind == "category":
            fine = value in CATEGORIES
        elif kind == "interest_profile":
            fine = value in CURATIONS
        elif kind in ("is_list", "correspondent"):
            fine = isinstance(value, bool)
        elif kind == "subject_fts":
            fine = isinstance(value, (list, tuple)) and any(isinstance(t, str) and t.strip() for t in value)
        elif kind in ("label", "from_addr", "from_domain"):
            fine = isinstance(value, str) and bool(value.strip())
        else:
            raise ValueError(f"no such condition: {kind}")
        if not fine:
            raise ValueError(f"not a value of {kind}: {value!r}")


def condition_column(kind: str, value, strict: bool = False) -> Column:
    """A trigger condition, all but subject_fts, over messages joined with contacts (msgs_sent, curation) and domains (domain_curation)."""
    sender = F.lower(F.coalesce("from_addr", F.lit(""))) if strict else S.extract_address(F.col("from_addr"))
    made = {
        "category": lambda: F.col("category") == value,
        "is_list": lambda: F.coalesce(F.col("is_list"), F.lit(False)) == F.lit(value),
        "correspondent": lambda: (F.coalesce("msgs_sent", F.lit(0)) > 0) == F.lit(value),
        "interest_profile": lambda: (F.col("curation") == value) | (F.col("domain_curation") == value),
        "label": lambda: F.array_contains("labels", value),
        "from_addr": lambda: sender == value.lower(),
        "from_domain": lambda: sender.endswith("@" + value.lower()),
    }
    return F.coalesce(made[kind](), F.lit(False))


def matching(messages: DataFrame, contacts: DataFrame, domains: DataFrame, conditions: list[tuple[str, object]], batch: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Messages (of a batch of ids, if given) that meet every condition; subject_fts asks the search index (stemmed prefixes over all its columns)."""
    check_conditions(conditions)
    rows = messages if batch is None else messages.join(batch, ["account", "gmail_message_id"], "left_semi")
    for kind, value in conditions:
        if kind == "subject_fts":
            rows = with_terms(rows, value)
    address = F.lower("from_addr") if strict else S.extract_address(F.col("from_addr"))
    rows = rows.withColumn("__address", address).withColumn("__host", S.host_of(F.col("__address")))
    c = contacts.select("account", F.col("address").alias("__address"), "msgs_sent", "curation")
    d = domains.select("account", F.col("domain").alias("__host"), F.col("curation").alias("domain_curation"))
    rows = rows.join(c, ["account", "__address"], "left").join(d, ["account", "__host"], "left")
    return rows.where(all_of([condition_column(k, v, strict) for k, v in conditions if k != "subject_fts"])).select(*messages.columns)
