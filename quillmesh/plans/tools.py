"""The public query API: 35 tools over an archive, as a registry name -> callable(archive, **args).

An `Archive` holds DataFrames: messages and the user's own marks (label edits, curations, categories,
keywords, summaries, settings, rules, consumers), which are stored (`operators.overlays`) and merged on read. Derived tables are
functions of these and are built when a tool asks for them. Tools that list return DataFrames, tools that look one thing up or
change an overlay return dictionaries. Nothing here reaches a network: tools that would fetch from a
provider read `archive.source` (message payloads at hand) or report that there is none.
"""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distill as D
from ..functions import images as I
from ..functions import scalars as S
from ..operators import graph, jobs as J, messages as M, rollups as R, runs, scoring, search
from ..operators.overlays import SYNC, Marks, Overlays
from ..session import shared_folder
from ..sources import payload
from . import composites as C

STALE_SECONDS = 3 * 3600
SYNC_ETA_SECONDS = 90


@dataclass
class Archive:
    spark: SparkSession
    messages: DataFrame
    own: dict[str, list[str]]
    now_ms: int
    overlays: Overlays | None = None  # the user's marks; without a store the archive gets one of its own
    label_names: dict[str, str] = field(default_factory=dict)
    runs: DataFrame | None = None
    jobs: DataFrame | None = None  # jobs.SCHEMA; where there is such a table, reads of a stale account ask for a sync
    auth_errors: dict[str, int] = field(default_factory=dict)  # account -> when its provider refused the grant
    metrics: DataFrame | None = None  # account, address, centrality, community_id: what build_graph found last
    source: DataFrame | None = None  # parsed payloads
    index: search.Matcher | None = None  # a stored index of the messages; without one searches read the texts

    def __post_init__(self) -> None:
        self.base = self.messages  # as the last sync left them
        self.overlays = self.overlays or Overlays(self.spark, shared_folder(self.spark, "overlays"))
        marks = lambda kind, single=False: Marks(self.overlays, kind, single)
        self.contact_curation, self.domain_curation, self.categories, self.thread_summaries = map(marks, ("contact_curation", "domain_curation", "category", "thread_summary"))
        self.keywords, self.settings, self.rules, self.consumers = (marks(kind, True) for kind in ("keywords", "settings", "rule", "consumer"))
        self.refresh()

    def refresh(self) -> None:
        """Messages with the label edits and summaries of now."""
        self.messages = self.overlays.on_messages(self.base)

    def put(self, marks: list[tuple[str, str, str, str, str | None]]) -> None:
        self.overlays.put(marks)
        self.refresh()

    def contacts(self) -> DataFrame:
        scored = scoring.score_contacts(R.contacts_rollup(self.messages, with_bulk=True), None, self.now_ms)
        if self.metrics is not None:
            scored = scored.join(self.metrics, ["account", "address"], "left")
        return scored.join(self.overlays.of("contact_curation", "address", "curation"), ["account", "address"], "left")

    def domains(self) -> DataFrame:
        rows = R.domains_rollup(R.contacts_rollup(self.messages))
        for kind, name in (("domain_curation", "curation"), ("category", "category")):
            rows = rows.join(self.overlays.of(kind, "domain", name), ["account", "domain"], "left")
        return rows

    def threads(self) -> DataFrame:
        return R.threads_rollup(self.messages).join(self.overlays.of("thread_summary", "thread_id", "summary"), ["account", "thread_id"], "left")

    def members(self) -> DataFrame:
        return graph.members(R.threads_rollup(self.messages), self.messages, R.contacts_rollup(self.messages))


def build_graph(archive: Archive) -> Archive:
    """The archive with the graph's metrics on its contacts, as of now."""
    people = archive.members()
    found = graph.edges(people)
    out = copy.copy(archive)
    out.metrics = graph.pagerank(people, found).join(graph.louvain(people, found).select("account", "address", "community_id"), ["account", "address"], "full_outer")
    return out


Tool = Callable[..., Any]
TOOLS: dict[str, Tool] = {}


def tool(f: Tool) -> Tool:
    TOOLS[f.__name__] = f
    return f


def call(archive: Archive, name: str, **args: Any) -> dict:
    """A tool's result with the freshness of the index; of a single account that is stale and idle, a sync is asked for."""
    if name not in TOOLS:
        raise KeyError(f"no such tool: {name}")
    account = args.get("account") or (next(iter(archive.own)) if len(archive.own) == 1 else None)
    result, state = TOOLS[name](archive, **args), freshness(archive, account)
    out = {"result": result, "freshness": state}
    if account and _can_queue(archive) and state["stale"] and not state["syncing"] and state["auth"] == "ok":
        started = request_sync(archive, account, state["age_seconds"])
        state |= {"syncing": True, "refresh_command": started}
        out |= {"sync_started": True, "eta_seconds": SYNC_ETA_SECONDS}
    return out


def _can_queue(archive: Archive) -> bool:
    return archive.jobs is not None and {"id", "params", "started_at"} <= set(archive.jobs.columns)


def request_sync(archive: Archive, account: str, age_seconds: int | None) -> dict:
    """A sync job of the account, from a day before its last one; one that was never synced is read whole. A live job is shared."""
    since = None if age_seconds is None else f"{-(-age_seconds // 86_400) + 1}d"
    wanted = archive.spark.createDataFrame([("sync", account, json.dumps({"since": since} if since else {}))], "kind string, account string, params string")
    archive.jobs, answers = J.enqueue(archive.jobs, wanted, archive.now_ms)
    return {"job_id": answers.first()["id"], "status": "queued", "poll": "sync_status"}


def freshness(archive: Archive, account: str | None = None) -> dict:
    """When the index was last synced without an error (of several accounts the oldest), whether that is stale or a sync runs, and the grant's state."""
    failed = archive.auth_errors.get(account) if account else min(archive.auth_errors.values(), default=None)
    auth = "ok" if failed is None else "needs_reauth"
    command = {"kind": "reauth", "account": account, "status": "blocked", "reason": "invalid_grant"} if failed is not None and account else {"kind": "sync", "account": account, "status": "available", "poll": "sync_status"}
    state = {"index_as_of": None, "age_seconds": None, "age": S.format_age(None), "stale": True, "syncing": False, "auth": auth, "auth_failed_at": failed, "refresh_command": command}
    if archive.runs is None:
        return state
    rows = R.index_as_of(archive.runs).where(F.col("account").eqNullSafe(F.lit(account))).collect()
    as_of = rows[0]["as_of"] if rows else None
    age = None if as_of is None else max(0, (archive.now_ms - as_of) // 1000)
    syncing = account is not None and "id" in archive.runs.columns and not runs.active_runs(_of(archive.runs, account), archive.now_ms).isEmpty()
    return state | {"index_as_of": as_of, "age_seconds": age, "age": S.format_age(age), "stale": age is None or age > STALE_SECONDS, "syncing": syncing}


def _of(rows: DataFrame, account: str | None) -> DataFrame:
    return rows if account is None else rows.where(F.col("account") == account)


def _hits(rows: DataFrame, *more: str) -> DataFrame:
    snippet = S.compact_snippet(F.col("snippet")) if "snippet" in rows.columns else F.lit(None).cast("string")
    return rows.select(S.message_ref(F.col("account"), F.col("gmail_message_id")).alias("ref"), "account", "thread_id", "internal_date", "from_addr", *[c for c in ("subject",) if c in rows.columns], snippet.alias("snippet"), "labels", "unread", "body_state", *more)


def _message(archive: Archive, ref: str) -> DataFrame:
    account, sep, key = ref.partition(":")
    if not (account and sep and key):
        raise ValueError(f"not a reference: {ref}")
    return archive.messages.where((F.col("account") == account) & (F.col("gmail_message_id") == key))


def _one(rows: DataFrame, ref: str) -> dict:
    found = rows.limit(1).collect()
    if not found:
        raise KeyError(f"not in the index: {ref}")
    return found[0].asDict()


# --- search and messages


@tool
def search_(archive: Archive, query: str, account: str | None = None, limit: int = 15) -> DataFrame:
    messages = _of(archive.messages, account)
    hits = (archive.index or search.index_of_messages(messages)).search(search.expand_query(query.split()))
    best = messages.withColumn("docid", S.message_ref(F.col("account"), F.col("gmail_message_id"))).join(hits, "docid").orderBy("score", F.desc("internal_date"), "docid").limit(limit)
    return _hits(best, "score").orderBy("score", F.desc("internal_date"), "ref")


TOOLS["search"] = TOOLS.pop("search_")


@tool
def list_labeled(archive: Archive, label: str, account: str | None = None, limit: int = 15) -> DataFrame:
    ids = {name.lower(): i for i, name in archive.label_names.items()}
    wanted = ids.get(label.lower(), label) if account else label
    return _hits(_of(archive.messages, account).where(F.array_contains("labels", wanted)).orderBy(F.desc("internal_date"), "gmail_message_id").limit(limit))


@tool
def refresh_inbox(archive: Archive, account: str, live_ids: list[str], limit: int = 15) -> dict:
    live = archive.spark.createDataFrame([(account, i) for i in live_ids], "account string, gmail_message_id string")
    changes = M.reconcile(_of(archive.messages, account), live)
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    moved = F.when(F.col("change") == "restored", "add").otherwise("remove")
    archive.overlays.put_rows(changes.where("change <> 'added'").select(F.lit("label").alias("kind"), "account", F.col("gmail_message_id").alias("key"), F.lit("INBOX").alias("item"), moved.alias("value")))
    archive.refresh()
    return counts | {"inbox": list_labeled(archive, "INBOX", account, limit)}


@tool
def get_message(archive: Archive, ref: str, level: str = "meta") -> dict:
    rows = _message(archive, ref)
    row = _one(rows, ref)
    if level == "body" and row["body_state"] == "meta" and archive.source is not None:
        found = payload.bodies(archive.source.where(F.col("id") == row["gmail_message_id"])).withColumn("body", D.distill(F.col("text"), F.col("html"))).limit(1).collect()
        if found:
            row |= {"body_text": found[0]["body"], "body_state": "full"}
            images = I.classify_images(I.parse_images(archive.spark.createDataFrame([(ref, found[0]["html"])], "ref string, html string")))
            best = [r.asDict() for r in I.ocr_candidates(images, ["ref"]).orderBy("rank").collect()]
            row["ocrImages"] = best
            row["needsOcr"] = bool(archive.spark.range(1).select(D.is_image_only(F.lit(found[0]["body"]), F.lit(len(best))).alias("x")).first()["x"])
    return row


@tool
def get_message_attachment(archive: Archive, ref: str, attachment: str) -> dict:
    """By id, else by name in any case."""
    if archive.source is None:
        raise LookupError("no payloads at hand")
    found = payload.attachments(archive.source.where(F.col("id") == ref.partition(":")[2])).collect()
    match = [r for r in found if r["attachment_id"] == attachment] or [r for r in found if r["filename"].lower() == attachment.lower()]
    if not match:
        raise KeyError(f"no such attachment: {attachment}")
    if match[0]["size_bytes"] > payload.MAX_ATTACHMENT:
        raise ValueError("the attachment is too large")
    return match[0].asDict()


@tool
def modify_labels(archive: Archive, ref: str, add: list[str] | None = None, remove: list[str] | None = None) -> dict:
    account, _, key = ref.partition(":")
    _one(_message(archive, ref), ref)
    words = {**dict.fromkeys(remove or [], "remove"), **dict.fromkeys(add or [], "add")}
    archive.put([("label", account, key, label, word) for label, word in words.items()])
    return _one(_message(archive, ref), ref)


@tool
def archive_message(archive: Archive, ref: str) -> dict:
    return modify_labels(archive, ref, remove=["INBOX"])


@tool
def get_thread(archive: Archive, account: str, thread_id: str) -> dict:
    row = _one(archive.threads().where((F.col("account") == account) & (F.col("thread_id") == thread_id)), thread_id)
    return row | {"messages": _hits(_of(archive.messages, account).where(F.col("thread_id") == thread_id)).orderBy("internal_date", "ref")}


@tool
def list_threads(archive: Archive, account: str | None = None, contact: str | None = None, query: str | None = None, limit: int = 20) -> DataFrame:
    rows = _of(archive.threads(), account)
    if contact:
        rows = rows.where(F.array_contains("participants", contact.lower()))
    elif query:
        named = search.with_phrases(archive.messages, query.split(), archive.index, prefix=True)
        found = archive.messages.join(named, ["account", "gmail_message_id"], "left_semi").select("account", "thread_id").distinct()
        rows = rows.join(found, ["account", "thread_id"], "left_semi")
    else:
        raise ValueError("a contact or a query is needed")
    return rows.orderBy(F.desc_nulls_last("last_at"), "thread_id").limit(limit)


# --- people


@tool
def list_contacts(archive: Archive, account: str | None = None, only: str | None = None, sort: str = "engagement", limit: int = 20) -> DataFrame:
    if sort == "community" and archive.metrics is None:
        archive = build_graph(archive)
    return C.list_contacts(_of(archive.contacts(), account), only, sort, limit)


@tool
def get_contact(archive: Archive, address: str, account: str | None = None) -> dict:
    """The contact and its threads; else the nearest candidates."""
    rows = _of(archive.contacts(), account)
    found = rows.where(F.col("address") == address.lower()).limit(1).collect()
    if not found:
        return {"contact": None, "candidates": C.find_person(rows, address)}
    return {"contact": found[0].asDict(), "threads": list_threads(archive, account, contact=address)}


@tool
def find_person(archive: Archive, hint: str, account: str | None = None, limit: int = 10) -> DataFrame:
    return C.find_person(_of(archive.contacts(), account), hint, limit)


@tool
def graph_neighbors(archive: Archive, address: str, account: str | None = None, limit: int = 15) -> dict:
    found = graph.neighbours_of(_of(archive.members(), account), address.lower(), limit)
    if found.isEmpty():
        near = C.find_person(_of(archive.contacts(), account), address, limit).select("account", F.lit(address).alias("address"), F.col("address").alias("neighbour"), F.lit(0).cast("long").alias("shared_threads"), "rank")
        return {"neighbors": near, "fallback": True}
    return {"neighbors": found, "fallback": False}


@tool
def graph_communities(archive: Archive, account: str | None = None, top: int = 5) -> DataFrame:
    people = _of(archive.members(), account)
    found = graph.edges(people)
    return graph.community_summary(graph.louvain(people, found), graph.pagerank(people, found), top)


# --- settings, onboarding, curation


@tool
def settings_get(archive: Archive, account: str) -> dict:
    return S.normalize_settings(archive.settings.get(account))


@tool
def settings_set(archive: Archive, account: str, **patch: Any) -> dict:
    unknown = set(patch) - set(S.SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    archive.settings[account] = S.normalize_settings({**settings_get(archive, account), **patch})
    return archive.settings[account]


@tool
def backfill_bodies(archive: Archive, account: str) -> dict:
    cutoff = S.window_cutoff(settings_get(archive, account)["body_window_months"], dt.datetime.fromtimestamp(archive.now_ms / 1000, dt.UTC))
    rows = _of(archive.messages, account).where("body_state = 'meta'")
    return {"account": account, "cutoff_ms": cutoff, "pending": (rows if cutoff is None else rows.where(F.col("internal_date") >= cutoff)).count()}


# The steps of the guided first run in their order, and the answers that each offers.
ONBOARDING = {
    "accounts": ["yes"],
    "retention": [3, 6, 12, 0],
    "interests": ["propose", "skip"],
    "backfill": ["now", "skip"],
}


@tool
def onboarding(archive: Archive, account: str, step: str | None = None, answer: str | int | None = None) -> dict:
    """The guided first run: stores the answer to a step and returns the next one with its question and options. Once the last is answered it stays done."""
    if step is not None and step not in ONBOARDING:
        raise ValueError(f"no such step: {step}")
    if step == "retention" and answer is not None:
        settings_set(archive, account, body_window_months=int(answer), retention="window" if int(answer) > 0 else "off")
    pending = None
    if step == "backfill" and answer is not None:
        pending = None if answer == "skip" else backfill_bodies(archive, account)["pending"]
        settings_set(archive, account, onboarding_completed_at=dt.datetime.fromtimestamp(archive.now_ms / 1000, dt.UTC).isoformat())
    settings, names = settings_get(archive, account), list(ONBOARDING)
    done = len(names) if settings["onboarding_completed_at"] else names.index(step) + 1 if step else 0
    months = settings["body_window_months"]
    questions = {
        "accounts": f"{account} is indexed. Go on to how much of it stays readable at once?",
        "retention": "For how many months are whole bodies kept? Headers and snippets always are.",
        "interests": "Which senders and topics keep their bodies for longer?",
        "backfill": f"Fetch the missing bodies of the last {months} months now?",
    }
    at = names[done] if done < len(names) else "done"
    return {
        "step": at, "question": questions.get(at, "Setup is complete."), "options": ONBOARDING.get(at, []), "remaining_steps": names[done + 1 :],
        "progress": {"done": min(done, len(names)), "total": len(names)}, "pending_bodies": pending,
    }


@tool
def interest_propose(archive: Archive, account: str | None = None, limit: int = 20) -> DataFrame:
    return scoring.propose_contacts(_of(archive.contacts(), account), limit)


@tool
def interest_set(archive: Archive, account: str, contacts: dict[str, str | None] | None = None, domains: dict[str, str | None] | None = None, keywords: list[str] | None = None) -> dict:
    """All or nothing: values are checked before any is stored, and stored as one transaction."""
    chosen = {**(contacts or {}), **(domains or {})}
    if bad := [v for v in chosen.values() if v not in (None, "important", "muted", "blocked")]:
        raise ValueError(f"not a curation: {bad[0]}")
    known = {r["address"] for r in R.contacts_rollup(_of(archive.messages, account)).where(F.col("address").isin([a.lower() for a in contacts or {}])).select("address").collect()} if contacts else set()
    marks = [archive.contact_curation.mark((account, k.lower()), v) for k, v in (contacts or {}).items() if k.lower() in known]
    marks += [archive.domain_curation.mark((account, k), v) for k, v in (domains or {}).items()]
    if keywords is not None:
        marks.append(archive.keywords.mark(account, S.parse_keywords(",".join(keywords))))
    archive.overlays.put(marks)
    return interest_get(archive, account)


@tool
def interest_get(archive: Archive, account: str) -> dict:
    pick = lambda stored: {k: v for (_, k), v in stored.items(account)}
    return {"contacts": pick(archive.contact_curation), "domains": pick(archive.domain_curation), "keywords": archive.keywords.get(account, [])}


# --- summaries and categories


@tool
def save_summary(archive: Archive, text: str, ref: str | None = None, account: str | None = None, thread_id: str | None = None) -> dict:
    if not text.strip():
        raise ValueError("an empty summary")
    if ref:
        row = _one(_message(archive, ref), ref)
        at = (row["account"], row["gmail_message_id"])
        archive.put([("summary", *at, "text", text.strip()), ("summary", *at, "at", str(archive.now_ms))])
        return {"ref": ref}
    _one(R.threads_rollup(_of(archive.messages, account)).where(F.col("thread_id") == thread_id), str(thread_id))
    archive.thread_summaries[(account, thread_id)] = text.strip()
    return {"thread_id": thread_id}


@tool
def domains_to_categorize(archive: Archive, account: str | None = None, limit: int = 20) -> DataFrame:
    contacts = _of(archive.contacts(), account)
    rows = C.domains_to_categorize(contacts, _of(archive.domains(), account), limit)
    return rows.join(C.domain_samples(contacts), ["account", "domain"], "left").orderBy("account", "rank")


@tool
def save_domain_category(archive: Archive, account: str, domain: str, category: str) -> dict:
    if not category.strip():
        raise ValueError("an empty category")
    archive.categories[(account, domain.strip().lower())] = category.strip()
    return {"domain": domain.strip().lower(), "category": category.strip()}


@tool
def cadence(archive: Archive, account: str | None = None, since: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    since_ms = S.parse_since(since, archive.now_ms) if since else None
    rows = R.cadence(_of(archive.messages, account), since_ms, category, archive.domains() if category else None).orderBy(F.desc("msgs"), "domain")
    return rows if limit is None else rows.limit(limit)


# --- status


@tool
def sync_status(archive: Archive) -> DataFrame:
    """Each account's body states, and as far as runs and jobs are known its freshness, live run, queue depth and newest sync job."""
    states = R.body_state_counts(archive.messages)
    if archive.runs is not None:
        states = states.join(R.index_as_of(archive.runs).where("account IS NOT NULL"), "account", "left")
        if "id" in archive.runs.columns:
            states = states.join(runs.active_runs(archive.runs, archive.now_ms).withColumnRenamed("id", "active_run"), "account", "left")
    return states if archive.jobs is None else states.join(runs.queue_status(archive.jobs), "account", "left")


@tool
def relay_menu_status(archive: Archive) -> dict:
    """Counts, whether any account syncs now, and the least fresh account's age."""
    counts = archive.messages.agg(F.count("*").alias("messages"), F.countDistinct("account").alias("accounts")).first().asDict()
    syncing = archive.runs is not None and "id" in archive.runs.columns and not runs.active_runs(archive.runs, archive.now_ms).isEmpty()
    oldest = None if archive.runs is None else R.index_as_of(archive.runs).where("account IS NOT NULL").agg(F.min("as_of")).first()[0]
    return counts | freshness(archive) | {"any_syncing": syncing, "oldest_as_of": oldest}


@tool
def sync_now(archive: Archive, account: str) -> dict:
    """Asks for a sync, if there is a table of jobs and the grant holds; what runs the jobs reads it there."""
    if account in archive.auth_errors:
        return {"account": account, "started": False, "reason": "the provider refused the grant; renew it"}
    if not _can_queue(archive):
        return {"account": account, "started": False, "reason": "no provider is connected; use quillmesh.streaming.ingest"}
    return {"account": account, "started": True, **request_sync(archive, account, freshness(archive, account)["age_seconds"])}


@tool
def catch_up(archive: Archive, account: str, since: str = "1d") -> dict:
    cutoff, rows = S.parse_since(since, archive.now_ms), _of(archive.messages, account)
    words = archive.keywords.get(account, [])
    return {
        "from_important": _hits(C.catch_up_important(rows, archive.contacts(), archive.domains(), cutoff)),
        "user_threads": _hits(C.catch_up_user_threads(rows, cutoff)),
        "keywords": _hits(C.catch_up_keywords(rows, words, cutoff, index=archive.index)) if words else None,
    }


@tool
def digest_sources(archive: Archive, account: str, since: str = "7d", limit: int = 20) -> DataFrame:
    return C.digest_sources(_of(archive.messages, account), _of(archive.contacts(), account), S.parse_since(since, archive.now_ms), limit)


# --- rules


@tool
def trigger_rule_save(archive: Archive, rule_id: str, account: str, conditions: list[tuple[str, Any]], consumers: list[str] | None = None, enabled: bool = True) -> dict:
    M.check_conditions(conditions)
    if unknown := [c for c in consumers or [] if c not in archive.consumers]:
        raise ValueError(f"no such consumer: {unknown[0]}")
    archive.rules[rule_id] = {"id": rule_id, "account": account, "conditions": list(conditions), "consumers": consumers or [], "enabled": enabled}
    return archive.rules[rule_id]


@tool
def trigger_rule_list(archive: Archive, account: str | None = None) -> list[dict]:
    return [r for _, r in sorted(archive.rules.items()) if account in (None, r["account"])]


@tool
def trigger_rule_delete(archive: Archive, rule_id: str) -> dict:
    return {"deleted": archive.rules.pop(rule_id, None) is not None}


@tool
def webhook_consumer_register(archive: Archive, consumer_id: str, url: str, secret: str = "") -> dict:
    """The secret signs deliveries (`signature`) and is never returned."""
    if not url.startswith("https://"):
        raise ValueError("a consumer needs an https address")
    archive.consumers[consumer_id] = {"id": consumer_id, "url": url, "secret": secret}
    return {"id": consumer_id, "url": url, "signed": bool(secret)}


@tool
def webhook_consumer_delete(archive: Archive, consumer_id: str) -> dict:
    return {"deleted": archive.consumers.pop(consumer_id, None) is not None}


def signature(secret: str, body: str) -> str:
    """The HMAC-SHA256 of a delivery's body, in hexadecimal digits."""
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def fired(archive: Archive, batch: DataFrame) -> dict[str, DataFrame]:
    """Per enabled rule the messages of a batch (account, gmail_message_id) that match it."""
    contacts, domains = archive.contacts(), archive.domains()
    return {k: M.matching(_of(archive.messages, r["account"]), contacts, domains, r["conditions"], batch) for k, r in archive.rules.items() if r["enabled"]}


def with_messages(archive: Archive, messages: DataFrame) -> Archive:
    """The archive after a sync: its labels are the provider's, so earlier label edits count no more; other marks do."""
    archive.overlays.put([(SYNC, "", "", "", "done")])
    return replace(archive, messages=messages)
