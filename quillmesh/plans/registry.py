"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import distill as D
from ..functions import images as I
from ..functions import scalars as S
from ..operators import feed as feed_ops
from ..operators import graph, jobs, messages as M, rollups as R, runs, scoring, search
from ..operators.overlays import Overlays
from ..operators.stored_index import StoredIndex
from ..session import Stage, shared_folder
from ..sources.mailbox import MAILBOX_SQL, PEOPLE_SQL, mailbox, table
from ..sources import datasource, ndjson, payload
from ..sources.attachment_store import AttachmentStore
from ..sources.provider import TableSource
from ..streaming.ingest import VersionedTable, session_counts, windowed_counts
from ..streaming import kept_feed
from ..streaming.kept import KeptRollups
from ..streaming.kept_feed import KeptFeed
from . import composites as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_MS = 915_148_800_000  # 1999-01-01
SINCE_MS = 883_612_800_000  # 1998-01-01
DAY = 86_400_000.0


def query(sql: str | None = None, ctes: str = MAILBOX_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {ctes}{',' if ctes else ''} {sql.strip()}" if ctes else sql.strip()
        return f

    return add


# --- SQL fragments

ADDR = "lower(nullif(regexp_extract(coalesce(nullif(regexp_extract({0}, '<([^>]+)>', 1), ''), {0}), '[^\\s<>@]+@[^\\s<>@]+', 0), ''))"
NAME = "CASE WHEN instr({0}, '<') > 1 THEN nullif(trim(split_part({0}, '<', 1)), '') END"
HOST = "nullif(lower(regexp_extract({0}, '@([^@]*)$', 1)), '')"
BRAND = "CASE WHEN len(string_split({0}, '.')) <= 2 THEN {0} ELSE array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.') END"

ROLLUP_SQL = f"""
rcv AS (SELECT account, {ADDR.format("from_addr")} AS address, {NAME.format("from_addr")} AS name, thread_id, internal_date AS d, gmail_message_id AS id, 0 AS pos, 1 - unread AS rd, starred, important FROM mb WHERE direction <> 'sent'),
rc AS (SELECT rcv.* FROM rcv WHERE address IS NOT NULL AND address NOT LIKE 'me@%'),
sraw AS (SELECT account, thread_id, internal_date AS d, gmail_message_id AS id, 0 AS pos, to_addr AS raw FROM mb WHERE direction = 'sent' UNION ALL SELECT account, thread_id, internal_date, gmail_message_id, 1, cc_addr FROM mb WHERE direction = 'sent' AND cc_addr IS NOT NULL),
sn AS (SELECT account, {ADDR.format("raw")} AS address, {NAME.format("raw")} AS name, thread_id, d, id, pos FROM sraw),
ff AS (SELECT account, thread_id, address, min((d, id)) AS f FROM rc GROUP BY ALL), fi AS (SELECT account, thread_id, min((internal_date, gmail_message_id)) AS f FROM mb GROUP BY ALL),
ev AS (SELECT account, address, name, d, id, pos, 1 AS received, 0 AS sent, rd, starred, important, 0 AS replied, 0 AS initiated FROM rc UNION ALL
  SELECT sn.account, sn.address, name, d, id, pos, 0, 1, 0, 0, 0, coalesce(ff.f < (d, id), FALSE)::INT, (NOT coalesce(ff.f < (d, id), FALSE) AND fi.f = (d, id))::INT
  FROM sn LEFT JOIN ff USING (account, thread_id, address) LEFT JOIN fi USING (account, thread_id)),
contacts AS (SELECT account, address, arg_min(name, (d, id, pos)) FILTER (name IS NOT NULL) AS display_name, sum(received)::BIGINT AS msgs_received, sum(sent)::BIGINT AS msgs_sent, sum(rd)::BIGINT AS read_count, sum(replied)::BIGINT AS replied_count,
  sum(initiated)::BIGINT AS initiated_count, sum(starred)::BIGINT AS starred_count, sum(important)::BIGINT AS important_count, min(d) AS first_seen, max(d) AS last_seen, {HOST.format("address")} AS domain FROM ev GROUP BY account, address),
domains AS (SELECT account, domain, sum(msgs_received + msgs_sent)::BIGINT AS msgs, count(*) AS distinct_contacts, {BRAND.format("domain")} AS registrable_domain FROM contacts GROUP BY account, domain),
part AS (SELECT DISTINCT account, thread_id, address FROM (SELECT account, thread_id, address FROM rc UNION ALL SELECT account, thread_id, address FROM sn UNION ALL SELECT account, thread_id, lower(from_addr) FROM mb WHERE direction = 'sent')),
pl AS (SELECT account, thread_id, list(address ORDER BY address) AS participants FROM part GROUP BY ALL),
threads AS (SELECT mb.account, mb.thread_id, count(*) AS msg_count, sum(unread)::BIGINT AS unread_count, max((direction = 'sent')::INT) AS user_participated, min(internal_date) AS first_at, max(internal_date) AS last_at FROM mb GROUP BY ALL),
bulk AS (SELECT account, {ADDR.format("from_addr")} AS address, count(*) AS bulk_count FROM mb WHERE direction = 'received' AND (is_list OR coalesce(category IN ('promotions', 'social'), FALSE)) GROUP BY ALL),
sc AS (SELECT c.*, coalesce(b.bulk_count, 0) AS bulk_count, msgs_received + msgs_sent AS vol FROM contacts c LEFT JOIN bulk b USING (account, address)),
scored AS (SELECT *, 3.0 * (replied_count / (replied_count + 3.0)) + 3.0 * (initiated_count / (initiated_count + 3.0)) + starred_count / (starred_count + 3.0) + 1.5 * (important_count / (important_count + 3.0))
  + CASE WHEN msgs_received > 0 THEN 1.5 * least(1.0, read_count / msgs_received) ELSE 0.0 END
  + CASE WHEN vol > 0 THEN 0.5 * pow(0.5, greatest(0.0, ({NOW_MS} - last_seen) / {DAY}) / 60.0) * (vol / (vol + 10.0)) ELSE 0.0 END
  + CASE WHEN msgs_received > 0 THEN -2.0 * least(1.0, bulk_count / msgs_received) ELSE 0.0 END
  + CASE WHEN msgs_received > 0 AND read_count = 0 AND replied_count = 0 AND initiated_count = 0 THEN -2.0 ELSE 0.0 END AS engagement_score FROM sc),
cur AS (SELECT *, CASE WHEN engagement_score >= 3.0 THEN 'important' WHEN engagement_score <= -0.5 THEN 'muted' END AS curation FROM scored),
dcur AS (SELECT *, CASE WHEN distinct_contacts % 7 = 0 THEN 'important' END AS curation FROM domains),
mem AS (SELECT account, thread_id, address FROM part SEMI JOIN contacts USING (account, address) ANTI JOIN (SELECT DISTINCT account, thread_id FROM mb WHERE is_list) l USING (account, thread_id)),
edges AS (SELECT a.account, a.address AS src, b.address AS dst, count(*) AS weight FROM mem a JOIN mem b ON a.account = b.account AND a.thread_id = b.thread_id AND a.address < b.address GROUP BY ALL),
both_ways AS (SELECT * FROM edges UNION ALL SELECT account, dst, src, weight FROM edges)"""
FULL = MAILBOX_SQL + "," + ROLLUP_SQL


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contacts_rollup(mailbox(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_of(mailbox(spark, sf_dir))


def _scored_of(m: DataFrame) -> DataFrame:
    return scoring.score_contacts(R.contacts_rollup(m, with_bulk=True), None, NOW_MS)


def _curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _curated_of(_scored(spark, sf_dir))


def _curated_of(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    score = F.col("engagement_score")
    domains = R.domains_rollup(scored).withColumn("curation", F.when(F.col("distinct_contacts") % 7 == 0, "important"))
    return scored.withColumn("curation", F.when(score >= 3.0, "important").when(score <= -0.5, "muted")), domains


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.members_of(mailbox(spark, sf_dir), Stage(spark, "members"))


# --- sources and projections


@query("SELECT account, gmail_message_id, thread_id, internal_date, from_addr, to_addr, cc_addr, array_to_string(labels, ',') AS labels, category, is_list, direction, unread, starred, important, body_state FROM mb")
def mailbox_projection(spark, sf_dir):
    return mailbox(spark, sf_dir).withColumn("labels", F.array_join("labels", ",")).drop("own", "key")


@query(f"SELECT gmail_message_id, {ADDR.format('from_addr')} AS address, {NAME.format('from_addr')} AS display_name, {HOST.format(ADDR.format('from_addr'))} AS host FROM mb")
def address_parts(spark, sf_dir):
    m = mailbox(spark, sf_dir).withColumn("address", S.extract_address(F.col("from_addr")))
    return m.select("gmail_message_id", "address", S.display_name(F.col("from_addr")).alias("display_name"), S.host_of(F.col("address")).alias("host"))


@query(f"SELECT DISTINCT host, {BRAND.format('host')} AS brand FROM (SELECT {HOST.format('address')} AS host FROM ppl)", PEOPLE_SQL)
def registrable_domain(spark, sf_dir):
    from ..sources.mailbox import people

    return people(spark, sf_dir).select(S.host_of(F.col("address")).alias("host")).distinct().withColumn("brand", S.registrable_domain(F.col("host")))


@query(
    "SELECT gmail_message_id, len(list_filter(string_split(coalesce(to_addr, '') || ',' || coalesce(cc_addr, ''), ','), lambda x: trim(x) <> '')) AS recipients, nullif(concat_ws(' ', nullif(to_addr, ''), nullif(cc_addr, '')), '') AS projected FROM mb"
)
def recipients_projection(spark, sf_dir):
    both = F.concat_ws(",", F.coalesce("to_addr", F.lit("")), F.coalesce("cc_addr", F.lit("")))
    return mailbox(spark, sf_dir).select("gmail_message_id", F.size(S.split_recipients(both)).cast("long").alias("recipients"), S.project_recipients(F.col("to_addr"), F.col("cc_addr")).alias("projected"))


@query("SELECT gmail_message_id, nullif(concat_ws(chr(10), nullif(snippet, ''), nullif(body_text, ''), nullif(summary_text, '')), '') AS body FROM mt")
def body_projection(spark, sf_dir):
    return mailbox(spark, sf_dir, True).select("gmail_message_id", S.project_body(F.col("snippet"), F.col("body_text"), F.col("summary_text")).alias("body"))


@query("SELECT account || ':' || gmail_message_id AS ref, CASE WHEN length(f) > 160 THEN rtrim(substr(f, 1, 159)) || '…' WHEN f <> '' THEN f END AS snippet FROM (SELECT account, gmail_message_id, trim(regexp_replace(snippet, '[ \\t\\n\\r]+', ' ', 'g')) AS f FROM mt)")
def hit_shape(spark, sf_dir):
    return mailbox(spark, sf_dir, True).select(S.message_ref(F.col("account"), F.col("gmail_message_id")).alias("ref"), S.compact_snippet(F.col("snippet")).alias("snippet"))


@query("SELECT category, direction, count(*) AS n FROM mb GROUP BY ALL")
def category_counts(spark, sf_dir):
    return mailbox(spark, sf_dir).groupBy("category", "direction").agg(F.count("*").alias("n"))


@query("SELECT gmail_message_id, array_to_string(list_transform(labels, lambda x: CASE x WHEN 'INBOX' THEN 'Inbox' WHEN 'STARRED' THEN 'Starred' ELSE x END), '|') AS names FROM mb")
def label_names(spark, sf_dir):
    names = F.create_map(*map(F.lit, ("INBOX", "Inbox", "STARRED", "Starred")))
    return mailbox(spark, sf_dir).select("gmail_message_id", F.array_join(S.render_labels(F.col("labels"), names), "|").alias("names"))


@query("SELECT item_id, CASE WHEN len(string_split(text, ' ')) > 20 THEN 'long' ELSE 'short' END AS kind, length(regexp_replace(text, '\\s+', '', 'g')) AS visible FROM benchmark", "")
def meaningful_length(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(F.size(F.split("text", " ")) > 20, "long").otherwise("short").alias("kind"), D.meaningful_length(F.col("text")).alias("visible"))


@query()
def distill_pages(spark, sf_dir):
    """HTML to prose; Java and RE2 expressions differ, so it is tested against fixtures."""
    return table(spark, sf_dir, "pages").select("page_id", D.distill(F.lit(None).cast("string"), F.col("html")).alias("body"))


@query(
    "SELECT doc_id, array_to_string(list_filter(CASE WHEN f IS NULL THEN ls ELSE list_slice(ls, 1, f - 1) END, lambda x: NOT regexp_matches(x, '^\\s*>+')), chr(10)) AS body FROM (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: "
    "regexp_matches(x, '(?i)unsubscribe|^--\\s*$|^\\s*From:\\s.+$|all rights reserved')), TRUE) AS f FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE length(body) >= 0",
    "",
)
def deboilerplate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.deboilerplate(F.col("text")).alias("body"))


# --- filters and small aggregates


@query("SELECT account, gmail_message_id, internal_date FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY internal_date DESC, gmail_message_id) AS r FROM mb WHERE list_contains(labels, 'STARRED')) WHERE r <= 15")
def list_labeled(spark, sf_dir):
    return C.newest(M_filter_label(mailbox(spark, sf_dir), "STARRED"), 15).select("account", "gmail_message_id", "internal_date")


def M_filter_label(m: DataFrame, label: str) -> DataFrame:
    return m.where(F.array_contains("labels", label))


@query("SELECT account, count(*) AS n FROM mb WHERE NOT is_list AND (category IS NULL OR category NOT IN ('promotions', 'social')) AND body_state = 'meta' GROUP BY account")
def direct_backlog(spark, sf_dir):
    return mailbox(spark, sf_dir).where(M.is_direct() & (F.col("body_state") == "meta")).groupBy("account").agg(F.count("*").alias("n"))


@query("SELECT account, count(*) FILTER (body_state = 'meta') AS meta, count(*) FILTER (body_state = 'full') AS \"full\", count(*) FILTER (body_state = 'summary-only') AS summary_only, count(*) AS messages FROM mb GROUP BY account")
def body_state_counts(spark, sf_dir):
    return R.body_state_counts(mailbox(spark, sf_dir))


@query("SELECT account FROM (SELECT account FROM mb UNION SELECT account FROM contacts UNION SELECT event_type FROM events) ORDER BY account", FULL)
def account_discovery(spark, sf_dir):
    synced = table(spark, sf_dir, "events").select(F.col("event_type").alias("account"))
    return runs.discover_accounts(mailbox(spark, sf_dir), _contacts(spark, sf_dir), synced).orderBy("account")


RUNS = "runs AS (SELECT event_type AS account, epoch_us(ts) // 1000 AS finished_at, CASE WHEN event_id % 5 = 0 THEN 'failed' END AS error FROM events), lastrun AS (SELECT account, max(finished_at) AS as_of FROM runs WHERE error IS NULL GROUP BY account)"


@query("SELECT account, as_of FROM lastrun UNION ALL SELECT NULL, min(as_of) FROM lastrun", RUNS)
def index_as_of(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("account"), F.unix_millis(F.col("ts").cast("timestamp")).alias("finished_at"), F.when(F.col("event_id") % 5 == 0, "failed").alias("error"))
    return R.index_as_of(runs)


@query(f"SELECT account, {BRAND.format('host')} AS domain, count(*) AS msgs, count(DISTINCT sender) AS senders, min(internal_date) AS first_ms, max(internal_date) AS last_ms, round(count(*) * 7 / greatest(1.0, (max(internal_date) - min(internal_date)) / {DAY}), 6) AS per_week, "
       f"round(count(*) * 30 / greatest(1.0, (max(internal_date) - min(internal_date)) / {DAY}), 6) AS per_month FROM (SELECT account, internal_date, {ADDR.format('from_addr')} AS sender, {HOST.format(ADDR.format('from_addr'))} AS host FROM mb WHERE direction = 'received') GROUP BY account, {BRAND.format('host')}")  # fmt: skip
def cadence(spark, sf_dir):
    return R.cadence(mailbox(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("per_week", "per_month")})


# --- rollups and scores


@query("SELECT * FROM contacts", FULL)
def contacts_rollup(spark, sf_dir):
    return _contacts(spark, sf_dir)


@query("SELECT c.*, coalesce(b.bulk_count, 0) AS bulk_count FROM contacts c LEFT JOIN bulk b USING (account, address)", FULL)
def kept_contacts(spark, sf_dir):
    """The contacts as three batches leave them: part of the mailbox with wrong flags and senders, the rest, then the first part's corrections."""
    m = mailbox(spark, sf_dir)
    wrong = F.col("key") % 3 == 0
    kept = KeptRollups(spark, shared_folder(spark, "rollups"), parts=4)
    swapped = {"unread": F.when(wrong, 1 - F.col("unread")).otherwise(F.col("unread")), "from_addr": F.when(wrong & (F.col("direction") == "received"), "Old Name <old@mail.example.com>").otherwise(F.col("from_addr"))}
    for batch in (m.where("key % 10 < 6").withColumns(swapped), m.where("key % 10 >= 6"), m.where(wrong & (F.col("key") % 10 < 6))):
        kept.apply(batch.drop("key"))
    return kept.contacts.read().drop("__month")


@query("SELECT * FROM domains", FULL)
def domains_rollup(spark, sf_dir):
    return R.domains_rollup(_contacts(spark, sf_dir))


@query("SELECT t.*, array_to_string(participants, ',') AS participants FROM threads t LEFT JOIN pl USING (account, thread_id)", FULL)
def threads_rollup(spark, sf_dir):
    return R.threads_rollup(mailbox(spark, sf_dir)).withColumn("participants", F.array_join("participants", ",")).drop("subject")


@query("SELECT account, thread_id, arg_max(subject, (internal_date, gmail_message_id)) FILTER (subject IS NOT NULL) AS subject FROM mt GROUP BY ALL")
def thread_subjects(spark, sf_dir):
    return R.threads_rollup(mailbox(spark, sf_dir, True)).select("account", "thread_id", "subject")


@query("SELECT account, address, bulk_count, round(engagement_score, 6) AS engagement_score FROM scored", FULL)
def engagement_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("account", "address", "bulk_count", F.round("engagement_score", 6).alias("engagement_score"))


@query(f"SELECT account, address, {NOW_MS} AS taken_at, msgs_received, read_count, replied_count, round(engagement_score, 6) AS engagement_score FROM scored", FULL)
def score_snapshot(spark, sf_dir):
    return scoring.snapshot(_scored(spark, sf_dir), NOW_MS).withColumn("engagement_score", F.round("engagement_score", 6))


@query(
    "SELECT account, address, msgs_received, floor(least(1.0, read_count / msgs_received) * 100 + 0.5) / 100.0 AS read_rate, bulk_count * 2 > msgs_received AS is_list, CASE WHEN engagement_score >= 2.0 THEN 'important' WHEN bulk_count * 2 > msgs_received OR engagement_score <= -0.5 THEN 'muted' ELSE 'none' END AS suggested "
    "FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(engagement_score, 9) DESC, address) AS r FROM scored) WHERE r <= 20",
    FULL,
)
def interest_propose(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("engagement_score", F.round("engagement_score", 9))
    return scoring.propose_contacts(scored).select("account", "address", "msgs_received", "read_rate", "is_list", "suggested")


# --- composites


@query(
    f"SELECT account, gmail_message_id FROM (SELECT m.account, gmail_message_id, row_number() OVER (PARTITION BY m.account ORDER BY internal_date DESC, gmail_message_id) AS r FROM mb m LEFT JOIN (SELECT account, address FROM cur WHERE curation = 'important') c ON c.account = m.account AND c.address = {ADDR.format('m.from_addr')} "
    f"LEFT JOIN (SELECT account, domain FROM dcur WHERE curation = 'important') d ON d.account = m.account AND d.domain = {HOST.format(ADDR.format('m.from_addr'))} WHERE direction = 'received' AND internal_date >= {SINCE_MS} AND (c.address IS NOT NULL OR d.domain IS NOT NULL)) WHERE r <= 25",
    FULL,
)
def catch_up_important(spark, sf_dir):
    return C.catch_up_important(mailbox(spark, sf_dir), *_curated(spark, sf_dir), SINCE_MS).select("account", "gmail_message_id")


@query(f"SELECT account, gmail_message_id FROM (SELECT m.account, gmail_message_id, row_number() OVER (PARTITION BY m.account ORDER BY internal_date DESC, gmail_message_id) AS r FROM mb m JOIN threads t USING (account, thread_id) WHERE user_participated = 1 AND direction = 'received' AND internal_date >= {SINCE_MS}) WHERE r <= 25", FULL)
def catch_up_user_threads(spark, sf_dir):
    return C.catch_up_user_threads(mailbox(spark, sf_dir), SINCE_MS).select("account", "gmail_message_id")


KEYWORDS = ("The Ernting", "onths")
#: The stem of every word of the data whose stem a keyword names, as a table.
STEMS_SQL = "stems AS (SELECT unnest(['the', 'thed', 'thes', 'ernt', 'ernts', 'ernted', 'erntes', 'ernting', 'onth', 'onthes', 'onthed', 'onthing']) AS token, unnest(['the', 'thed', 'the', 'ernt', 'ernt', 'ernt', 'ernt', 'ernt', 'onth', 'onth', 'onth', 'onth']) AS stem)"
#: Positions of these stems in every indexed column (kept), and the messages that hold a keyword (named): neighbours in one column, or a single word.
KEYWORD_SQL = STEMS_SQL + """, cols AS (SELECT gmail_message_id AS id, unnest(['subject', 'sender', 'recipients', 'body']) AS col, unnest([subject, from_addr, concat_ws(' ', nullif(to_addr, ''), nullif(cc_addr, '')), concat_ws(chr(10), nullif(snippet, ''), nullif(body_text, ''), nullif(summary_text, ''))]) AS t FROM mt),
words AS (SELECT id, col, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (SELECT id, col, regexp_extract_all(lower(coalesce(t, '')), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+') AS ws FROM cols)),
kept AS (SELECT id, col, pos, stem FROM words JOIN stems USING (token)),
named AS (SELECT a.id FROM kept a JOIN kept b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.stem = 'the' AND b.stem = 'ernt' UNION SELECT id FROM kept WHERE stem = 'onth')"""


@query(
    f"SELECT account, gmail_message_id FROM (SELECT account, gmail_message_id, row_number() OVER (PARTITION BY account ORDER BY internal_date DESC, gmail_message_id) AS r FROM mt WHERE internal_date >= {SINCE_MS} AND gmail_message_id IN (SELECT id FROM named)) WHERE r <= 25",
    MAILBOX_SQL + "," + KEYWORD_SQL,
)
def catch_up_keywords(spark, sf_dir):
    return C.catch_up_keywords(mailbox(spark, sf_dir, True), list(KEYWORDS), SINCE_MS).select("account", "gmail_message_id")


@query(
    f"SELECT account, address, issues, unread, unsummarized FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(engagement_score, 9) DESC NULLS LAST, issues DESC, address) AS r FROM (SELECT c.account, c.address, c.engagement_score, count(*) AS issues, sum(unread)::BIGINT AS unread, count(*) FILTER (body_state <> 'summary-only') AS unsummarized "
    f"FROM scored c JOIN (SELECT *, {ADDR.format('from_addr')} AS a FROM mb) m ON m.account = c.account AND m.a = c.address WHERE direction = 'received' AND internal_date >= {SINCE_MS} AND (is_list OR category IN ('promotions', 'social', 'updates', 'forums')) GROUP BY ALL)) WHERE r <= 20",
    FULL,
)
def digest_sources(spark, sf_dir):
    m = mailbox(spark, sf_dir).withColumn("summary_text", F.when(F.col("body_state") == "summary-only", F.lit("s")))
    scored = _scored(spark, sf_dir).withColumn("engagement_score", F.round("engagement_score", 9))
    return C.digest_sources(m, scored, SINCE_MS).select("account", "address", "issues", "unread", "unsummarized")


@query("SELECT account, address, msgs_sent, msgs_received FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(engagement_score, 9) DESC, address) AS r FROM scored WHERE msgs_sent > 0) WHERE r <= 20", FULL)
def list_contacts(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("engagement_score", F.round("engagement_score", 9))
    return C.list_contacts(scored, only="correspondent").select("account", "address", "msgs_sent", "msgs_received")


@query("SELECT account, address, rank FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY msgs_sent > 0 DESC, round(engagement_score, 9) DESC, address) AS rank FROM scored WHERE contains(lower(coalesce(display_name, '')), '00001') OR contains(address, '00001') OR contains(domain, '00001')) WHERE rank <= 10", FULL)
def find_person(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("engagement_score", F.round("engagement_score", 9))
    return C.find_person(scored, "00001").select("account", "address", "rank")


@query(
    "SELECT account, domain, correspondents, msgs, rank FROM (SELECT d.account, d.domain, d.msgs, c.n AS correspondents, row_number() OVER (PARTITION BY d.account ORDER BY c.n DESC, d.msgs DESC, d.domain) AS rank FROM domains d JOIN (SELECT account, domain, count(*) FILTER (msgs_sent > 0) AS n FROM contacts GROUP BY ALL) c USING (account, domain)) WHERE rank <= 20",
    FULL,
)
def domains_to_categorize(spark, sf_dir):
    contacts = _contacts(spark, sf_dir)
    return C.domains_to_categorize(contacts, R.domains_rollup(contacts, with_correspondents=True).withColumn("category", F.lit(None).cast("string"))).select("account", "domain", "correspondents", "msgs", "rank")


@query("SELECT account, domain, string_agg(address, ',' ORDER BY r) AS samples FROM (SELECT account, domain, address, row_number() OVER (PARTITION BY account, domain ORDER BY msgs_received + msgs_sent DESC, address) AS r FROM contacts) WHERE r <= 5 GROUP BY ALL", FULL)
def domain_samples(spark, sf_dir):
    return C.domain_samples(_contacts(spark, sf_dir)).withColumn("samples", F.array_join("samples", ","))


@query("SELECT account, gmail_message_id FROM (SELECT m.*, c.msgs_sent FROM (SELECT *, {0} AS a FROM mb) m LEFT JOIN contacts c ON c.account = m.account AND c.address = m.a) WHERE category = 'updates' AND NOT is_list AND msgs_sent > 0 AND list_contains(labels, 'UNREAD')".format(ADDR.format("from_addr")), FULL)
def trigger_match(spark, sf_dir):
    m, contacts = mailbox(spark, sf_dir), _contacts(spark, sf_dir)
    domains = R.domains_rollup(contacts).withColumn("curation", F.lit(None).cast("string"))
    rule = [("category", "updates"), ("is_list", False), ("correspondent", True), ("label", "UNREAD")]
    return M.matching(m, contacts.withColumn("curation", F.lit(None).cast("string")), domains, rule).select("account", "gmail_message_id")


# --- graph


@query("SELECT * FROM edges", FULL)
def cofrequency_edges(spark, sf_dir):
    return graph.edges(_members(spark, sf_dir))


@query("SELECT account, address, neighbour, shared_threads, rank FROM (SELECT account, src AS address, dst AS neighbour, weight AS shared_threads, row_number() OVER (PARTITION BY account, src ORDER BY weight DESC, dst) AS rank FROM both_ways) WHERE rank <= 15", FULL)
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(graph.edges(_members(spark, sf_dir)))


PAGERANK_STEPS = 20


def _pagerank_sql() -> str:
    out = [
        "nd AS MATERIALIZED (SELECT DISTINCT account, address FROM mem), sz AS MATERIALIZED (SELECT account, count(*) AS n FROM nd GROUP BY account), tot AS (SELECT account, src, sum(weight) AS t FROM both_ways GROUP BY ALL)",
        "lk AS MATERIALIZED (SELECT b.account, b.src, b.dst, b.weight / t.t AS share FROM both_ways b JOIN tot t USING (account, src)), bs AS MATERIALIZED (SELECT nd.account, nd.address, n, t.t IS NULL AS dangling FROM nd JOIN sz USING (account) LEFT JOIN tot t ON t.account = nd.account AND t.src = nd.address)",
        "r0 AS MATERIALIZED (SELECT account, address, 1.0::DOUBLE / n AS r FROM bs)",
    ]
    for i in range(PAGERANK_STEPS):
        out.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.account, b.address, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f.flow, 0) + coalesce(l.lost, 0) / n) AS r FROM bs b LEFT JOIN (SELECT k.account, k.dst AS address, sum(r * share) AS flow FROM lk k JOIN r{i} ON r{i}.account = k.account AND r{i}.address = k.src GROUP BY ALL) f USING (account, address) "
            f"LEFT JOIN (SELECT account, sum(r) AS lost FROM bs JOIN r{i} USING (account, address) WHERE dangling GROUP BY ALL) l USING (account))"
        )
    return ", ".join(out)


@query(f"SELECT account, address, round(r, 9) AS centrality FROM r{PAGERANK_STEPS}", FULL + "," + _pagerank_sql())
def graph_pagerank(spark, sf_dir):
    people = _members(spark, sf_dir)
    return graph.pagerank(people, Stage(spark, "edges").put("edges", graph.edges(people)), tolerance=0.0, iterations=PAGERANK_STEPS).withColumn("centrality", F.round("centrality", 9))


COMMUNITY_ROUNDS = 12


def _communities_sql() -> str:
    """The mergers of graph.communities, a round after the other."""
    out = [
        "ge0 AS MATERIALIZED (SELECT account, src AS a, dst AS b, weight AS w FROM both_ways), dg AS (SELECT account, a, sum(w)::BIGINT AS d FROM ge0 GROUP BY ALL), gn0 AS MATERIALIZED (SELECT account, a, d, (sum(d) OVER (PARTITION BY account))::BIGINT AS t FROM dg)",
        "gm0 AS MATERIALIZED (SELECT DISTINCT account, address, address AS c FROM mem)",
    ]
    for i in range(COMMUNITY_ROUNDS):
        j = i + 1
        out += [
            f"gp{j} AS MATERIALIZED (SELECT DISTINCT ON (account, a) * FROM (SELECT e.account, e.a, e.b, e.w, x.d, y.d AS db, x.t FROM ge{i} e JOIN gn{i} x USING (account, a) JOIN gn{i} y ON y.account = e.account AND y.a = e.b) WHERE t * w > d * db ORDER BY account, a, t * w - d * db DESC, md5(least(a, b) || ':' || greatest(a, b)), b)",
            f"gh{j} AS MATERIALIZED (SELECT x.account, x.a AS head, x.b AS partner FROM gp{j} x JOIN gp{j} y ON y.account = x.account AND y.a = x.b AND y.b = x.a WHERE x.d > x.db OR (x.d = x.db AND x.a < x.b))",
            f"gj{j} AS MATERIALIZED (SELECT account, a, head FROM (SELECT z.*, h.head, h.partner, sum(z.d) OVER (PARTITION BY z.account, h.head) AS s FROM gp{j} z JOIN gh{j} h ON h.account = z.account AND h.head = z.b) WHERE a = partner OR t * w > d * (db + s - d))",
            f"ge{j} AS MATERIALIZED (SELECT account, a, b, sum(w)::BIGINT AS w FROM (SELECT e.account, coalesce(x.head, e.a) AS a, coalesce(y.head, e.b) AS b, w FROM ge{i} e LEFT JOIN gj{j} x ON x.account = e.account AND x.a = e.a LEFT JOIN gj{j} y ON y.account = e.account AND y.a = e.b) WHERE a <> b GROUP BY ALL)",
            f"gn{j} AS MATERIALIZED (SELECT n.account, coalesce(x.head, n.a) AS a, sum(d)::BIGINT AS d, any_value(t) AS t FROM gn{i} n LEFT JOIN gj{j} x ON x.account = n.account AND x.a = n.a GROUP BY ALL)",
            f"gm{j} AS MATERIALIZED (SELECT m.account, m.address, coalesce(x.head, m.c) AS c FROM gm{i} m LEFT JOIN gj{j} x ON x.account = m.account AND x.a = m.c)",
        ]
    return ", ".join(out)


@query(f"SELECT account, row_number() OVER (PARTITION BY account ORDER BY first_member) - 1 AS community_id, size, first_member FROM (SELECT account, c, count(*) AS size, min(address) AS first_member FROM gm{COMMUNITY_ROUNDS} GROUP BY account, c)", FULL + "," + _communities_sql())
def graph_communities(spark, sf_dir):
    people = _members(spark, sf_dir)
    found = graph.numbered(graph.communities(people, graph.edges(people), COMMUNITY_ROUNDS))
    return found.groupBy("account", "community_id").agg(F.count("*").alias("size"), F.min("address").alias("first_member"))


# --- search


def _search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexed columns, bodies as a whole."""
    m = mailbox(spark, sf_dir, True)
    body = S.project_body(F.col("snippet"), F.col("body_text"), F.col("summary_text"))
    return m.select(F.col("gmail_message_id").alias("docid"), "subject", F.col("from_addr").alias("sender"), S.project_recipients(F.col("to_addr"), F.col("cc_addr")).alias("recipients"), body.alias("body"))


@query(
    "docs AS (SELECT gmail_message_id AS docid, subject, from_addr AS sender, nullif(concat_ws(' ', nullif(to_addr, ''), nullif(cc_addr, '')), '') AS recipients, nullif(concat_ws(chr(10), nullif(snippet, ''), nullif(body_text, ''), nullif(summary_text, '')), '') AS body FROM mt), "
    "tk AS (SELECT docid, regexp_extract_all(lower(coalesce(subject, '')), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+') AS s, regexp_extract_all(lower(coalesce(sender, '')), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+') AS f, regexp_extract_all(lower(coalesce(recipients, '')), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+') AS r, regexp_extract_all(lower(coalesce(body, '')), '[\\p{L}\\p{N}\\p{Co}\\p{Mn}]+') AS b FROM docs), "
    "tf AS (SELECT docid, len(s) + len(f) + len(r) + len(b) AS dl, q, 10.0 * len(list_filter(s, lambda x: x = q)) + 8.0 * len(list_filter(f, lambda x: x = q)) + 4.0 * len(list_filter(r, lambda x: x = q)) + len(list_filter(b, lambda x: x = q)) AS f FROM tk, (SELECT unnest(['edble', 'nicht']) AS q)), "
    "st AS (SELECT count(DISTINCT docid) AS n, avg(dl) AS avgdl FROM tf), dfs AS (SELECT q, count(*) AS df FROM tf WHERE f > 0 GROUP BY q), "
    "pt AS (SELECT docid, -CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS p FROM tf JOIN dfs USING (q), st WHERE f > 0) "
    "SELECT docid, round(sum(p), 9) AS score FROM pt GROUP BY docid"
)
def bm25_exact(spark, sf_dir):
    return search.SearchIndex(_search_docs(spark, sf_dir), stem=False).search(["edble", "nicht"], prefix=False).withColumn("score", F.round("score", 9))


def _bm25_sql(terms: list[str], docs: str = "mt") -> str:
    """BM25 of messages (gmail_message_id and texts in docs) over all weighted columns; a term is a condition on a word x."""
    found = " UNION ALL ".join(f"SELECT docid, dl, {i} AS q, " + " + ".join(f"{w} * len(list_filter({c}, lambda x: {t}))" for c, w in (("s", 10.0), ("f", 8.0), ("r", 4.0), ("b", 1.0))) + " AS f FROM tk" for i, t in enumerate(terms))
    word = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}]+')"
    texts = {"s": "subject", "f": "from_addr", "r": "concat_ws(' ', nullif(to_addr, ''), nullif(cc_addr, ''))", "b": "concat_ws(chr(10), nullif(snippet, ''), nullif(body_text, ''), nullif(summary_text, ''))"}
    return (
        "tk AS (SELECT *, len(s) + len(f) + len(r) + len(b) AS dl FROM (SELECT gmail_message_id AS docid, " + ", ".join(f"{word.format(t)} AS {c}" for c, t in texts.items()) + f" FROM {docs})), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk), "
        f"tf AS (SELECT * FROM ({found}) WHERE f > 0), dfs AS (SELECT q, count(*) AS df FROM tf GROUP BY q), "
        "scores AS (SELECT docid, round(sum(-CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN dfs USING (q), st GROUP BY docid)"
    )


@query("SELECT docid, score FROM scores ORDER BY score, docid LIMIT 15", MAILBOX_SQL + "," + _bm25_sql(["starts_with(x, 'thing')", "starts_with(x, 'invoic')", "starts_with(x, 'receipt')", "starts_with(x, 'bill')"]))
def search_messages(spark, sf_dir):
    """Stemmed prefix-OR search over the texts; no word of the data loses the end of these stems."""
    hits = search.SearchIndex(_search_docs(spark, sf_dir)).search(search.expand_query(["thing", "invoice"]))
    return hits.withColumn("score", F.round("score", 9)).orderBy("score", "docid").limit(15)


STORED = ("Ernting", "onths", "thing")


def _stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The mailbox as two batches: first all messages, some with texts of another one and some that are deleted later; then the former as they are."""
    docs = _search_docs(spark, sf_dir).withColumn("key", F.expr("cast(substring(docid, 2) as bigint)"))
    stale = F.col("key") % 10 == 3
    index = StoredIndex(spark, shared_folder(spark, "search"))
    index.add(docs.withColumn("body", F.when(stale, F.concat_ws(" ", F.lit("onth thing old"), "subject")).otherwise(F.col("body"))).drop("key"))
    index.add(docs.where(stale).drop("key"), docs.where("key % 10 = 7").select("docid"))
    return index


@query("SELECT docid, score FROM scores", MAILBOX_SQL + ", held AS (SELECT * FROM mt WHERE key % 10 <> 7), " + _bm25_sql([f"x IN ('{s}', '{s}s', '{s}ed', '{s}es', '{s}ing')" for s in ("ernt", "onth", "thing")], "held"))
def search_stored(spark, sf_dir):
    """Whole stemmed words by the stored index: a batch replaced and deleted messages of the one before."""
    return _stored_index(spark, sf_dir).search(list(STORED), prefix=False).withColumn("score", F.round("score", 9))


# --- feed, retention, ingest


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("sequence"), F.col("event_type").alias("account"), F.col("user_id").cast("string").alias("entity_key"))


@query("SELECT event_id + 1 AS sequence, event_type AS account, user_id::VARCHAR AS entity_key, 'crm_v1_' || rtrim(translate(to_base64(encode((event_id + 1)::VARCHAR)), '+/=', '-_ ')) AS cursor FROM events WHERE event_id + 1 > 50 AND event_type IN ('view', 'click') ORDER BY event_id LIMIT 100", "")
def feed_page(spark, sf_dir):
    return feed_ops.page(_feed(spark, sf_dir), 50, 100, ["view", "click"])


@query("SELECT row_number() OVER (ORDER BY internal_date, account, gmail_message_id) AS sequence, account, gmail_message_id AS entity_key FROM mb")
def feed_append(spark, sf_dir):
    """Every message twice over into an empty feed: numbered by time, once each."""
    events = feed_ops.message_changes(mailbox(spark, sf_dir))
    empty = events.limit(0).withColumn("sequence", F.lit(0).cast("long"))
    return feed_ops.append(empty, events.unionByName(events)).select("sequence", "account", "entity_key")


@query(
    "SELECT row_number() OVER (ORDER BY key % 10 >= 6, internal_date, account, gmail_message_id) AS sequence, account, gmail_message_id AS entity_key FROM mb"
)
def feed_kept(spark, sf_dir):
    """The mailbox's changes as two batches leave them, the second one with all of the first again; read from the kept feed."""
    m = mailbox(spark, sf_dir)
    kept = KeptFeed(spark, shared_folder(spark, "feed"))
    for rows in (m.where("key % 10 < 6"), m):
        kept.append(feed_ops.message_changes(rows))
    return kept.read().select("sequence", "account", "entity_key")


@query(
    "SELECT 'frequent' AS rule, m.account, gmail_message_id FROM mb m JOIN cur c ON c.account = m.account AND c.address = " + ADDR.format("m.from_addr") + " WHERE c.msgs_sent > 0 AND NOT m.is_list "
    "UNION ALL SELECT 'starred', account, gmail_message_id FROM mb WHERE list_contains(labels, 'STARRED')",
    FULL,
)
def rule_firings(spark, sf_dir):
    """Rules over a stream of all messages, in which each of one part comes twice: a message fires a rule once."""
    folder = shared_folder(spark, "firings")
    mailbox(spark, sf_dir).write.parquet(f"{folder}/in/all")
    m = spark.read.parquet(f"{folder}/in/all")
    m.where("key % 10 < 3").write.parquet(f"{folder}/in/again")
    stream = spark.readStream.schema(m.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    rules = {"frequent": {"conditions": [("correspondent", True), ("is_list", False)]}, "starred": {"conditions": [("label", "STARRED")]}}
    stage = Stage(spark, "curated")
    contacts, domains = _curated_of(stage.put("scored", _scored_of(m)))
    curated = stage.put("contacts", contacts), stage.put("domains", domains)
    stage.drop("scored")
    kept = KeptFeed(spark, f"{folder}/feed")
    kept.follow(kept_feed.firing_events(kept_feed.firings(stream, rules, *curated)), f"{folder}/checkpoint").awaitTermination()
    stage.drop("contacts", "domains")
    fired = F.from_json("payload", "rule string, account string, gmail_message_id string")
    return kept.read().select(fired.alias("f")).select("f.*")


CUTOFF_MS = 852_076_800_000  # 1997-01-01


@query(
    f"SELECT account, gmail_message_id FROM mb m ANTI JOIN (SELECT account, address AS a FROM cur WHERE curation = 'important') c ON c.account = m.account AND c.a = {ADDR.format('m.from_addr')} ANTI JOIN (SELECT account, domain AS d FROM dcur WHERE curation = 'important') d ON d.account = m.account AND d.d = {HOST.format(ADDR.format('m.from_addr'))} "
    f"ANTI JOIN (SELECT DISTINCT account, thread_id FROM mb WHERE direction = 'sent') t USING (account, thread_id) WHERE body_state = 'full' AND internal_date < {CUTOFF_MS}",
    FULL,
)
def retention_eligible(spark, sf_dir):
    return M.evictable(mailbox(spark, sf_dir), *_curated(spark, sf_dir), CUTOFF_MS).select("account", "gmail_message_id")


@query("SELECT account, gmail_message_id, CASE WHEN key % 3 = 0 AND body_state = 'meta' THEN 'full' ELSE body_state END AS body_state, CASE WHEN key % 3 = 0 AND body_state IN ('meta', 'full') THEN 'new body' ELSE body_text END AS body_text, "
       "CASE WHEN key % 21 = 0 THEN 'newer summary' ELSE summary_text END AS summary_text, CASE WHEN key % 21 = 0 THEN 1 WHEN summary_text IS NOT NULL THEN internal_date END AS summarized_at, CASE WHEN key % 3 = 0 THEN 1 - unread ELSE unread END AS unread FROM mt")  # fmt: skip
def lattice_upsert(spark, sf_dir):
    """Three batches: bodies, summaries of some, then metadata alone, which takes neither away."""
    m = mailbox(spark, sf_dir, True).withColumn("summarized_at", F.when(F.col("summary_text").isNotNull(), F.col("internal_date")))
    m = m.select("account", "gmail_message_id", "body_state", "body_text", "summary_text", "summarized_at", "unread", "key")
    flipped = m.where("key % 3 = 0").select("account", "gmail_message_id", (1 - F.col("unread")).alias("unread"), "key")
    bodies = flipped.withColumns({"body_state": F.lit("full"), "body_text": F.lit("new body"), "batch": F.lit(1)})
    summaries = flipped.where("key % 7 = 0").withColumns({"body_state": F.lit("meta"), "summary_text": F.lit("newer summary"), "summarized_at": F.lit(1).cast("long"), "batch": F.lit(2)})
    plain = flipped.withColumns({"body_state": F.lit("meta"), "batch": F.lit(3)})
    return M.upsert(m, bodies.unionByName(summaries, True).unionByName(plain, True)).drop("key")


@query("SELECT account, gmail_message_id, CASE WHEN key % 10 = 9 THEN 'archived' ELSE 'restored' END AS change FROM mb WHERE (list_contains(labels, 'INBOX') AND key % 10 = 9) OR (NOT list_contains(labels, 'INBOX') AND key % 10 = 4)")
def reconcile_inbox(spark, sf_dir):
    m = mailbox(spark, sf_dir)
    inbox = F.array_contains("labels", "INBOX")
    live = m.where((inbox & (F.col("key") % 10 != 9)) | (~inbox & (F.col("key") % 10 == 4))).select("account", "gmail_message_id")
    return M.reconcile(m, live)


@query("SELECT gmail_message_id, array_to_string(list_sort(CASE WHEN key % 2 = 0 THEN list_concat(list_filter(labels, lambda x: x NOT IN ('INBOX', 'STARRED', 'IMPORTANT')), CASE WHEN key % 4 = 0 THEN ['IMPORTANT'] ELSE ['STARRED'] END) ELSE labels END), ',') AS labels, "
       "CASE WHEN key % 4 = 0 THEN 0 WHEN key % 2 = 0 THEN 1 ELSE starred END AS starred, CASE WHEN key % 2 = 0 AND category = 'primary' THEN NULL ELSE category END AS category FROM mb")  # fmt: skip
def edit_labels(spark, sf_dir):
    """The whole mailbox; the messages with even keys have two edits, of which every second pair's later one takes back what the first one did."""
    m = mailbox(spark, sf_dir)
    names = lambda *labels: F.array(*map(F.lit, labels))
    some = m.where("key % 2 = 0").select("account", "gmail_message_id", "key")
    first = some.select("account", "gmail_message_id", names("STARRED").alias("add"), names("INBOX", "IMPORTANT").alias("remove"), F.lit(1).alias("seq"))
    later = some.where("key % 4 = 0").select("account", "gmail_message_id", names("IMPORTANT").alias("add"), names("STARRED").alias("remove"), F.lit(2).alias("seq"))
    return M.edit_labels(m, first.unionByName(later)).select("gmail_message_id", F.array_join(F.array_sort("labels"), ",").alias("labels"), "starred", "category")


# --- selectors, sweeps and sources


ATTACHED_SQL = """a AS (SELECT page_id, 'inline%3A0-page.html' AS name, html AS t FROM pages UNION ALL SELECT page_id, 'inline%3A1-site.txt', regexp_extract(url, '^[a-z]+://[^/]+', 0) FROM pages),
b AS (SELECT 'crm/pages/' || page_id || '/' || name AS storage_key, sha256(t) AS digest, strlen(t) AS n, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM a WHERE page_id IS NOT NULL AND t <> '' AND strlen(t) <= 26214400),
o AS (SELECT digest, min(batch) AS object_batch FROM b GROUP BY digest), e AS (SELECT storage_key, max(digest) AS digest, arg_max(n, digest) AS n FROM b GROUP BY storage_key)"""


@query("SELECT storage_key, CAST(n AS BIGINT) AS size_bytes, digest AS read_sha256, object_batch FROM e JOIN o USING (digest)", ATTACHED_SQL)
def attachment_store(spark, sf_dir):
    """Every page as a message with two attachments, its html and its site (a content that many pages share), stored in two batches of which the first comes twice, and read back."""
    data = lambda text: F.replace(F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    part = lambda name, kind, text: F.struct(F.lit(name).alias("filename"), F.lit(kind).alias("mimeType"), F.struct(F.octet_length(text).alias("size"), data(text).alias("data")).alias("body"))
    parts = F.array(part("page.html", "text/html", F.col("html")), part("site.txt", "text/plain", F.regexp_extract("url", "^[a-z]+://[^/]+", 0)))
    message = F.struct(F.col("page_id").cast("string").alias("id"), F.array(F.lit("INBOX")).alias("labelIds"), F.struct(F.lit("multipart/mixed").alias("mimeType"), parts.alias("parts")).alias("payload"))
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    store = AttachmentStore(spark, shared_folder(spark, "attachments"))
    for batch, half in (("even", "page_id % 2 = 0"), ("odd", "page_id % 2 <> 0"), ("even", "page_id % 2 = 0")):
        store.put(payload.storable(payload.parse(pages.where(half).select(F.to_json(message).alias("value"))), "pages"), "pages", batch)
    return store.read().select("storage_key", "size_bytes", F.sha2("content", 256).alias("read_sha256"), "object_batch")


@query(
    "SELECT account, gmail_message_id, array_to_string(list_sort(labels), ',') AS labels, starred, unread, summary FROM (SELECT account, gmail_message_id, CASE WHEN key % 4 = 2 THEN list_filter(labels, lambda x: x <> 'STARRED') WHEN key % 4 IN (1, 3) THEN list_distinct(list_append(labels, 'STARRED')) ELSE labels END AS labels, "
    "CASE WHEN key % 4 = 2 THEN 0 WHEN key % 4 IN (1, 3) THEN 1 ELSE starred END AS starred, unread, CASE WHEN key % 6 = 0 THEN 'second' WHEN key % 3 = 0 THEN 'first' END AS summary FROM mb)"
)
def stored_marks(spark, sf_dir):
    """Label edits and summaries of the whole mailbox in four transactions, the later ones taking some of the earlier back; the log is folded between."""
    m = mailbox(spark, sf_dir)
    store = Overlays(spark, shared_folder(spark, "marks"))
    mark = lambda rows, kind, item, value: rows.select(F.lit(kind).alias("kind"), "account", F.col("gmail_message_id").alias("key"), F.lit(item).alias("item"), F.lit(value).alias("value"))
    store.put_rows(mark(m.where("key % 4 > 0"), "label", "STARRED", "add").unionByName(mark(m.where("key % 3 = 0"), "summary", "text", "first")))
    store.put_rows(mark(m.where("key % 2 = 0"), "label", "STARRED", "remove"))
    store.fold()
    store.put_rows(mark(m.where("key % 6 = 0"), "summary", "text", "second"))
    store.put_rows(mark(m.where("key % 4 = 0"), "label", "STARRED", None))
    rows = store.on_messages(m.withColumn("summary_text", F.lit(None).cast("string")))
    return rows.select("account", "gmail_message_id", F.array_join(F.array_sort("labels"), ",").alias("labels"), "starred", "unread", F.col("summary_text").alias("summary"))


@query(f"SELECT account, gmail_message_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY internal_date DESC, gmail_message_id) AS rank FROM mb WHERE body_state = 'meta' AND internal_date >= {SINCE_MS}) WHERE rank <= 100")
def enrich_all(spark, sf_dir):
    """rule=all with since and limit."""
    return M.select_backlog(mailbox(spark, sf_dir), rule="all", since_ms=SINCE_MS, limit=100).select("account", "gmail_message_id", "rank")


@query(f"SELECT account, gmail_message_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY internal_date DESC, gmail_message_id) AS rank FROM mt WHERE body_state = 'meta' AND NOT is_list AND (category IS NULL OR category NOT IN ('promotions', 'social')) AND internal_date >= {SINCE_MS} "
       "AND (" + " OR ".join(f"regexp_matches(lower(coalesce({c}, '')), '(^|[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}])nicht')" for c in ("subject", "from_addr", "to_addr", "cc_addr", "snippet", "body_text", "summary_text")) + ")) WHERE rank <= 100")  # fmt: skip
def enrich_matching(spark, sf_dir):
    """rule=direct with search terms (a prefix that stemming keeps), since and limit."""
    return M.select_backlog(mailbox(spark, sf_dir, True), rule="direct", match=["nicht"], since_ms=SINCE_MS, limit=100).select("account", "gmail_message_id", "rank")


@query(
    "SELECT account, gmail_message_id FROM (SELECT mt.*, c.msgs_sent, c.curation, d.curation AS domain_curation FROM (SELECT *, {0} AS a, {1} AS h FROM mt) mt LEFT JOIN cur c ON c.account = mt.account AND c.address = mt.a LEFT JOIN dcur d ON d.account = mt.account AND d.domain = mt.h) "
    "WHERE NOT is_list AND msgs_sent > 0 AND (curation IN ('muted', 'important') OR domain_curation = 'important') AND a LIKE '%.com' AND ((category = 'updates' AND list_contains(labels, 'UNREAD')) OR (category = 'forums' AND h = 'mail.france.com' AND regexp_matches(lower(subject), '(^|[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{Mn}}])th')))".format(ADDR.format("from_addr"), HOST.format(ADDR.format("from_addr"))),
    FULL,
)
def trigger_conditions(spark, sf_dir):
    """Two rules that name seven of the eight conditions; the eighth, from_addr, is in trigger_sender."""
    contacts, domains = _curated(spark, sf_dir)
    m = mailbox(spark, sf_dir, True)
    m = m.withColumns({c: F.lit(None).cast("string") for c in ("snippet", "body_text", "summary_text")})
    both = [("is_list", False), ("correspondent", True)]
    curated = lambda *more: M.matching(m, contacts, domains, [*both, *more])
    one = [curated(("interest_profile", c), ("category", "updates"), ("label", "UNREAD")) for c in ("muted", "important")]
    two = [curated(("interest_profile", c), ("category", "forums"), ("from_domain", "mail.france.com"), ("subject_fts", ["th"])) for c in ("muted", "important")]
    kept = [x.where(S.extract_address(F.col("from_addr")).endswith(".com")).select("account", "gmail_message_id") for x in (*one, *two)]
    return reduce(DataFrame.union, kept).distinct()


@query("SELECT account, gmail_message_id FROM mb WHERE {0} = (SELECT min({0}) FROM mb WHERE direction = 'received')".format(ADDR.format("from_addr")))
def trigger_sender(spark, sf_dir):
    m = mailbox(spark, sf_dir)
    address = m.where("direction = 'received'").agg(F.min(S.extract_address(F.col("from_addr")))).first()[0] or "none@none"
    none = m.sparkSession.createDataFrame([], "account string, address string, domain string, msgs_sent long, curation string")
    return M.matching(m, none.drop("domain"), none.select("account", "domain", "curation"), [("from_addr", address.upper())]).select("account", "gmail_message_id")


@query(
    f"SELECT account, gmail_message_id, rank FROM (SELECT m.account, gmail_message_id, row_number() OVER (PARTITION BY m.account ORDER BY internal_date, gmail_message_id) AS rank FROM mb m ANTI JOIN (SELECT account, address AS a FROM cur WHERE curation = 'important') c ON c.account = m.account AND c.a = {ADDR.format('m.from_addr')} "
    f"ANTI JOIN (SELECT account, domain AS d FROM dcur WHERE curation = 'important') d ON d.account = m.account AND d.d = {HOST.format(ADDR.format('m.from_addr'))} ANTI JOIN (SELECT DISTINCT account, thread_id FROM mb WHERE direction = 'sent') t USING (account, thread_id) WHERE body_state = 'full' AND internal_date < {CUTOFF_MS}) WHERE rank <= 200",
    FULL,
)
def retention_sweep(spark, sf_dir):
    return C.retention_batch(mailbox(spark, sf_dir), *_curated(spark, sf_dir), CUTOFF_MS).select("account", "gmail_message_id", "rank")


SUMMARIZED = "SELECT *, CASE WHEN key % 3 = 0 THEN 'kept' END AS summary_text, CASE WHEN body_state = 'full' THEN 'whole' END AS body_text FROM mb"
CHOSEN = (
    f"sm AS ({SUMMARIZED}), chosen AS (SELECT m.account, m.gmail_message_id FROM sm m ANTI JOIN (SELECT account, address AS a FROM cur WHERE curation = 'important') c ON c.account = m.account AND c.a = {ADDR.format('m.from_addr')} "
    f"ANTI JOIN (SELECT account, domain AS d FROM dcur WHERE curation = 'important') d ON d.account = m.account AND d.d = {HOST.format(ADDR.format('m.from_addr'))} ANTI JOIN (SELECT DISTINCT account, thread_id FROM mb WHERE direction = 'sent') t USING (account, thread_id) WHERE body_state = 'full' AND {{0}})"
)


def _summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mailbox(spark, sf_dir)
    return m.withColumns({"summary_text": F.when(F.col("key") % 3 == 0, "kept"), "body_text": F.when(F.col("body_state") == "full", "whole"), "summarized_at": F.col("internal_date")})


@query(CHOSEN.format(f"summary_text IS NOT NULL AND internal_date <= {CUTOFF_MS} AND (is_list OR coalesce(category IN ('promotions', 'social'), FALSE))") + " SELECT sm.gmail_message_id, CASE WHEN c.account IS NOT NULL THEN 'summary-only' ELSE body_state END AS body_state, CASE WHEN c.account IS NULL THEN body_text END AS body_text FROM sm LEFT JOIN chosen c USING (account, gmail_message_id)", FULL)
def demoted_mailbox(spark, sf_dir):
    m = _summarized(spark, sf_dir)
    return M.demote(m, M.demotable(m, *_curated(spark, sf_dir), CUTOFF_MS)).select("gmail_message_id", "body_state", "body_text")


@query(CHOSEN.format(f"internal_date < {CUTOFF_MS}") + " SELECT sm.gmail_message_id, CASE WHEN c.account IS NULL THEN body_state WHEN summary_text IS NOT NULL THEN 'summary-only' ELSE 'meta' END AS body_state, CASE WHEN c.account IS NULL THEN body_text END AS body_text FROM sm LEFT JOIN chosen c USING (account, gmail_message_id)", FULL)
def evicted_mailbox(spark, sf_dir):
    m = _summarized(spark, sf_dir)
    return M.evict(m, M.evictable(m, *_curated(spark, sf_dir), CUTOFF_MS)).select("gmail_message_id", "body_state", "body_text")


@query(
    f"pb AS (SELECT *, {ADDR.format('from_addr')} AS a, {HOST.format(ADDR.format('from_addr'))} AS h FROM mt WHERE body_state = 'meta') SELECT pb.account, gmail_message_id FROM pb LEFT JOIN cur c ON c.account = pb.account AND c.address = a LEFT JOIN dcur d ON d.account = pb.account AND d.domain = h "
    "WHERE (coalesce(c.curation = 'important', FALSE) OR coalesce(d.curation = 'important', FALSE) OR gmail_message_id IN (SELECT id FROM named)) AND coalesce(c.curation <> 'muted', TRUE)",
    FULL + "," + KEYWORD_SQL,
)
def profile_backlog(spark, sf_dir):
    return C.profile_backlog(mailbox(spark, sf_dir, True), *_curated(spark, sf_dir), list(KEYWORDS)).select("account", "gmail_message_id")


@query("SELECT account, domain, rank, subject FROM (SELECT account, {1} AS domain, subject, row_number() OVER (PARTITION BY account, {1} ORDER BY internal_date DESC, gmail_message_id) AS rank FROM mt WHERE direction = 'received' AND subject IS NOT NULL) WHERE rank <= 3".format(ADDR.format("from_addr"), HOST.format(ADDR.format("from_addr"))))
def recent_subjects(spark, sf_dir):
    return C.recent_subjects(mailbox(spark, sf_dir, True))


@query("SELECT account, address, rank FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY msgs_sent DESC, replied_count DESC, address) AS rank FROM contacts WHERE msgs_sent > 0) WHERE rank <= 500", FULL)
def correspondents(spark, sf_dir):
    return C.correspondents(_contacts(spark, sf_dir), C.CORRESPONDENT_CAP).select("account", "address", "rank")


@query("SELECT account, chunk, 'from:{' || string_agg(address, ' ' ORDER BY r) || '}' AS query FROM (SELECT *, (r - 1) // 25 AS chunk FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY msgs_sent DESC, replied_count DESC, address) AS r FROM contacts WHERE msgs_sent > 0) WHERE r <= 500) GROUP BY ALL", FULL)
def correspondent_queries(spark, sf_dir):
    return C.correspondent_queries(_contacts(spark, sf_dir)).withColumn("chunk", F.col("chunk").cast("long"))


@query(f"SELECT account, gmail_message_id FROM mb m WHERE internal_date >= {CUTOFF_MS} AND internal_date < {SINCE_MS} AND (direction = 'sent' OR EXISTS (SELECT 1 FROM (SELECT account, address FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY msgs_sent DESC, replied_count DESC, address) AS r FROM contacts WHERE msgs_sent > 0) WHERE r <= 500) c WHERE c.account = m.account AND c.address = {ADDR.format('m.from_addr')}))", FULL)
def backfill_slice(spark, sf_dir):
    return C.backfill_slice(mailbox(spark, sf_dir), _contacts(spark, sf_dir), CUTOFF_MS, SINCE_MS).select("account", "gmail_message_id")


@query("SELECT account, address, rank FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY msgs_received + msgs_sent DESC, address) AS rank FROM contacts) WHERE rank <= 20", FULL)
def contacts_by_volume(spark, sf_dir):
    return C.list_contacts(_contacts(spark, sf_dir), sort="volume").select("account", "address", "rank")


@query("SELECT account, address, rank FROM (SELECT account, address, row_number() OVER (PARTITION BY account ORDER BY last_seen DESC NULLS LAST, address) AS rank FROM contacts) WHERE rank <= 20", FULL)
def contacts_by_recency(spark, sf_dir):
    return C.list_contacts(_contacts(spark, sf_dir), sort="recency").select("account", "address", "rank")


@query("SELECT t.account, t.thread_id, msg_count, last_at FROM threads t JOIN pl USING (account, thread_id) WHERE list_contains(participants, (SELECT min(address) FROM contacts))", FULL)
def threads_of_contact(spark, sf_dir):
    m = mailbox(spark, sf_dir)
    first = R.contacts_rollup(m).agg(F.min("address").alias("who"))
    return R.threads_rollup(m).join(F.broadcast(first), F.array_contains("participants", F.col("who"))).select("account", "thread_id", "msg_count", "last_at")


@query(f"SELECT gmail_message_id, internal_date FROM mb WHERE list_contains(labels, 'INBOX') AND internal_date >= {CUTOFF_MS} AND internal_date < {SINCE_MS} ORDER BY internal_date DESC, gmail_message_id LIMIT 500")
def source_listing(spark, sf_dir):
    return TableSource(mailbox(spark, sf_dir), "me", NOW_MS).list_ids("in:inbox", "1997-01-01", "1998-01-01", 500, include_sent=False)


@query(f"SELECT account, gmail_message_id, internal_date, body_state FROM mb WHERE internal_date >= {CUTOFF_MS} AND internal_date < {SINCE_MS} AND direction = 'received'")
def source_scan(spark, sf_dir):
    """The mailbox stored by month and read through the registered source: of the files only a year's are read."""
    archive = VersionedTable(spark, shared_folder(spark, "archive"))
    archive.write(mailbox(spark, sf_dir))
    datasource.register(spark)
    columns = "account,gmail_message_id,internal_date,body_state,direction"
    rows = spark.read.format(datasource.FORMAT).option("path", archive.path).option("columns", columns).load()
    return rows.where((F.col("internal_date") >= CUTOFF_MS) & (F.col("internal_date") < SINCE_MS) & (F.col("direction") == "received")).drop("direction")


@query("SELECT page_id, len(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<img[^>]*>'), lambda t: regexp_matches(t, '(?i)src\\s*=\\s*.?[^\\s>\"'']'))) AS images FROM pages", "")
def image_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = I.parse_images(pages).groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("images"))


@query("SELECT * FROM (WITH acc AS (SELECT account || '-' || key % 4 AS account, CASE WHEN key % 4 < 3 THEN internal_date END AS d FROM mb), fin AS (SELECT DISTINCT account FROM acc WHERE right(account, 1) = '1') "
       "SELECT account, 'sync' AS phase, max(d) AS finished_at FROM acc ANTI JOIN fin USING (account) WHERE d IS NOT NULL GROUP BY account)")  # fmt: skip
def import_watermarks(spark, sf_dir):
    """Four accounts of each: without a run, with a failed finished one, with an unfinished one, and without a dated message."""
    m = mailbox(spark, sf_dir).select(F.concat_ws("-", "account", F.col("key") % 4).alias("account"), F.when(F.col("key") % 4 < 3, F.col("internal_date")).alias("internal_date"))
    kind = F.substring("account", -1, 1)
    made = m.select("account").distinct().where(kind.isin("1", "2")).select("account", F.when(kind == "1", 5).cast("long").alias("finished_at"), F.lit("failed").alias("error"))
    return ndjson.watermarks(m, made).select("account", "phase", "finished_at")


@query("SELECT event_type AS account, count(*) FILTER (event_id % 4 IN (0, 1)) AS queue_depth, max(event_id) FILTER (event_id % 3 = 0) AS last_sync FROM events GROUP BY event_type", "")
def queue_status(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("account"), F.when(F.col("event_id") % 3 == 0, "sync").otherwise("graph").alias("kind"), status.alias("status"), F.col("event_id").alias("created_at"))
    return runs.queue_status(jobs)


def _job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as jobs, their month pressed into an hour, so that both leases end within it."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    made = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 720).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 == 0, "sync").otherwise("graph").alias("kind"), F.concat_ws("-", "event_type", F.col("user_id") % 50).alias("account"), F.lit("{}").alias("params"),
        status.alias("status"), made.alias("created_at"), F.when(F.col("event_id") % 4 > 0, made).alias("started_at"), F.lit(None).cast("long").alias("finished_at"), F.lit(None).cast("string").alias("error"), (F.col("event_id") % 4 > 1).alias("terminal"))


JOBS_SQL = "jobs AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 'sync' ELSE 'graph' END AS kind, event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS account, (['queued', 'running', 'done', 'failed'])[event_id % 4 + 1] AS status, epoch_us(ts) // 1000 // 720 AS made FROM events), clock AS (SELECT max(made) AS now FROM jobs)"


@query("SELECT id, kind, account, CASE WHEN over THEN 'failed' ELSE status END AS status, CASE WHEN over AND status = 'running' THEN 'stale Job lock expired after 15 minutes' WHEN over THEN 'queued Job was never delivered' END AS error, "
       "CASE WHEN kind IN ('enrich_bulk', 'retention', 'backfill_slice', 'graph') THEN 'sweep' ELSE 'sync' END AS queue FROM (SELECT *, (status = 'running' AND made < now - 900000) OR (status = 'queued' AND made < now - 3000000) AS over FROM jobs, clock)", JOBS_SQL)  # fmt: skip
def job_leases(spark, sf_dir):
    rows = _job_rows(spark, sf_dir)
    now = rows.agg(F.max("created_at")).first()[0] or 0
    return jobs.expired(rows, now).select("id", "kind", "account", "status", "error", jobs.queue_of(F.col("kind")).alias("queue"))


@query("SELECT w.kind, w.account, l.id AS live, l.id IS NULL AS is_new FROM (SELECT DISTINCT kind, account FROM jobs) w LEFT JOIN (SELECT kind, account, arg_max(id, (made, id)) AS id FROM jobs, clock "
       "WHERE (status = 'running' AND made >= now - 900000) OR (status = 'queued' AND made >= now - 3000000) GROUP BY ALL) l USING (kind, account)", JOBS_SQL)  # fmt: skip
def job_enqueue(spark, sf_dir):
    rows = _job_rows(spark, sf_dir)
    now = rows.agg(F.max("created_at")).first()[0] or 0
    _, answers = jobs.enqueue(rows, rows.select("kind", "account", "params"), now)
    return answers.select("kind", "account", F.when(~F.col("is_new"), F.col("id")).alias("live"), "is_new")


@query("SELECT a.account, greatest(coalesce(l.last, f.floor), f.floor) AS since FROM (SELECT event_type AS account FROM events GROUP BY event_type) a CROSS JOIN (SELECT max(epoch_us(ts) // 1000) - 3600000 AS floor FROM events) f "
       "LEFT JOIN (SELECT event_type AS account, max(epoch_us(ts) // 1000) AS last FROM events WHERE event_id % 5 > 0 GROUP BY event_type) l USING (account)", "")  # fmt: skip
def due_syncs(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("event_type").alias("account"), F.unix_millis(F.col("ts").cast("timestamp")).alias("finished_at"), F.when(F.col("event_id") % 5 == 0, "failed").alias("error"))
    floor = (made.agg(F.max("finished_at")).first()[0] or 0) - 3_600_000
    return jobs.due_syncs(made.select("account", F.lit(None).cast("string").alias("auth_error")).distinct(), made, floor)


@query("SELECT event_type AS account, arg_max(event_id, (epoch_ms(ts), event_id)) AS id FROM events WHERE event_id % 2 = 0 AND epoch_ms(ts) >= (SELECT max(epoch_ms(ts)) FROM events) - 21600000 GROUP BY event_type", "")
def active_runs(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("event_type").alias("account"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at"))
    made = made.withColumn("finished_at", F.when(F.col("id") % 2 == 1, F.col("started_at")))
    return runs.active_runs(made, made.agg(F.max("started_at")).first()[0] or 0)


@query(f"SELECT host, {BRAND.format('host')} AS brand FROM (SELECT DISTINCT n_name AS n, 'a.b.' || lower(replace(n_name, ' ', '-')) || '.com' AS host FROM nation) UNION ALL SELECT 'shop.' || lower(replace(n_name, ' ', '-')) || '.' || s, lower(replace(n_name, ' ', '-')) || '.' || s FROM nation, (SELECT unnest(['co.uk', 'com.au', 'co.jp', 'com.br', 'co.za']) AS s)", "")
def two_label_suffixes(spark, sf_dir):
    slug = F.translate(F.lower("n_name"), " ", "-")
    nation = table(spark, sf_dir, "nation")
    plain = nation.select(F.concat(F.lit("a.b."), slug, F.lit(".com")).alias("host"))
    hosts = plain.union(nation.select(F.explode(F.array(*[F.concat(F.lit("shop."), slug, F.lit("." + x)) for x in ("co.uk", "com.au", "co.jp", "com.br", "co.za")]))))
    return hosts.withColumn("brand", S.registrable_domain(F.col("host")))


# --- streams


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL", "")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(
    "g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM i GROUP BY user_id, k",
    "",
)
def event_sessions(spark, sf_dir):
    return session_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


for _name in ("event_windows", "event_sessions"):
    if not ORACLE_SQL[_name].upper().startswith(("WITH", "SELECT")):
        ORACLE_SQL[_name] = "WITH " + ORACLE_SQL[_name]
