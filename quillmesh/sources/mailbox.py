"""The driver's tables seen as a mailbox: a deterministic projection, as Spark and as SQL.

Orders are messages, customers are correspondents, regions are accounts; document texts give
subjects, snippets and bodies. `mailbox` has the columns of the messages table; with_text=False
leaves the texts (and so the join with documents) out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CATEGORY_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_UPDATES", "CATEGORY_FORUMS", "CATEGORY_PERSONAL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as correspondents: account, own address, address, header, the next customer of the nation."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    slug = lambda x: F.translate(F.lower(x), "_ ", "--")
    sub = F.element_at(F.array(*map(F.lit, ("mail", "news", "www"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), sub, F.lit("."), slug(F.col("n_name")), F.lit(".com"))
    c = c.select("c_custkey", "c_name", "c_nationkey", F.col("r_name").alias("account"), F.concat(F.lit("me@"), slug(F.col("r_name")), F.lit(".org")).alias("own"), address.alias("address"), (F.col("c_mktsegment") == "MACHINERY").alias("is_list"))
    return c.withColumn("partner", F.lead("address").over(W.partitionBy("c_nationkey").orderBy("c_custkey"))).withColumn("header", F.concat("c_name", F.lit(" <"), "address", F.lit(">")))


def mailbox(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    k = F.col("o_orderkey")
    writers = people(spark, sf_dir).hint("shuffle_hash")  # or orders may be broadcast to the few tasks that the window leaves
    m = table(spark, sf_dir, "orders").join(writers, F.col("o_custkey") == F.col("c_custkey"))
    sent = k % 4 == 0
    labels = F.array_compact(
        F.array(
            F.when(sent, "SENT").otherwise("INBOX"), F.when((k % 3 == 0) & ~sent, "UNREAD"), F.when(F.col("o_orderpriority") == "1-URGENT", "STARRED"), F.when(F.col("o_orderpriority") == "2-HIGH", "IMPORTANT"),
            F.get(F.array(*map(F.lit, CATEGORY_LABELS)), (F.col("o_custkey") % 6).cast("int")),
        )
    )
    state = F.when(k % 7 == 0, "full").when(k % 7 == 1, "summary-only").otherwise("meta")
    m = m.select(
        "account", F.concat(F.lit("o"), k.cast("string")).alias("gmail_message_id"), F.concat(F.lit("t"), F.col("o_custkey").cast("string"), F.lit("-"), (k % 3).cast("string")).alias("thread_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("internal_date"), F.when(sent, F.col("own")).otherwise(F.col("header")).alias("from_addr"), F.when(sent, F.col("header")).otherwise(F.col("own")).alias("to_addr"),
        F.when(k % 5 < 2, F.col("partner")).alias("cc_addr"), labels.alias("labels"), "is_list", "own", state.alias("body_state"), k.alias("key"),
    )
    m = m.withColumn("direction", F.when(F.array_contains("labels", "SENT"), "sent").otherwise("received"))
    m = m.withColumns({f: F.array_contains("labels", f.upper()).cast("int") for f in ("unread", "starred", "important")})
    from ..functions.scalars import classify_category

    m = m.withColumn("category", classify_category(F.col("labels")))
    if not with_text:
        return m
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    m = m.join(F.broadcast(n)).withColumn("doc_id", F.col("key") % F.col("n")).join(docs, "doc_id", "left").drop("n", "doc_id")
    text = F.col("text")
    return m.withColumns(
        {
            "subject": F.translate(F.substring(text, 1, 60), "\n", " "),
            "snippet": F.substring(text, 1, 200),
            "body_text": F.when(F.col("body_state") == "full", text),
            "summary_text": F.when(F.col("body_state") == "summary-only", F.substring(text, 1, 100)),
        }
    ).drop("text")


def _case(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PEOPLE_SQL = f"""
people AS (SELECT c_custkey, c_name, c_nationkey, r_name AS account, 'me@' || replace(replace(lower(r_name), '_', '-'), ' ', '-') || '.org' AS own, c_mktsegment = 'MACHINERY' AS is_list,
  'c' || c_custkey || '@' || {_case("c_custkey % 3", ("mail", "news", "www"))} || '.' || replace(replace(lower(n_name), '_', '-'), ' ', '-') || '.com' AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ppl AS (SELECT *, lead(address) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS partner, c_name || ' <' || address || '>' AS header FROM people)"""

#: CTEs people, ppl, mb (without texts) and mt (with them).
MAILBOX_SQL = f"""{PEOPLE_SQL},
m0 AS (SELECT account, 'o' || o_orderkey AS gmail_message_id, 't' || o_custkey || '-' || (o_orderkey % 3) AS thread_id, epoch_ms(o_orderdate) AS internal_date,
  CASE WHEN o_orderkey % 4 = 0 THEN own ELSE header END AS from_addr, CASE WHEN o_orderkey % 4 = 0 THEN header ELSE own END AS to_addr, CASE WHEN o_orderkey % 5 < 2 THEN partner END AS cc_addr,
  list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'SENT' ELSE 'INBOX' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'UNREAD' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'STARRED' END,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'IMPORTANT' END, {_case("o_custkey % 6", CATEGORY_LABELS)}], lambda x: x IS NOT NULL) AS labels,
  is_list, own, CASE o_orderkey % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'summary-only' ELSE 'meta' END AS body_state, o_orderkey AS key
  FROM orders JOIN ppl ON o_custkey = c_custkey),
mb AS (SELECT *, CASE WHEN list_contains(labels, 'SENT') THEN 'sent' ELSE 'received' END AS direction, list_contains(labels, 'UNREAD')::INT AS unread, list_contains(labels, 'STARRED')::INT AS starred,
  list_contains(labels, 'IMPORTANT')::INT AS important,
  CASE WHEN list_contains(labels, 'CATEGORY_PERSONAL') THEN 'personal' WHEN list_contains(labels, 'CATEGORY_SOCIAL') THEN 'social' WHEN list_contains(labels, 'CATEGORY_PROMOTIONS') THEN 'promotions'
    WHEN list_contains(labels, 'CATEGORY_UPDATES') THEN 'updates' WHEN list_contains(labels, 'CATEGORY_FORUMS') THEN 'forums' WHEN list_contains(labels, 'INBOX') THEN 'primary' END AS category FROM m0),
mt AS (SELECT mb.*, replace(substr(text, 1, 60), chr(10), ' ') AS subject, substr(text, 1, 200) AS snippet, CASE WHEN body_state = 'full' THEN text END AS body_text,
  CASE WHEN body_state = 'summary-only' THEN substr(text, 1, 100) END AS summary_text
  FROM mb LEFT JOIN documents ON doc_id = key % (SELECT count(*) FROM documents))"""
