"""Provider payloads: JSON exports of messages to metadata rows, bodies and attachments."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

HEADER = "array<struct<name:string,value:string>>"


PART = f"struct<partId:string,mimeType:string,filename:string,headers:{HEADER},body:struct<attachmentId:string,size:bigint,data:string>>"
PAYLOAD = f"id string, threadId string, labelIds array<string>, snippet string, sizeEstimate bigint, internalDate string, payload {PART}"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """The typed top of each payload, and its whole MIME tree as JSON in `tree`."""
    return lines.select(F.from_json(column, PAYLOAD).alias("m"), F.get_json_object(column, "$.payload").alias("tree")).select("m.*", "tree")


def header(headers: Column, name: str) -> Column:
    """The first header of that name, in any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def metadata(parsed: DataFrame, account: str, own: list[str]) -> DataFrame:
    """Classified metadata rows."""
    h = F.col("payload.headers")
    bag = F.map_from_entries(F.array_distinct(F.transform(F.coalesce(h, F.array().cast(HEADER)), lambda x: F.struct(F.lower(x["name"]).alias("key"), F.lit("").alias("value")))))
    labels = F.coalesce("labelIds", F.array().cast("array<string>"))
    sender = header(h, "From")
    return parsed.select(
        F.lit(account).alias("account"), F.col("id").alias("gmail_message_id"), F.col("threadId").alias("thread_id"), F.col("internalDate").cast("long").alias("internal_date"), header(h, "Date").alias("date_header"),
        sender.alias("from_addr"), header(h, "To").alias("to_addr"), header(h, "Cc").alias("cc_addr"), header(h, "Reply-To").alias("reply_to"), header(h, "Subject").alias("subject"), labels.alias("labels"),
        S.classify_category(labels).alias("category"), S.classify_is_list(bag).alias("is_list"), S.classify_direction(labels, S.extract_address(sender), F.array(*[F.lit(x.lower()) for x in own]).cast("array<string>")).alias("direction"),
        *[S.flag(labels, f.upper()).alias(f) for f in ("unread", "starred", "important")], F.col("sizeEstimate").alias("size_estimate"), "snippet", F.lit("meta").alias("body_state"),
    )


def binary(data: Column) -> Column:
    """The bytes of base64url data, null if there is none. Padding and blanks (line breaks of a sender that folds its lines) do not count; a last character that is no whole byte is dropped."""
    clean = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), [("-", "+"), ("_", "/"), *((blank, "") for blank in "= \t\r\n")], data)
    bytes_of = lambda text: F.unbase64(F.substring(text, F.lit(1), F.length(text) - F.when(F.length(text) % 4 == 1, 1).otherwise(0)))
    return F.when(data != "", F.get(F.transform(F.array(clean), bytes_of), 0))  # the lambda's variable stands for the clean text, which is made once


def decoded(data: Column) -> Column:
    """Text of base64url data."""
    return binary(data).cast("string")


LEAVES = pa.schema([("id", pa.string()), ("at", pa.int64()), ("path", pa.string()), ("mime_type", pa.string()), ("filename", pa.string()), ("attachment_id", pa.string()), ("size", pa.int64()), ("data", pa.string())])


def parts_of(tree: str | None) -> Iterator[tuple]:
    """The parts of a MIME tree of any depth in the order of a walk from the top: number, path of child indexes and fields."""
    stack = [((), json.loads(tree))] if tree else []
    at = 0
    while stack:
        path, part = stack.pop()
        if not isinstance(part, dict):
            continue
        body = part.get("body") or {}
        yield at, ".".join(map(str, path)), part.get("mimeType"), part.get("filename"), body.get("attachmentId"), body.get("size"), body.get("data")
        at += 1
        stack += [((*path, i), child) for i, child in reversed(list(enumerate(part.get("parts") or [])))]


def leaves(parsed: DataFrame) -> DataFrame:
    """(id, at, path, mime_type, filename, attachment_id, size, data): every MIME part; `at` orders them as a walk does. A tree has no depth that a schema could name, so this is a function over its JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *part) for i, tree in zip(*(batch.column(c).to_pylist() for c in ("id", "tree")), strict=True) for part in parts_of(tree)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(LEAVES)], schema=LEAVES)

    return parsed.select("id", "tree").mapInArrow(run, "id string, at bigint, path string, mime_type string, filename string, attachment_id string, size bigint, data string")


def bodies(parsed: DataFrame) -> DataFrame:
    """(id, text, html): the first text/plain and the first text/html part with data."""
    rows = leaves(parsed).where("coalesce(data, '') <> ''")
    first = lambda kind: F.min(F.when(F.col("mime_type") == kind, F.struct("at", "data")))["data"]
    found = rows.groupBy("id").agg(first("text/plain").alias("t"), first("text/html").alias("h"))
    return parsed.select("id").join(found, "id", "left").select("id", decoded(F.col("t")).alias("text"), decoded(F.col("h")).alias("html"))


# Types that are never stored, and the largest size.
BLOCKED_TYPES = ["application/x-msdownload", "application/x-dosexec"]
MAX_ATTACHMENT = 25 * 1024 * 1024
NOT_PERSONAL = ["list-id", "list-unsubscribe", "auto-submitted"]


def attachments(parsed: DataFrame) -> DataFrame:
    """One row per part with a filename and content; parts whose data is inline get an id from their path."""
    rows = leaves(parsed).withColumn("filename", S.js_trim(F.col("filename"))).where("coalesce(filename, '') <> ''")
    inline = F.col("attachment_id").isNull()
    rows = rows.where(~inline | (F.coalesce("data", F.lit("")) != ""))
    kind = F.coalesce(S.blank_to_null(S.js_trim(F.col("mime_type"))), F.lit("application/octet-stream"))
    key = F.when(inline, F.concat(F.lit("inline:"), F.col("path"))).otherwise(F.col("attachment_id"))
    return rows.select("id", key.alias("attachment_id"), "filename", kind.alias("mime_type"), F.coalesce("size", F.lit(0)).alias("size_bytes"), inline.alias("inline"), F.when(inline, F.col("data")).alias("inline_data"))


def personal(parsed: DataFrame) -> DataFrame:
    """The payloads whose attachments are stored: neither spam nor trash, nor with a header of lists or of automatic replies."""
    labels = F.transform(F.coalesce("labelIds", F.array().cast("array<string>")), F.upper)
    names = F.transform(F.coalesce("payload.headers", F.array().cast(HEADER)), lambda h: F.lower(h["name"]))
    return parsed.where(~F.arrays_overlap(labels, F.array(F.lit("SPAM"), F.lit("TRASH"))) & ~F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, NOT_PERSONAL))), F.lit(False)))


def storable(parsed: DataFrame, account: str, fetched: DataFrame | None = None) -> DataFrame:
    """Each attachment's import: status stored, rejected_by_policy (size or type) or unavailable (no bytes at hand), and where it is stored. fetched: (id, attachment_id, data) of parts that the provider keeps apart, as standard base64."""
    rows = attachments(personal(parsed))
    refused = (F.col("size_bytes") > MAX_ATTACHMENT) | F.lower("mime_type").isin(BLOCKED_TYPES)
    if fetched is None:
        rows = rows.withColumn("data", F.lit(None).cast("string"))
    else:
        rows = rows.join(fetched.select("id", "attachment_id", "data"), ["id", "attachment_id"], "left")
    encoded = F.when(F.col("inline"), F.col("inline_data")).otherwise(F.col("data"))
    status = F.when(refused, "rejected_by_policy").when(F.coalesce(encoded, F.lit("")) == "", "unavailable").otherwise("stored")
    name = S.safe_filename(F.col("filename"))
    place = F.concat(F.lit("crm/"), F.url_encode(F.lit(account)), F.lit("/"), F.url_encode("id"), F.lit("/"), F.url_encode("attachment_id"), F.lit("-"), name)
    rows = rows.select("id", "attachment_id", "filename", "mime_type", "size_bytes", status.alias("status"), name.alias("stored_name"), place.alias("place"), encoded.alias("encoded"))
    kept = F.col("status") == "stored"
    return rows.withColumns({"storage_key": F.when(kept, F.replace("place", F.lit("+"), F.lit("%20"))), "content": F.when(kept, binary(F.col("encoded")))}).drop("place", "encoded")


def attachment_events(stored: DataFrame, account: str) -> DataFrame:
    """The change feed's events of attachments that were stored or refused, for `feed.append`."""
    rows = stored.where("status <> 'unavailable'")
    kept = F.col("status") == "stored"
    entity = F.concat_ws(":", "id", "attachment_id")
    size = F.when(kept, F.octet_length("content").cast("long")).otherwise(F.col("size_bytes"))
    fields = [F.col("id").alias("messageKey"), F.when(kept, F.col("stored_name")).otherwise(F.col("filename")).alias("filename"), F.col("mime_type").alias("mimeType"), size.alias("sizeBytes"), F.col("storage_key").alias("storageKey"), F.col("status").alias("importStatus")]
    key = F.concat_ws(":", F.lit("attachment"), F.lit(account), entity, F.coalesce("storage_key", F.lit("rejected")))
    return rows.select(F.lit(account).alias("account"), F.lit("attachment").alias("entity_type"), entity.alias("entity_key"), F.lit("upsert").alias("operation"), F.lit(None).cast("string").alias("reason"), F.to_json(F.struct(*fields)).alias("payload"), key.alias("dedupe_key"))
