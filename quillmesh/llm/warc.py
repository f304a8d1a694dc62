"""WARC: archives of web captures, written and read by Spark, and transaction assembly.

`write_warc` builds a request, a response (or revisit) and a metadata record per page as native
string expressions and writes them with Spark's text writer, whose line separator is the blank
line that ends a WARC record; so any store that Spark writes to can hold the archives, and a lost
task is simply written again. Payloads of at least `min_revisit_bytes` that are equal are stored
once: the smallest page_id holds the response, the others are revisits of it.

`read_warc` streams each archive (gzip or plain) record by record. `assemble` joins request and
metadata records to the response or revisit they are concurrent to and emits one nested row per
capture.

Archives are cut by bytes (`target_bytes` of payload each), so that a reader holds one file of
bounded size; equal payloads are found by digest with partial aggregation, the join back on the
digest is one that AQE splits where a payload is hot.

Edge cases: a null html is an empty payload, a null url an empty target; line breaks in urls are
percent-encoded; rows with equal page_id and payload are all responses if theirs is the smallest
page_id; pages with a null id get records of their own but are never the original of a
revisit; an empty table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

MIN_REVISIT_BYTES = 100
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def record_urn(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: Column | str, urn: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A WARC record without the blank line after it; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), urn), F.lit("WARC-Date: " + DATE)]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, target_bytes: int = 64 << 20) -> None:
    payload = F.coalesce(F.col("html"), F.lit(""))
    target = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select("page_id", target.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    sizes = pages.select(F.sum(F.octet_length(payload)).alias("b")).first()["b"] or 0
    groups = base.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    known = base.select("page_id", "digest").join(groups, "digest").dropDuplicates(["page_id", "digest"])
    files = max(1, math.ceil(sizes / target_bytes), min(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(sizes / (1 << 20))))
    # one shuffle of the payloads: it cuts the archives and is the one that the join needs
    rows = base.repartition(files, "page_id", "digest").join(known.repartition(files, "page_id", "digest"), ["page_id", "digest"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False)) | (F.col("first").isNotNull() & F.col("page_id").isNull())
    own, first = record_urn("capture", F.col("page_id"), F.col("digest")), record_urn("capture", F.col("first"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    capture = record(
        F.when(revisit, "revisit").otherwise("response"), own,
        [uri, digest, ("WARC-Profile", profile), ("WARC-Refers-To", F.when(revisit, first)), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = record("request", record_urn("request", F.col("page_id"), F.col("digest")), [uri, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], F.lit("GET / HTTP/1.1" + END))
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadLength: "), F.col("bytes").cast("string")), F.when(revisit, F.concat(F.lit("refersToPageId: "), F.col("first").cast("string"))), F.lit(""))
    metadata = record("metadata", record_urn("metadata", F.col("page_id"), F.col("digest")), [uri, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    lines = rows.select(F.concat(request, F.lit(END), capture, F.lit(END), metadata).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, headers map<string,string>, payload binary, payload_bytes bigint, payload_digest string, digest_ok boolean"
ARROW = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
)


def records_in(content: bytes, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; gzip members are decompressed piece by piece."""

    def pieces() -> Iterator[bytes]:
        view = memoryview(content)
        if content[:2] != b"\x1f\x8b":
            for i in range(0, len(view), piece):
                yield bytes(view[i : i + piece])
            return
        at, zipped = 0, zlib.decompressobj(31)
        while at < len(view):
            yield zipped.decompress(view[at : at + piece])
            at += piece
            while zipped.eof and zipped.unused_data:  # the next member
                rest, zipped = zipped.unused_data, zlib.decompressobj(31)
                yield zipped.decompress(rest)
            if zipped.eof:
                zipped = zlib.decompressobj(31)

    source, buffer = pieces(), bytearray()

    def fill() -> bool:
        more = next(source, None)
        if more is None:
            return False
        buffer.extend(more)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill():
                if buffer.strip():
                    raise ValueError("a WARC record breaks off in its header")
                return
        head = buffer[:end].decode("utf-8").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record: " + head[0][:60])
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int({k.lower(): v for k, v in headers.items()}["content-length"])
        while len(buffer) < end + 4 + size:
            if not fill():
                raise ValueError("a WARC record breaks off in its block")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        while len(buffer) < end + 8 + size and fill():
            pass
        del buffer[: end + 8 + size]


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record; payload is the HTTP body of responses, the whole block of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in ARROW.names}
        held = 0
        for batch in batches:
            for cell in batch.column(0):
                for headers, block in records_in(cell.as_py()):
                    kind, stated = headers.get("WARC-Type"), headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
                    found = hashlib.sha256(payload).hexdigest() if kind == "response" else stated
                    row = (headers.get("WARC-Record-ID"), kind, headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), list(headers.items()), payload, len(payload), found, stated in (None, found))
                    for name, value in zip(ARROW.names, row, strict=True):
                        out[name].append(value)
                    held += len(payload) + 1000
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_pydict(out, schema=ARROW)
                        out, held = {name: [] for name in ARROW.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def warc_field(block: Column, name: str) -> Column:
    """A field of an application/warc-fields block."""
    return F.nullif(F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: capture (struct), request (struct), metadata (struct; the smallest record id of several, n_metadata tells how many)."""
    captures = records.where(F.col("type").isin("response", "revisit"))
    captures = captures.select("record_id", F.struct("record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload").alias("capture"))
    others = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    one = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "payload")))
    joined = others.groupBy(F.col("concurrent_to").alias("record_id")).agg(one("request").alias("request"), one("metadata").alias("metadata"), F.count_if(F.col("type") == "metadata").alias("n_metadata"))
    return captures.join(joined, "record_id", "left").drop("record_id")


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives to a new folder of the shared one, read them back and report per capture."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    step = assemble(read_warc(spark, path)).select("capture.type", "capture.payload_bytes", "capture.payload_digest", "metadata.payload")
    number = lambda name: warc_field(F.col("payload"), name).cast("long")
    return step.select(
        number("pageId").alias("page_id"),
        F.when(F.col("type") == "revisit", number("payloadLength")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", number("refersToPageId")).alias("refers_to"),
    )


WARC_SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM m
"""
