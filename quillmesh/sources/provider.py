"""The source contract over a table of messages: scoped listings, metadata by id, whole messages, labels.

`TableSource` reads any messages table, be it parsed payloads, the mailbox projection or rows at hand, and so stands for
a provider where none can be reached. A listing is a plan: filters reach the scan, and a limit is a top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

BODY = ("body_text", "body_html")


class TableSource:
    def __init__(self, messages: DataFrame, address: str, now_ms: int, labels: DataFrame | None = None, provider: str = "table") -> None:
        self.messages, self.address, self.now_ms, self.labels, self.provider = messages, address, now_ms, labels, provider

    def check(self) -> dict:
        return {"ok": True, "address": self.address}

    def list_ids(self, query: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None, include_sent: bool = True) -> DataFrame:
        """(gmail_message_id, internal_date), newest first. Of a query the terms in:inbox, in:sent, from:x and from:{x y} count; until is exclusive."""
        rows = self.messages
        if since:
            rows = rows.where(F.col("internal_date") >= S.parse_since(since, self.now_ms))
        if until:
            rows = rows.where(F.col("internal_date") < S.parse_since(until, self.now_ms))
        if not include_sent:
            rows = rows.where(~F.array_contains("labels", "SENT"))
        for name in re.findall(r"(?i)\bin:(inbox|sent)\b", query or ""):
            rows = rows.where(F.array_contains("labels", name.upper()))
        for group, one in re.findall(r"(?i)\bfrom:(?:\{([^}]*)\}|(\S+))", query or ""):
            rows = rows.where(S.extract_address(F.col("from_addr")).isin([x.lower() for x in (group or one).split()]))
        rows = rows.select("gmail_message_id", "internal_date").orderBy(F.desc_nulls_last("internal_date"), "gmail_message_id")
        return rows if limit is None else rows.limit(limit)

    def metadata(self, ids: DataFrame) -> DataFrame:
        """ids (gmail_message_id, position) -> the known ones' metadata, without bodies, in the order of their positions."""
        known = self.messages.select(*[c for c in self.messages.columns if c not in BODY])
        return ids.join(known, "gmail_message_id").orderBy("position")

    def full(self, message_id: str) -> dict | None:
        found = self.messages.where(F.col("gmail_message_id") == message_id).limit(1).collect()
        return found[0].asDict() if found else None

    def list_labels(self) -> DataFrame | None:
        return self.labels
