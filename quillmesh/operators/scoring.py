"""Engagement scores, snapshots and curation proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Weights, half-saturation points and the half-life of the score.
WEIGHTS = {"replied": 3.0, "initiated": 3.0, "starred": 1.0, "important": 1.5, "read": 1.5, "recency": 0.5, "bulk": -2.0, "never_opened": -2.0}
HALF_COUNT, HALF_VOLUME, HALF_LIFE_DAYS = 3.0, 10.0, 60.0


def engagement(now_ms: int) -> Column:
    """The score of a row of contacts with bulk_count."""
    c = F.col
    received, sent = c("msgs_received"), c("msgs_sent")
    score = F.lit(0.0)
    for name in ("replied", "initiated", "starred", "important"):
        score = score + WEIGHTS[name] * S.saturate(c(f"{name}_count"), HALF_COUNT)
    some = received > 0
    share = lambda x: F.try_divide(x.cast("double"), received)
    score = score + F.when(some, WEIGHTS["read"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share(c("read_count"))))).otherwise(0.0)
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - c("last_seen")) / 86_400_000.0)
    decay = F.pow(F.lit(0.5), age / HALF_LIFE_DAYS) * S.saturate(received + sent, HALF_VOLUME)
    score = score + F.when(c("last_seen").isNotNull() & (received + sent > 0), WEIGHTS["recency"] * decay).otherwise(0.0)
    score = score + F.when(some, WEIGHTS["bulk"] * F.least(F.lit(1.0), share(F.coalesce("bulk_count", F.lit(0))))).otherwise(0.0)
    never = some & (c("read_count") == 0) & (c("replied_count") == 0) & (c("initiated_count") == 0)
    return score + F.when(never, WEIGHTS["never_opened"]).otherwise(0.0)


def score_contacts(contacts: DataFrame, bulk: DataFrame | None, now_ms: int) -> DataFrame:
    """bulk: `rollups.bulk_counts`, or None where the contacts have their bulk_count already."""
    rows = contacts if bulk is None else contacts.join(bulk, ["account", "address"], "left")
    rows = rows.withColumn("bulk_count", F.coalesce("bulk_count", F.lit(0)))
    return rows.withColumn("engagement_score", engagement(now_ms))


def snapshot(scored: DataFrame, now_ms: int) -> DataFrame:
    """The rows appended to contact_stats_snapshot by a scoring run."""
    return scored.select("account", "address", F.lit(now_ms).alias("taken_at"), "msgs_received", "read_count", "replied_count", "engagement_score")


def propose_contacts(scored: DataFrame, limit: int = 20) -> DataFrame:
    """The best contacts of each account with a suggested action; predominantly bulk ones count as lists."""
    from pyspark.sql import Window as W

    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("account").orderBy(F.desc("engagement_score"), "address"))).where(F.col("rank") <= limit)
    is_list = F.col("bulk_count") * 2 > F.col("msgs_received")
    return ranked.select(
        "account", "rank", "address", "display_name", "domain", "msgs_received", "msgs_sent", S.read_rate(F.col("read_count"), F.col("msgs_received")).alias("read_rate"), is_list.alias("is_list"),
        S.round2(F.col("engagement_score")).alias("score"), S.suggest_action(F.col("engagement_score"), is_list).alias("suggested"),
    )
