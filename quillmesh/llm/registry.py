"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, format_conversations, read_back, with_probe
from .common import table
from .decontaminate import DECONTAMINATE_SQL, decontaminate
from .fim import FIM_SQL, fim_digest
from .licenses import scan_licenses
from .line_dedup import LINE_DEDUP_SQL, line_dedup_digest
from .mixing import MIX_SQL, mix
from .ngram_join import similar_classes
from .passage_quality import passage_quality
from .quality import QUALITY_SQL, quality
from .sessions import SESSIONS_SQL, conversation_events, session_versions
from .suffix_dedup import suffix_dedup_digest
from .toxicity import toxicity
from .warc import WARC_SQL, warc_round_trip


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(table(spark, sf_dir, "documents"))


def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_versions(conversation_events(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_ngram_join": op2_ngram_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op3_mixing": op3_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_passage_quality": op12_passage_quality,
    "op13_late_sessions": op13_late_sessions,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": MIX_SQL, "op6_line_dedup": LINE_DEDUP_SQL, "op7_warc": WARC_SQL, "op8_chat": CHAT_SQL, "op9_quality": QUALITY_SQL, "op10_decontaminate": DECONTAMINATE_SQL, "op11_fill_in_middle": FIM_SQL, "op13_late_sessions": SESSIONS_SQL}
