"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. `run` writes each stage's rows to the shared folder, reads them again and deletes
them once the next stage has been written.

Edge cases, alike in all stages: an empty table gives an empty one; columns other than those of documents are
dropped, so none can clash; rows with a null id are judged by their own text. Texts are read as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import WORD_CLASS, Scratch, table
from quillmesh.llm.decontaminate import clean_documents
from quillmesh.llm.line_dedup import LONG_WORDS, dedup_lines
from quillmesh.llm.mixing import mix
from quillmesh.llm.ngram_join import keep_one
from quillmesh.llm.quality import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and blank texts have no words and go; repeated rows are judged one by one; ratios at a threshold pass."""
    return quality(docs.select(*COLUMNS), keep_columns=True).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of single lines of over 50 words, are cut; a document of which no word is left goes.

    Null and empty texts stay as they are; of equal texts the one with the smallest id is the original, and rows equal in id and text count as one; n_chars follows the cut.
    """
    out = dedup_lines(docs.select(*COLUMNS), long_words=LONG_WORDS).where((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(WORD_CLASS), F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 80 percent) the document with the smallest id.

    Null, empty and blank texts and rows without an id are no duplicates and stay; rows that share the smallest id of their group all stay.
    """
    return keep_one(docs.select(*COLUMNS), k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts are clean, and so is all if the benchmark is empty."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by target weights of their sources, globally shuffled. A null source is a source; rows with one id get the same count."""
    return mix(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the near-duplicate stage; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), "docs")
    return STAGES[-1][1](spark, docs, sf_dir)
