"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. language ID: documents without a letter (language `und`) go.
2. near duplicates: of each group of linked documents the one with the least doc_id stays; without a doc_id, one of them.
3. substring dedup: repeated passages are cut out; a document of which nothing is left goes, others lose no clean word.
4. benchmark decontamination: documents that hold a test item go.
5. best-fit packing: what is left, packed into sequences.

Stages 3 and later change text only where something is removed; n_chars follows it.

Cases: null, empty and letterless texts go in stage 1 and pass the others, if these are given them; a null doc_id is a document like others, which no leak or group
names, except that of a group with no other id one row stays; rows that repeat the doc_id that stays all stay, and go together where it holds a test item; very long
texts are worked whole; an empty table, of documents or of test items, gives an empty or an unchanged one; further columns of documents are dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import crc_remainder, read_table, shared_dir
from sightline.llm.decontaminate import contaminated
from sightline.llm.jaccard import without_copies
from sightline.llm.language import UNKNOWN, fit, identify
from sightline.llm.packing import pack_documents
from sightline.llm.substring import remove_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parser = fit(docs.where(crc_remainder(4) != 2))
    return identify(docs, parser).where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_duplicates(docs)
    changed = F.col("n_removed") > 0
    kept = cut.where(~changed | (F.col("n_words") > F.col("n_removed")))
    return kept.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
