"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.llm import linededup, minhash, packing, quality, tiling, tokenizing
from adlens.llm.common import documents, land
from adlens.llm.ship import send_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go from every text, and documents that fail the base figures or lose too much go as a whole."""
    send_package(spark)
    return quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines and sentences that an earlier document holds go; documents without a word left go too."""
    send_package(spark)
    return linededup.remove_repeated_lines(docs).select(*docs.columns).where(r"text IS NULL OR text RLIKE '[^\\x20\\x09-\\x0D]'")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    send_package(spark)
    return minhash.keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    send_package(spark)
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    send_package(spark)
    return packing.pack(docs, tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs


# Alignment, tiling and tokens are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
