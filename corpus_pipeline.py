"""From raw documents to packed sequences: quality rules, exact and near duplicates, mixing of
sources, packing. Stages hand over Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import exact, mixing, packing, quality, simhash
from codelode.sources.scratch import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, documents that are rejected go."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (fingerprints of 3-word shingles, at most 3 bits apart) the row
    with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    columns = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.withColumnsRenamed(columns), id_col=columns["doc_id"],
                       source_col=columns["source"], text_col=columns["text"])
    return mixing.repeat_rows(mixed).select(*columns.values()).withColumnsRenamed(
        {v: k for k, v in columns.items()})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packing_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: The near-duplicate and packing stages cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
