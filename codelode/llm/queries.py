"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from codelode.llm import (
    align, chat, exact, language, lattice, merkle, mixing, packing, pii, quality, shards, simhash,
    toxicity,
)
from codelode.llm.checks import CHECKS as OPERATOR_CHECKS

Query = Callable[[SparkSession, str], DataFrame]


def _over(report: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: report(*(
        spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Query] = {
    "op1_sharding": _over(shards.shard_report, "documents"),
    "op2_quality_rules": _over(quality.quality_report, "documents"),
    "op3_mixing": _over(mixing.mix_report, "documents"),
    "op4_simhash": _over(simhash.near_report, "documents"),
    "op5_exact_dedup": _over(exact.duplicates_report, "documents"),
    "op6_toxicity": _over(toxicity.toxicity_report, "documents", "labels"),
    "op7_pii": _over(pii.pii_report, "documents"),
    "op8_packing": _over(packing.packing_report, "documents"),
    "op9_language": _over(language.language_report, "documents"),
    "op10_chat": _over(chat.chat_report, "conversations"),
    "op11_embeddings": _over(lattice.vector_report, "embeddings"),
    "op12_alignment": _over(align.alignment_report, "documents"),
    "op13_merkle": _over(merkle.manifest_report, "documents"),
    "pipeline": corpus_pipeline.run,
}
CHECKS: dict[str, str] = dict(OPERATOR_CHECKS)
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
