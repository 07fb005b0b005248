"""A corpus pipeline of four stages: toxic documents go, one of each group of near copies stays, sources are mixed to target
weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmap.llm import common, lattice, minhash, mixing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity reaches the threshold of their language."""
    model, thresholds = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model, thresholds)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return minhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does."""
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the mixed documents; doc_id, n_tokens, ids_crc32, n_chars and whether decoding gives the text back."""
    return lattice.digest_documents(docs, common.tokenizer_path(lattice.MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier, the samples and the BPE merges are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, f"pipeline-{name}")
    return docs
