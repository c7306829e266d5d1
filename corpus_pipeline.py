"""From raw documents to token files: one stage after the other, each written and read again.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spectral_topics.functions.storage import materialize
from spectral_topics.llm import decontaminate, mixing, simhash, token_output, toxicity
from spectral_topics.llm.common import shuffles_deleted, table
from spectral_topics.llm.queries import END_ID, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays."""
    return simhash.near_unique(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out of the texts; documents that held nothing else go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source comes near its target."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, described as read back: doc_id, start, n_tokens, ids_crc32."""
    found = token_output.token_output(docs, tokenizer("word_bpe_49k.json"), END_ID)
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with shuffles_deleted(spark):
            docs = materialize(found, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The CRF, SimHash and the tokenizer can't be written in SQL; tests compare every stage with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
