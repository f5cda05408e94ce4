"""A corpus pipeline of the operators in peakforge.llm: documents in, the digests of a token file out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakforge.llm import decontam, mixing, neardup, quality, tokens
from peakforge.llm.queries import TOKENIZER
from peakforge.llm.store import drop, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return neardup.first_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources meet their targets."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_digests(tokens.write_tokens(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
    ("token output", token_output),
]

#: The perplexity model and the tokenizer can't be told in SQL; tests/llm/test_pipeline.py holds run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last:
            drop(last)
        last = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # its token files are written by now
    drop(docs)
    return out
