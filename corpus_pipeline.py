"""Corpus pipeline: the stages that turn the documents table into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormcell.llm import mixing, ngram_join, packing, passages, quality_rules
from stormcell.llm.catalog import tokenizer_path
from stormcell.llm.common import stage_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the isolation forest reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near duplicates."""
    return ngram_join.keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a document with a smaller doc_id holds too."""
    return passages.without_passages(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of small sources again, as their source's budget asks; the stage's files are
    the mixed order (packing then places pieces by their lengths)."""
    mixed = mixing.mix(docs, mixing.bpe_tokens(spark, tokenizer_path()))
    return mixing.in_order(mixed).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and offset."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup),
          ("source_mixing", source_mixing), ("sequence_packing", sequence_packing)]
#: The forest, the tokenizer and the packing plan have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
