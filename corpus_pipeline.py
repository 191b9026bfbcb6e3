"""A corpus pipeline of five stages; each works on all that the one before kept.

Null texts and texts under 50 words fail the quality rules and go; repeated rows are one group, of which one stays; very
long texts are taken whole; columns beyond those of documents are carried along, whatever their names; empty tables
give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelens.llm.common import Scratch, table
from tracelens.llm.decontamination import clean_documents
from tracelens.llm.mixing import mix_documents
from tracelens.llm.ngram_join import one_of_each
from tracelens.llm.quality_rules import filter_documents
from tracelens.llm.token_output import token_output

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return filter_documents(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mixture's proportions; some come more than once."""
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document as read back from the token files."""
    return token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("source mixing", source_mixing), ("token-ID output", token_files)]

#: The quantile fences, hashes and token ids have no DuckDB form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES[:-1]:
        now = Scratch()
        docs = now.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        before.clear()  # its successor is written: one copy of the documents is kept
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
