"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickmill.llm.common import read, table
from clickmill.llm.contamination import drop_contaminated
from clickmill.llm.jaccard import keep_one_per_group
from clickmill.llm.language import keep_identified
from clickmill.llm.mixing import mix_documents
from clickmill.llm.queries import MOST_PASSES, tokenizer_file
from clickmill.llm.tokenfiles import token_index


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows stay."""
    return keep_identified(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, directly or
    through others, the one with the smallest id stays."""
    return keep_one_per_group(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut short or repeated so that their tokens come in the weights of the mixture, at most
    ``MOST_PASSES`` times over."""
    return mix_documents(docs, most_passes=MOST_PASSES)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files with their index, read back by key: one row per document."""
    return token_index(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("near_copies", remove_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: The language network, the alignment and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
