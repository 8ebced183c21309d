"""From raw documents to token ids: five stages, each an operator of wordloom.llm.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of docs, but for the last, which returns token ids. In every stage an empty table gives an empty one,
and columns of docs other than doc_id and text, whatever their names, go through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from wordloom.llm.registry import tokenizer_definition
from wordloom.llm.shared import documents, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a network fitted on the labelled documents among them.

    Null and empty texts score as a text without words; null ids are scored and can't be labelled. A score at the
    threshold goes. Repeated rows are scored each, and stay or go together. Without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels, toxicity.in_training()))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then that of the smallest id.

    Null texts are one group with texts of white space only. Null ids come after all others. Of rows with one id and
    one text, one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.8 or more; that of the smallest id.

    Null texts and texts without words are linked with nothing and stay. Null ids come after all others. Rows with one
    id and other texts are judged by themselves; rows equal in id and text stay or go together.
    """
    return near_dedup.drop_near_duplicates(docs, k=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's passage, at a similarity of 0.8 of five-word shingles or more, which counts as one.

    Null and short texts hold none and stay. Null ids and repeated rows are judged by their texts.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), decoded: token ids, and the text that they give back; docs' other columns are dropped.

    A null text is empty and has no ids; null ids stay null; every row gives a row.
    """
    return bpe.encode_decode(docs, tokenizer_definition())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", deduplicate),
    ("near_dedup", deduplicate_near),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: A trained network decides in the first stage, which SQL can't express; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
