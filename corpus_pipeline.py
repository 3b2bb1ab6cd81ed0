"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, decontamination, SentencePiece.

Each stage works on all rows that the one before has kept and returns the columns of
documents; the last returns the encoded documents.

Rows without text, or with too few words, go with the quality rules. Of rows that share an id one
stays. Rows without id are judged like others and have no near duplicates. Columns beyond those of
documents pass through, whatever their names. An empty table gives no rows; without labels of both
kinds no document is toxic, without a benchmark none is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vidtables.llm import decontamination, ngram_join, quality_rules, sentencepiece_bpe, toxicity
from vidtables.llm.queries import PIECES, table
from vidtables.llm.scratch import Scratch


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.drop_toxic(docs, network)


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path(PIECES), full=False)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality_rules", of_good_quality),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None  # a trained network and an encoder aren't SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What one hands to the next is written to the shared folder and read from there; it goes
    when the next has written its own."""
    docs, held, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if held is not None:
            scratch.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
