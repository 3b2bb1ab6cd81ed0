"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtables.llm import collocations, decontamination, licences, line_dedup, ngram_join, preferences, quality_rules, sentencepiece_bpe, token_counts, toxicity, url_filters, vector_codes, warc

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.paired(preferences.format_pairs(preferences.paired_by_id(table(spark, sf_dir, "conversations"))))
    spans = {c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",") for c in ("chosen_spans", "rejected_spans")}
    return pairs.withColumns(spans)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path(PIECES), full=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.limits(token_counts.histogram(rows))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", F.col("error").try_cast("long").alias("error"), F.col("label_error").try_cast("long").alias("label_error"), "codebooks_sha256")


def queries() -> dict:
    found = (
        op1_decontamination,
        op2_preference_format,
        op3_url_filters,
        op4_licence_scan,
        op5_sentencepiece,
        op6_ngram_jaccard_join,
        op7_token_counts,
        op8_toxicity,
        op9_warc,
        op10_quality_rules,
        op11_line_dedup,
        op12_collocations,
        op13_vector_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preference_format": preferences.ORACLE,
        "op4_licence_scan": licences.oracle(),
        "op9_warc": warc.ORACLE,
        "op10_quality_rules": quality_rules.ORACLE,
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_vector_codes": vector_codes.oracle(),
    }
