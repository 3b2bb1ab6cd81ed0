"""Token counts by an exact histogram of encoded lengths.

Documents are encoded whole and only their lengths are kept: rows are added up by length
before the shuffle. Suffix sums over the histogram then answer, for each length as a context
limit, how many documents are longer and how many tokens remain when all are cut to it, and
prefix sums give exact quantiles. The sums go in two levels, within blocks of SPAN lengths
and over blocks, so no task gets all lengths.

limits() has a row for each length that occurs; truncated_total() answers any other limit.
Null and empty texts have 0 tokens. Repeated rows count as often as they come. An empty table
gives no rows. Extra columns are left out. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch

SPAN = 256


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:  # the vocabulary file is installed on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoding(path, pattern).encode_ordinary
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])


def lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each row."""
    return docs.select(text_col).mapInArrow(partial(length_batches, path=path, pattern=pattern), "n_tokens long")


def histogram(rows: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) from a row for each document. It is written to the shared folder, so that
    documents are encoded once however often it is read."""
    return Scratch(rows.sparkSession, "token-histogram").save(rows.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a limit: n_docs of this length; tokens, theirs in all;
    docs_longer and tokens_longer, documents over the limit and their tokens; tokens_kept, all
    tokens when documents are cut to the limit; docs_upto, documents within it; quantile, their share."""
    hist = hist.withColumn("block", F.expr(f"n_tokens div {SPAN}")).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    after = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    by_block = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each SPAN lengths
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_block = by_block.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(all_rows).alias("all_d"), F.sum("t").over(all_rows).alias("all_t"))
    out = hist.withColumn("di", F.coalesce(F.sum("n_docs").over(after), F.lit(0))).withColumn("ti", F.coalesce(F.sum("tokens").over(after), F.lit(0))).join(by_block, "block")
    longer, longer_tokens = F.col("di") + F.col("d"), F.col("ti") + F.col("t")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        longer.alias("docs_longer"),
        longer_tokens.alias("tokens_longer"),
        (F.col("all_t") - longer_tokens + longer * F.col("n_tokens")).alias("tokens_kept"),
        (F.col("all_d") - longer).alias("docs_upto"),
        ((F.col("all_d") - longer) / F.col("all_d")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: n_docs, tokens and tokens_kept of all documents cut to any limit."""
    return hist.agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))).alias("tokens_kept"))


def quantile_length(table: DataFrame, q: float) -> DataFrame:
    """One row: the least length within which at least the share q of documents lies, from limits()."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
