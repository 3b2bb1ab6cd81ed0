"""Worker statistics and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100


def worker_stats(log: DataFrame) -> DataFrame:
    """Processed, failed, total and mean milliseconds and share of frames of each worker, gpu, and in all, in one pass."""
    out = log.rollup("gpu_id", "worker_id").agg(
        F.count("*").alias("frames"),
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if("failed").alias("failed"),
        F.round(F.sum("elapsed_ms"), 4).alias("total_ms"),
        F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"),
        F.grouping_id().alias("level"),
    )
    whole = F.max("frames").over(Window.partitionBy(F.lit(1)))  # over a row for each worker
    return out.withColumn("level", F.col("level").cast("int")).withColumn("share", F.round(F.col("frames") / whole, 6))


def running(rows: DataFrame, key: str, order: str, sums: dict[str, str], span: int) -> DataFrame:
    """rows with running sums by key in the order of a whole number: sums has the column of each result.

    A key's rows are cut in spans of `span` numbers; a window covers one span, or one row for each span.
    """
    rows = rows.withColumn("_span", F.floor(F.col(order) / span))
    upto = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(key, "_span").agg(*[F.sum(of).alias(f"_{name}") for name, of in sums.items()])
    before = whole.select(key, "_span", *[F.coalesce(F.sum(f"_{name}").over(upto), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [key, "_span"])
    return out.select(*rows.columns, *[(F.col(f"_{name}") + F.sum(of).over(inside)).alias(name) for name, of in sums.items()]).drop("_span")


def progress_marks(log: DataFrame, totals: DataFrame, key: str = "worker_id", span: int = 1 << 16) -> DataFrame:
    """At each 100th frame of a key: frames so far, percent of its total, and mean milliseconds so far.

    Frames are numbered in the order of frame_idx, which is unique in a key; sums go by blocks of
    100 frames. Both run by spans, so a key's log isn't in one task.
    """
    rows = running(log.select(key, "frame_idx", "elapsed_ms").withColumn("_one", F.lit(1)), key, "frame_idx", {"_n": "_one"}, span)
    sums = rows.groupBy(key, F.floor((F.col("_n") - 1) / BLOCK).alias("_block")).agg(F.count("*").alias("_c"), F.sum("elapsed_ms").alias("_ms"))
    sums = running(sums, key, "_block", {"written": "_c", "_all": "_ms"}, span).where(F.col("_c") == BLOCK)
    out = sums.join(totals.select(key, "total"), key)
    return out.select(key, "written", F.round(100 * F.col("written") / F.col("total"), 6).alias("percent"), F.round(F.col("_all") / F.col("written"), 9).alias("avg_ms"))
