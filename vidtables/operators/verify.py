"""Checks of segments, counts and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtables.operators.segments import KEY, contiguous_prefix, frames_missing_extra, segment_sample, segments_ordered
from vidtables.sources.shared import configured, shared_table


def segment_verify(recorded: DataFrame, rows: DataFrame) -> DataFrame:
    """Recorded frames of each segment against the rows that are there: dropped, corrected or ok."""
    return _verified(recorded, rows.groupBy(*KEY).agg(F.count("*").alias("actual")))


def _verified(recorded: DataFrame, real: DataFrame) -> DataFrame:
    out = recorded.join(real, KEY, "left").na.fill(0, ["actual"])
    status = F.when(F.col("actual") == 0, "dropped").when(F.col("actual") != F.col("frames"), "corrected").otherwise("ok")
    return out.select(*KEY, "frames", "actual", status.alias("status"))


#: Parquet by the reader that answers count(*) of partitions from the files' footers
FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, seg_idx, actual) of segments stored by video and segment, from file footers; no row is read. To be
    run inside configured(FOOTERS)."""
    stored = spark.read.parquet(path).groupBy(*KEY).agg(F.count("*").alias("actual"))
    return stored


def segment_verify_stored(recorded: DataFrame, path: str) -> DataFrame:
    """segment_verify() against the segments that lie in a folder, by the footers of their files; where segments share
    folders (segment_sink() with block), by their column of segments alone, which is a run for each."""
    spark = recorded.sparkSession
    stored = spark.read.parquet(path)
    if "seg_block" in stored.columns:
        return segment_verify(recorded, stored.select(F.col("video_id").cast("long"), F.col("seg_idx").cast("int")))
    with configured(spark, FOOTERS):
        real = shared_table(footer_counts(spark, path).select(F.col("video_id").cast("long"), F.col("seg_idx").cast("int"), "actual"), "footers")
    return _verified(recorded, real)


def merge_audit(recorded: DataFrame, rows: DataFrame) -> DataFrame:
    """The segments that a merge takes, in order (place, offset), with the audit of a sample of each video's:
    actual and status of segment_verify(), or unchecked. All are merged, whatever the audit says."""
    said = segment_verify(segment_sample(recorded), rows).select(*KEY, "actual", F.col("status").alias("_said"))
    out = segments_ordered(recorded).join(said, KEY, "left")
    return out.select(*KEY, "place", "offset", "frames", "actual", F.coalesce("_said", F.lit("unchecked")).alias("status"))


def segment_stats(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per segment: expected and written frames, how many are missing and extra."""
    apart = frames_missing_extra(expected, actual).groupBy(*KEY).agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "extra").alias("extra"))
    e = expected.groupBy(*KEY).agg(F.countDistinct("frame_idx").alias("expected"))
    w = actual.groupBy(*KEY).agg(F.count("*").alias("written"))
    return e.join(w, KEY, "full").join(apart, KEY, "left").na.fill(0)


def segment_verify_tolerant(counts: DataFrame) -> DataFrame:
    """counts (expected, reported, recount) with valid: reported within 1, or an exact recount."""
    return counts.withColumn("valid", F.coalesce(F.abs(F.col("reported") - F.col("expected")) <= 1, F.lit(False)) | F.coalesce(F.col("recount") == F.col("expected"), F.lit(False)))


def count_discrepancy(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Adds diff, percent (of the larger) and vfr_suspect (over 50 frames apart)."""
    diff = F.abs(F.col(a) - F.col(b))
    larger = F.greatest(a, b)
    return counts.withColumn("diff", diff).withColumn("percent", F.when(larger > 0, F.round(100 * diff / larger, 6)).otherwise(0.0)).withColumn("vfr_suspect", diff > 50)


def total_reconcile(recorded: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """The total to use: new where there is none or both agree, the old one where more is done than the new total, else new."""
    rows = new.select("video_id", F.col("total_frames").alias("new_total")).join(recorded.select("video_id", F.col("total_frames").alias("old_total")), "video_id", "left")
    rows = rows.join(contiguous_prefix(done), "video_id", "left").na.fill(0, ["prefix_frames", "old_total"])
    keep_old = (F.col("old_total") > 0) & (F.col("old_total") != F.col("new_total")) & (F.col("prefix_frames") > F.col("new_total"))
    return rows.select("video_id", "old_total", "new_total", "prefix_frames", F.when(keep_old, F.col("old_total")).otherwise(F.col("new_total")).alias("total_frames"))


def actual_end(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, total_frames): the recorded total, shortened to the last frame that is there plus one."""
    last = rows.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("_end"))
    return videos.select("video_id", "total_frames").join(last, "video_id").select("video_id", F.least("total_frames", "_end").alias("total_frames"))


def completion_check(counts: DataFrame) -> DataFrame:
    """counts (written, expected, merged, finalised) with done, and remerge where less than 95 % is there."""
    done = F.col("merged") & F.col("finalised")
    return counts.withColumn("done", done).withColumn("remerge", done & (F.col("written") < F.col("expected") * 0.95))


def tolerance(seconds: Column) -> Column:
    share = seconds * 0.001
    return F.when(seconds < 300, 1.0).when(seconds < 1800, F.greatest(F.lit(1.0), share)).otherwise(F.least(F.lit(2.0), share))


def duration_check(durations: DataFrame) -> DataFrame:
    """durations (original, final) in seconds with diff, percent, tolerance and ok."""
    diff = F.abs(F.col("final") - F.col("original"))
    out = durations.withColumn("diff", F.round(diff, 6)).withColumn("percent", F.when(F.col("original") > 0, F.round(100 * diff / F.col("original"), 6)).otherwise(0.0))
    return out.withColumn("tolerance", F.round(tolerance(F.col("original")), 6)).withColumn("ok", F.round(diff, 9) <= F.round(tolerance(F.col("original")), 9))
