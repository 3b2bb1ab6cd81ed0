"""Catalogs of media files and of probe output, detector output and source slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.functions import scalars, vectors
from vidtables.sources.shared import shared_table

# Extensions of images.
IMAGES = [".png", ".jpg", ".jpeg", ".bmp", ".webp"]


def media_catalog(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds kind (image or video, by extension) and output, the default output name."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    stem = F.expr(f"substr(`{path_col}`, 1, length(`{path_col}`) - length(_ext))")
    out = paths.withColumn("_ext", ext).withColumn("kind", F.when(F.lower("_ext").isin(IMAGES), "image").otherwise("video"))
    return out.withColumn("output", F.concat(stem, F.lit("-swapped"), "_ext")).drop("_ext")


def probe_catalog(probes: DataFrame) -> DataFrame:
    """Adds total_frames and count_method: packets, else nb_frames, else the decoder's count, else 0."""
    packets, frames = scalars.whole(F.col("nb_read_packets")), scalars.whole(F.col("nb_frames"))
    decoder = F.col("decoder_frames").cast("int")
    method = F.when(packets.isNotNull(), "packets").when(frames.isNotNull(), "nb_frames").when(decoder.isNotNull(), "decoder").otherwise("none")
    return probes.withColumn("total_frames", F.coalesce(packets, frames, decoder, F.lit(0))).withColumn("count_method", method)


def probe_resolution(probes: DataFrame) -> DataFrame:
    """Adds width and height, 1920 x 1080 where the text has none."""
    size = scalars.resolution_parse(F.coalesce("resolution", F.lit("")), 1920, 1080)
    return probes.withColumn("_size", size).select(*probes.columns, "_size.width", "_size.height")


def detections_scan(detections: DataFrame) -> DataFrame:
    """Detector output with embedding null where it isn't valid, and the flag valid."""
    out = detections.withColumn("embedding", vectors.vec_valid(F.col("embedding")))
    return out.withColumn("valid", F.col("embedding").isNotNull())


def slots_scan(lists: DataFrame, gallery: DataFrame) -> DataFrame:
    """Slots from lists (video_id, sources: names joined by commas) and a gallery (name, embedding).
    "skip" in any case is a null slot; the position is the place in the list."""
    rows = lists.select("video_id", F.posexplode(F.split("sources", ",")).alias("position", "name")).withColumn("name", F.trim("name"))
    rows = rows.withColumn("is_skip", F.lower("name") == "skip")
    # null slots don't meet the gallery: they all have one name, which would come to one task
    named = rows.where(~F.col("is_skip")).join(gallery.select("name", "embedding"), "name", "left").select("video_id", "position", "embedding", "is_skip")
    return named.union(rows.where("is_skip").select("video_id", "position", F.lit(None).cast(gallery.schema["embedding"].dataType), "is_skip"))


def batch_fanout(videos: DataFrame, part_seconds: int = 1200) -> DataFrame:
    """A row for each part of part_seconds of each video (fps, total_frames): part, start_frame, end_frame."""
    step = F.greatest((F.col("fps") * part_seconds).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(F.col("total_frames") - 1, F.lit(0)), step)
    out = videos.where("total_frames > 0 and fps > 0").select(*videos.columns, step.alias("_step"), F.posexplode(starts).alias("part", "start_frame"))
    return out.withColumn("end_frame", F.least(F.col("start_frame") + F.col("_step"), "total_frames")).drop("_step")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with place, counted from 0 in each key by order, nulls last; equal rows in any order.
    They are dealt by ranges and written, so that a key spans several tasks: a range's places follow those of the key's ranges before."""
    by = (F.asc_nulls_last(key), F.asc_nulls_last(order))
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = shared_table(dealt, "numbered").withColumn("_range", F.shiftright("_at", 33))  # the id's upper bits are the task's number
    ranges = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_key", "_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = dealt.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return out.select(*rows.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias("place"))
