"""Segments: plans, resuming, sets of frames, merging and splicing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["video_id", "seg_idx"]


def segment_total(videos: DataFrame, segment_frames: int) -> DataFrame:
    """Adds n_segments, 0 where total_frames is unknown."""
    total = F.coalesce("total_frames", F.lit(0))
    return videos.withColumn("n_segments", F.when(total > 0, F.ceil(total / segment_frames)).otherwise(0).cast("int"))


def progress(done: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, frames_done, total_frames, percent) of every video."""
    sums = done.groupBy("video_id").agg(F.sum("frames").alias("frames_done"))
    rows = videos.select("video_id", "total_frames").join(sums, "video_id", "left").na.fill(0, ["frames_done"])
    return rows.withColumn("percent", F.when(F.col("total_frames") > 0, F.round(100 * F.col("frames_done") / F.col("total_frames"), 6)).otherwise(0.0))


def _in_prefix(done: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("seg_idx")) - 1
    return done.withColumn("_in", place == F.col("seg_idx")).withColumn("_place", place)


def contiguous_prefix(done: DataFrame) -> DataFrame:
    """(video_id, n_prefix, prefix_frames): segments 0, 1, ... without a gap and their frames."""
    rows = _in_prefix(done).groupBy("video_id")
    return rows.agg(F.count_if("_in").alias("n_prefix"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("frames"))), F.lit(0)).alias("prefix_frames"))


def next_segment(done: DataFrame) -> DataFrame:
    """(video_id, next_segment): the first segment that is missing."""
    gap = F.min(F.when(~F.col("_in"), F.col("_place")))
    return _in_prefix(done).groupBy("video_id").agg(F.coalesce(gap, F.count("*")).cast("int").alias("next_segment"))


def resume_frame(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """ranges (video_id, range_start, range_end) with n_prefix and resume, the next frame to process."""
    rows = ranges.join(contiguous_prefix(done), "video_id", "left").na.fill(0, ["n_prefix", "prefix_frames"])
    return rows.withColumn("resume", F.least(F.col("range_start") + F.col("prefix_frames"), "range_end").cast("int"))


def segment_plan(resumed: DataFrame, segment_frames: int) -> DataFrame:
    """(video_id, seg_idx, frame_start, frame_end) from the resume frame to the range's end; ids go on after the prefix."""
    starts = F.sequence(F.col("resume"), F.col("range_end") - 1, F.lit(segment_frames))
    rows = resumed.where("resume < range_end").select("video_id", "range_end", "n_prefix", F.posexplode(starts).alias("i", "frame_start"))
    return rows.select("video_id", (F.col("n_prefix") + F.col("i")).cast("int").alias("seg_idx"), "frame_start", F.least(F.col("frame_start") + segment_frames, "range_end").alias("frame_end"))


def frame_to_segment(frames: DataFrame, start: int, segment_frames: int) -> DataFrame:
    """frames from start on with seg_idx."""
    return frames.where(F.col("frame_idx") >= start).withColumn("seg_idx", F.floor((F.col("frame_idx") - start) / segment_frames).cast("int"))


def segments_missing(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select(*KEY), KEY, "left_anti")


def segments_completed(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select(*KEY), KEY, "left_semi")


def frames_missing_extra(expected: DataFrame, actual: DataFrame, key: tuple[str, ...] = ("video_id", "seg_idx", "frame_idx")) -> DataFrame:
    """Keys of only one side, with status missing or extra."""
    a = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    b = actual.select(*key).distinct().withColumn("_a", F.lit(True))
    rows = a.join(b, list(key), "full").where("_e is null or _a is null")
    return rows.select(*key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("status"))


def suspicious_segments(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Segments whose sets of frames may differ: (video_id, seg_idx) where least frame, greatest frame, number of distinct
    frames or an order-free hash of them aren't the same on both sides; these are summed before anything is shuffled."""

    def sums(rows: DataFrame, side: str) -> DataFrame:
        hashed = F.sum(F.xxhash64("frame_idx").cast("decimal(38,0)"))
        return rows.groupBy(*KEY).agg(F.struct(F.min("frame_idx"), F.max("frame_idx"), F.count("*"), hashed).alias(side))

    rows = sums(expected, "_e").join(sums(actual, "_a"), KEY, "full")
    return rows.where("not (_e <=> _a)").select(*KEY)


def frames_missing_extra_by_runs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """frames_missing_extra() for sets of frames (video_id, seg_idx, frame_idx): only segments that differ in their sums are
    expanded and compared frame by frame. Frames that are there twice make a segment suspicious, not extra."""
    which = suspicious_segments(expected, actual)
    return frames_missing_extra(expected.join(which, KEY, "left_semi"), actual.join(which, KEY, "left_semi"))


def frame_set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Frames (video_id, frame_idx) of only one side, as set differences."""
    a, b = expected.select("video_id", "frame_idx"), actual.select("video_id", "frame_idx")
    return a.subtract(b).withColumn("status", F.lit("missing")).union(b.subtract(a).withColumn("status", F.lit("extra")))


def fill_from_original(original: DataFrame, processed: DataFrame, columns: list[str], more: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """All original frames, with processed columns where there are any, else the original's, and recovered.
    more: further columns of processed, null (or false) where there is no row; own: further ones of original."""
    key, more, own = ["video_id", "frame_idx"], more or [], own or []
    p = processed.select(*key, *[F.col(c).alias(f"_p_{c}") for c in columns], *more, F.lit(True).alias("_there"))
    rows = original.select(*key, *own, *columns).join(p, key, "left").na.fill(False, more)
    return rows.select(*key, *own, *[F.when(F.col("_there"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in columns], *more, F.col("_there").isNull().alias("recovered"))


def missing_preview(missing: DataFrame, k: int = 10) -> DataFrame:
    """(video_id, n_missing, first): how many frames are missing and the first k, in order."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx"))
    rows = missing.select("video_id", "frame_idx").distinct().withColumn("_n", place)
    first = F.array_sort(F.collect_list(F.when(F.col("_n") <= k, F.col("frame_idx"))))
    return rows.groupBy("video_id").agg(F.count("*").alias("n_missing"), F.array_join(first, ",").alias("first"))


def segment_list_summary(done: DataFrame, most: int = 20, ends: int = 10) -> DataFrame:
    """(video_id, n, ids): all ids if there are at most `most`, else the first and last `ends`."""
    up, down = Window.partitionBy("video_id").orderBy("seg_idx"), Window.partitionBy("video_id").orderBy(F.desc("seg_idx"))
    all_ = F.count("*").over(Window.partitionBy("video_id"))
    rows = done.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).withColumn("_n", all_)
    kept = rows.where((F.col("_n") <= most) | (F.col("_u") <= ends) | (F.col("_d") <= ends))
    ids = F.array_join(F.array_sort(F.collect_list("seg_idx")), ",")
    return kept.groupBy("video_id").agg(F.max("_n").alias("n"), ids.alias("ids"))


def segments_ordered(done: DataFrame) -> DataFrame:
    """Segments with their place in each video's concatenation and the frames before them."""
    order = Window.partitionBy("video_id").orderBy("seg_idx")
    before = F.coalesce(F.sum("frames").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.withColumn("place", F.row_number().over(order)).withColumn("offset", before)


def segment_sample(done: DataFrame, seed: str = "7") -> DataFrame:
    """A tenth of each video's segments, 1 at least and 50 at most, in the order of a seeded hash."""
    by_hash = Window.partitionBy("video_id").orderBy(F.md5(F.concat_ws(":", F.col("video_id").cast("string"), F.col("seg_idx").cast("string"), F.lit(seed))), "seg_idx")
    n = F.count("*").over(Window.partitionBy("video_id"))
    size = F.greatest(F.lit(1), F.least(F.floor(n / 10), F.lit(50)))
    return done.withColumn("_r", F.row_number().over(by_hash)).withColumn("_s", size).where("_r <= _s").drop("_r", "_s")


def merge_segments(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of segments done, with out_idx, their place in the merged video.

    The place is the segment's offset and the place within the segment, so no window spans a video.
    """
    offsets = segments_ordered(done).select(*KEY, "offset")
    inside = Window.partitionBy(*KEY).orderBy("frame_idx")
    return rows.join(offsets, KEY).withColumn("out_idx", F.col("offset") + F.row_number().over(inside) - 1).drop("offset")


def splice(original: DataFrame, processed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Original frames outside each video's range and processed frames inside it, with origin.
    Videos without a range stay as they are."""
    own = ranges.select("video_id", "range_start", "range_end")
    inside = (F.col("frame_idx") >= F.col("range_start")) & (F.col("frame_idx") < F.col("range_end"))
    kept = original.join(own, "video_id", "left").where(F.col("range_start").isNull() | ~inside).drop("range_start", "range_end")
    new = processed.join(own, "video_id").where(inside).drop("range_start", "range_end")
    return kept.withColumn("origin", F.lit("original")).unionByName(new.withColumn("origin", F.lit("processed")))


def extract_only(processed: DataFrame, ranges: DataFrame, fps: str = "fps") -> DataFrame:
    """Processed frames inside the range, counted from 0, with the time offset of the range in seconds."""
    own = ranges.select("video_id", "range_start", "range_end", F.col(fps).alias("_fps"))
    rows = processed.join(own, "video_id").where("frame_idx >= range_start and frame_idx < range_end")
    rows = rows.withColumn("offset_seconds", F.round(F.col("range_start") / F.col("_fps"), 6)).withColumn("frame_idx", F.col("frame_idx") - F.col("range_start"))
    return rows.drop("range_start", "range_end", "_fps")


def frame_order(results: DataFrame, partitions: int | None = None) -> DataFrame:
    """Results by video and frame, for a sink: partitions follow each other in that order, each of them sorted; a long video spans several."""
    by = ("video_id", "frame_idx")
    dealt = results.repartitionByRange(partitions, *by) if partitions else results.repartitionByRange(*by)
    return dealt.sortWithinPartitions("video_id", "frame_idx")
