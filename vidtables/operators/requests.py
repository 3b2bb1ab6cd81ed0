"""Requests: ranges, reference frames, checks, skips and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.functions import scalars


def range_resolve(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds range_start and range_end (half open): a frame number wins over a time, else all; clamped to the video."""
    rows = requests.join(videos.select("video_id", "fps", "total_frames"), "video_id")
    frame = lambda n, time: F.coalesce(F.col(n), scalars.time_to_frame(scalars.parse_time(F.col(time)), F.col("fps")))
    end_time = "end_time" if "end_time" in requests.columns else None
    start = F.greatest(F.lit(0), F.least(F.coalesce(frame("start_frame", "start_time"), F.lit(0)), "total_frames"))
    wanted = frame("end_frame", end_time) if end_time else F.col("end_frame")
    rows = rows.withColumn("range_start", start)
    return rows.withColumn("range_end", F.greatest(F.col("range_start"), F.least(F.coalesce(wanted, "total_frames"), "total_frames")))


def reference_frame(ranges: DataFrame) -> DataFrame:
    """Adds track_frame, the wanted reference frame clamped to the video, else the range's start, and specified."""
    wanted = F.coalesce(F.col("reference_frame") >= 0, F.lit(False))
    inside = F.greatest(F.lit(0), F.least("reference_frame", F.col("total_frames") - 1))
    return ranges.withColumn("track_frame", F.when(wanted, inside).otherwise(F.col("range_start"))).withColumn("specified", wanted)


def range_filter(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames within the range of a request of their video."""
    own = ranges.select("request_id", F.col("video_id").alias("_v"), "range_start", "range_end")
    inside = (F.col("video_id") == F.col("_v")) & (F.col("frame_idx") >= F.col("range_start")) & (F.col("frame_idx") < F.col("range_end"))
    return frames.join(own, inside).drop("_v", "range_start", "range_end")


REASONS = [
    ("sim_threshold", "sim_threshold < 0 or sim_threshold > 1"),
    ("max_age", "max_age < -1"),
    ("reset_interval", "reset_interval < 1"),
    ("segment_frames", "segment_frames < 10"),
    ("sources", "skip_spec is not null and n_sources <> 1"),
]


def request_validate(requests: DataFrame) -> DataFrame:
    """Adds reasons, those for which a request is rejected in order, and accepted."""
    reasons = F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in REASONS]))
    return requests.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def skip_parse(requests: DataFrame) -> DataFrame:
    """Adds skip_positions from skip_spec: "-1" anywhere means none, blanks are ignored; null stays null."""
    numbers = F.filter(F.transform(F.split("skip_spec", ","), lambda x: scalars.whole(x)), lambda x: x.isNotNull())
    return requests.withColumn("skip_positions", F.when(F.array_contains(numbers, -1), F.array().cast("array<int>")).otherwise(numbers))


def skip_validate(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds invalid, skip positions at or over n_detections, and n_applied, detections less the valid ones."""
    rows = requests.join(counts.select("video_id", "n_detections"), "video_id")
    invalid = F.filter("skip_positions", lambda p: p >= F.col("n_detections"))
    valid = F.size(F.array_distinct(F.filter("skip_positions", lambda p: (p >= 0) & (p < F.col("n_detections")))))
    return rows.withColumn("invalid", invalid).withColumn("n_applied", F.col("n_detections") - valid)


def det_position(detections: DataFrame) -> DataFrame:
    """Adds position: the place of each detection in its frame from the left, ties in detector order."""
    left = Window.partitionBy("video_id", "frame_idx").orderBy("x1", "det_seq")
    return detections.withColumn("position", F.row_number().over(left) - 1)


def slot_assign(positions: DataFrame, slots: DataFrame, frame: int = 0) -> DataFrame:
    """The i-th detection of the reference frame with slot i; a null slot is SKIP."""
    own = positions.where(F.col("frame_idx") == frame).select("video_id", "position", "det_seq")
    bound = slots.select("video_id", "position", F.when(F.col("is_skip"), "SKIP").otherwise(F.col("position").cast("string")).alias("source"))
    return own.join(bound, ["video_id", "position"])


def apply_all_assign(positions: DataFrame, requests: DataFrame, frame: int = 0) -> DataFrame:
    """Every detection of the reference frame with the one source, or SKIP at skip positions, for each request."""
    own = positions.where(F.col("frame_idx") == frame).select("video_id", "position", "det_seq")
    rows = own.join(requests.select("request_id", "video_id", "skip_positions"), "video_id")
    return rows.select("request_id", "video_id", "position", "det_seq", F.when(F.array_contains("skip_positions", F.col("position")), "SKIP").otherwise("SWAP").alias("source"))


def slot_summary(slots: DataFrame) -> DataFrame:
    return slots.groupBy("video_id").agg(F.count("*").alias("n_slots"), F.count_if(~F.col("is_skip")).alias("n_normal"), F.count_if("is_skip").alias("n_skip"))


def detections_per_frame(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n_detections"))


def count_reconcile(detections: DataFrame, slots: DataFrame, frame: int = 0) -> DataFrame:
    """Detections of the reference frame against slots, with status ok, no_detections or mismatch."""
    found = detections.where(F.col("frame_idx") == frame).groupBy("video_id").agg(F.count("*").alias("n_detections"))
    rows = found.join(slot_summary(slots), "video_id", "full").na.fill(0)
    status = F.when(F.col("n_detections") == 0, "no_detections").when(F.col("n_detections") != F.col("n_slots"), "mismatch").otherwise("ok")
    return rows.withColumn("status", status)


def reference_candidates(detections: DataFrame, slots: DataFrame, k: int = 10) -> DataFrame:
    """Frames with as many detections as slots, the k with the highest mean score of each video."""
    frames = detections.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n_detections"), F.round(F.avg("det_score"), 6).alias("quality"))
    rows = frames.join(slot_summary(slots).select("video_id", "n_slots"), "video_id").where("n_detections = n_slots")
    rank = Window.partitionBy("video_id").orderBy(F.desc("quality"), "frame_idx")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("video_id", "frame_idx", "quality", "rank")
