"""A whole run over videos: repair the checkpoint, resume, process what is left, fill holes, merge, splice, check, report.

Each step is one of the library's operators over the tables of all videos at once. A run that was broken
off goes on from what its checkpoint and its segments hold: segments of earlier runs are merged and
spliced with the new ones. process() keeps both in a folder and writes them while it goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidtables.operators import segments, verify
from vidtables.sources import checkpoints

KEY = ["video_id", "frame_idx"]


@dataclass
class Run:
    """repaired: the checkpoint after its repair, with status. plan: segments left to do. written: rows of all segments
    with recovered, those of earlier runs included; is_new tells the others. merged: the same in output order. frames: all
    frames of the videos with origin and recovered. checkpoint: segments done afterwards. report: a row for each video."""

    repaired: DataFrame
    plan: DataFrame
    written: DataFrame
    merged: DataFrame
    frames: DataFrame
    checkpoint: DataFrame
    report: DataFrame


def run(frames: DataFrame, results: DataFrame, videos: DataFrame, ranges: DataFrame, done: DataFrame, stored: DataFrame, columns: list[str], segment_frames: int, recorded: DataFrame | None = None, sampled: bool = False) -> Run:
    """frames (video_id, frame_idx, columns) are the originals, results what processing gave of them, videos
    (video_id, total_frames, fps) what a probe says, ranges (video_id, range_start, range_end) what is to be
    processed, done (video_id, seg_idx, frames) the checkpoint, stored (video_id, seg_idx, frame_idx, columns,
    recovered) the rows of its segments, recorded (video_id, total_frames) the totals of the run before.

    A segment of the checkpoint without rows goes, another's count becomes that of its rows (of a sample of
    them, if asked for). What lies behind the first missing segment is planned anew, in place of what is
    stored there. Frames that a stored segment has lost, and frames without a result, are taken from the
    original and told as recovered. Videos without a range stay as they are; a range past a video's last
    frame counts only what is there.
    """
    done = done.select("video_id", "seg_idx", "frames")
    repaired = checkpoints.checkpoint_repair(done, stored, sampled)
    resumed = segments.resume_frame(ranges, repaired)
    plan = segments.segment_plan(resumed, segment_frames)
    own = resumed.select("video_id", "range_start", "range_end", "resume", "n_prefix")

    kept = stored.join(own, "video_id").where("seg_idx < n_prefix and frame_idx >= range_start and frame_idx < resume")
    new = results.join(own, "video_id").where("frame_idx >= resume and frame_idx < range_end")
    have = kept.select(*KEY, F.col("seg_idx").alias("_seg"), F.col("recovered").alias("_recovered"), *columns)
    have = have.unionByName(new.select(*KEY, F.lit(None).cast("int").alias("_seg"), F.lit(False).alias("_recovered"), *columns))
    inside = frames.join(own, "video_id").where("frame_idx >= range_start and frame_idx < range_end")
    filled = segments.fill_from_original(inside.select(*KEY, "resume", "n_prefix", *columns), have, columns, ["_seg", "_recovered"], ["resume", "n_prefix"])
    of_plan = (F.col("n_prefix") + F.floor((F.col("frame_idx") - F.col("resume")) / segment_frames)).cast("int")
    is_new = F.col("frame_idx") >= F.col("resume")
    rows = filled.select(*KEY, F.when(is_new, of_plan).otherwise(F.col("_seg")).alias("seg_idx"), *columns, (F.col("recovered") | F.col("_recovered")).alias("recovered"), is_new.alias("is_new"))

    written = rows.where("seg_idx is not null")
    counts = written.groupBy("video_id", "seg_idx").agg(F.count("*").alias("frames"))
    merged = segments.merge_segments(written, counts)
    whole = frames.select(*KEY, *columns).withColumn("recovered", F.lit(False))
    spliced = segments.splice(whole, rows.select(*KEY, *columns, "recovered"), ranges)

    totals = verify.actual_end(frames, verify.total_reconcile(videos if recorded is None else recorded, videos, repaired))
    report = _report(resumed, plan, rows, totals, videos, repaired)
    return Run(repaired, plan, written, merged, spliced, counts, report)


def _report(resumed: DataFrame, plan: DataFrame, rows: DataFrame, totals: DataFrame, videos: DataFrame, repaired: DataFrame) -> DataFrame:
    """Of each video with a range: segments before and planned, frames, recovered ones with the first 20, and the final checks."""
    planned = plan.groupBy("video_id").agg(F.count("*").alias("segments_planned"))
    repairs = repaired.where("status = 'corrected'").groupBy("video_id").agg(F.count("*").alias("segments_corrected"))
    sums = rows.groupBy("video_id").agg(
        F.count_if("is_new").alias("frames_todo"),
        F.count_if(F.col("is_new") & ~F.col("recovered")).alias("processed"),
        F.count_if(F.col("is_new") & F.col("recovered")).alias("recovered"),
        F.count_if(F.col("seg_idx").isNull()).alias("lost_before"),
        F.count("seg_idx").alias("written"),
    )
    preview = segments.missing_preview(rows.where("recovered"), 20).select("video_id", F.col("n_missing").alias("recovered_in_all"), F.col("first").alias("first_recovered"))
    out = resumed.select("video_id", F.col("n_prefix").alias("segments_before"), "range_start", "resume", "range_end")
    for table in (planned, repairs, sums, preview, totals, videos.select("video_id", "fps")):
        out = out.join(table, "video_id", "left")
    out = out.na.fill(0, ["segments_planned", "segments_corrected", "frames_todo", "processed", "recovered", "lost_before", "written", "recovered_in_all", "total_frames"]).na.fill("", ["first_recovered"])
    end = F.least("range_end", "total_frames")
    out = out.withColumn("expected", F.greatest(end - F.col("range_start"), F.lit(0)).cast("long"))
    out = verify.completion_check(out.withColumn("merged", F.col("written") > 0).withColumn("finalised", F.col("resume") + F.col("frames_todo") >= end))
    # the spliced video has the frames of its range, and the original's outside
    seconds = out.withColumn("original", F.col("total_frames") / F.col("fps")).withColumn("final", (F.col("total_frames") - F.col("expected") + F.col("written") + F.col("lost_before")) / F.col("fps"))
    return verify.duration_check(seconds).drop("merged", "finalised", "original", "final", "diff", "percent", "tolerance", "fps").withColumnRenamed("ok", "duration_ok")


SEGMENTS, CHECKPOINT = "segments", "checkpoint"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The checkpoint and the segments' rows of a folder; empty tables at first. schema has the columns of a row."""
    done, stored = f"{folder}/{CHECKPOINT}", f"{folder}/{SEGMENTS}"
    types = f"{schema}, frame_idx int, recovered boolean, video_id long, seg_idx int"
    rows = spark.read.schema(types).parquet(stored) if _there(spark, stored) else spark.createDataFrame([], types)
    marks = "video_id long, seg_idx int, frames long, version long"
    held = spark.read.schema(marks).parquet(done) if _there(spark, done) else spark.createDataFrame([], marks)
    newest = Window.partitionBy("video_id", "seg_idx").orderBy(F.desc("version"))
    return held.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("video_id", "seg_idx", "frames"), rows


def process(frames: DataFrame, results: DataFrame, videos: DataFrame, ranges: DataFrame, folder: str, schema: str, segment_frames: int, at_once: int = 50, after: Callable[[int], None] | None = None) -> Run:
    """A run that keeps its segments and its checkpoint in a folder, and may be started again after any failure.

    `at_once` segments of each video are written together, then marked in the checkpoint, which only grows:
    the newest mark of a segment counts. Segments that were written and not yet marked are planned again and
    replaced. schema names the columns of a row and their types. after(n) is called when the n-th group is marked.
    """
    spark = frames.sparkSession
    columns = [c.strip().split()[0] for c in schema.split(",")]
    done, stored = load(spark, folder, schema)
    now = run(frames, results, videos, ranges, done, stored, columns, segment_frames)
    version = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    first = now.plan.groupBy("video_id").agg(F.min("seg_idx").alias("_first"))
    group = F.floor((F.col("seg_idx") - F.col("_first")) / at_once).cast("int").alias("g")
    fields = f"{schema}, frame_idx int, recovered boolean, video_id long, seg_idx int"
    todo = f"{folder}/todo-{version}"
    rows = now.written.where("is_new").join(first, "video_id").select(*columns, "frame_idx", "recovered", "video_id", "seg_idx", group)
    rows.write.partitionBy("g").parquet(todo)  # once, so that each group reads its own rows only
    rows = spark.read.schema(f"{fields}, g int").parquet(todo)
    for g in sorted(r.g for r in rows.select("g").distinct().collect()):  # a number for each group
        own = rows.where(F.col("g") == g).drop("g")
        checkpoints.segment_sink(own, f"{folder}/{SEGMENTS}")
        own.groupBy("video_id", "seg_idx").agg(F.count("*").alias("frames")).withColumn("version", F.lit(version + g)).write.mode("append").parquet(f"{folder}/{CHECKPOINT}")
        if after:
            after(g)
    remove(spark, todo)
    done, stored = load(spark, folder, schema)
    return run(frames, results, videos, ranges, done, stored, columns, segment_frames)

