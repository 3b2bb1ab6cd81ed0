"""Checkpoints of segments: JSON of both generations, and the table of segments done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.operators.segments import segment_sample
from vidtables.operators.verify import segment_verify
from vidtables.sources.shared import shared_table

SCHEMA = "completed_segments string, total_frames int"


def checkpoint_read(docs: DataFrame, actual: DataFrame) -> DataFrame:
    """(video_id, seg_idx, frames, total_frames) from JSON docs (video_id, doc).

    Maps have frames by segment. Lists, the older form, take theirs from actual (video_id,
    seg_idx, frames) and drop out at 0. Unreadable documents give no rows.
    """
    read = docs.select("video_id", F.from_json("doc", SCHEMA).alias("d")).select("video_id", "d.*")
    listed = F.col("completed_segments").rlike(r"^\s*\[")
    maps = read.where(~listed).select("video_id", "total_frames", F.explode(F.from_json("completed_segments", "map<string,int>")).alias("k", "frames"))
    maps = maps.select("video_id", F.col("k").try_cast("int").alias("seg_idx"), "frames", "total_frames").where("seg_idx is not null")
    lists = read.where(listed).select("video_id", "total_frames", F.explode(F.from_json("completed_segments", "array<int>")).alias("seg_idx"))
    lists = lists.join(actual.select("video_id", "seg_idx", "frames"), ["video_id", "seg_idx"]).where("frames > 0")
    return maps.unionByName(lists)


def checkpoint_write(done: DataFrame) -> DataFrame:
    """JSON docs (video_id, doc) of segments done (video_id, seg_idx, frames, total_frames), which checkpoint_read reads back; segments in order."""
    rows = done.groupBy("video_id").agg(F.max("total_frames").alias("total_frames"), F.array_sort(F.collect_list(F.struct("seg_idx", "frames"))).alias("s"))
    held = F.map_from_entries(F.transform("s", lambda x: F.struct(x["seg_idx"].cast("string"), x["frames"])))
    return rows.select("video_id", F.to_json(F.struct(held.alias("completed_segments"), "total_frames")).alias("doc"))


def checkpoint_repair(done: DataFrame, rows: DataFrame, sampled: bool = True) -> DataFrame:
    """done (video_id, seg_idx, frames) against the rows (video_id, seg_idx, ...) that are there: segments without
    rows go, others get their real count. Checked is a sample of each video's segments, or all; status says
    ok, corrected or unchecked."""
    said = segment_verify(segment_sample(done) if sampled else done, rows)
    out = done.join(said.select("video_id", "seg_idx", "actual", F.col("status").alias("_said")), ["video_id", "seg_idx"], "left").where("_said is null or _said <> 'dropped'")
    return out.select("video_id", "seg_idx", F.coalesce("actual", F.col("frames").cast("long")).alias("frames"), F.coalesce("_said", F.lit("unchecked")).alias("status"))


def checkpoint_upsert(done: DataFrame, updates: DataFrame) -> DataFrame:
    """done with updates (video_id, seg_idx, frames, version); the highest version of a segment wins, done being the oldest."""
    both = done.withColumn("version", F.lit(-1).cast("long")).unionByName(updates.select("video_id", "seg_idx", "frames", F.col("version").cast("long")))
    newest = Window.partitionBy("video_id", "seg_idx").orderBy(F.desc("version"), F.desc("frames"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("video_id", "seg_idx", "frames")


def checkpoint_remove(done: DataFrame, removed: DataFrame) -> DataFrame:
    return done.join(removed.select("video_id", "seg_idx"), ["video_id", "seg_idx"], "left_anti")


def segment_sink(rows: DataFrame, path: str, order: str = "frame_idx", block: int | None = None) -> None:
    """Writes rows by video and segment, in frame order within each; folders that are written replace those present. With
    block, that many segments share a folder (video_id, seg_block) and lie there one after the other, so that
    folders and files don't become as many as segments; seg_idx is a column of the files then."""
    folders = ["video_id", "seg_idx"] if block is None else ["video_id", "seg_block"]
    if block is not None:
        rows = rows.withColumn("seg_block", F.floor(F.col("seg_idx") / block).cast("int"))
    dealt = rows.repartition(*folders).sortWithinPartitions(*dict.fromkeys([*folders, "seg_idx", order]))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def splice_stored(processed: DataFrame, ranges: DataFrame, path: str, block: int | None = None) -> None:
    """splice() into a table that lies by video and segment (fixed numbers of frames): only segments that a video's range
    touches are written again, those at its borders with their own frames outside; with block, as segment_sink() had it, the
    folders that hold such segments. processed has video_id, seg_idx, frame_idx and the table's columns. The new
    folders are written aside first, so a failure leaves the table whole or is repeated."""
    spark = processed.sparkSession
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c not in ("video_id", "seg_idx", "seg_block")]
    own = ranges.select("video_id", "range_start", "range_end")
    inside = (F.col("frame_idx") >= F.col("range_start")) & (F.col("frame_idx") < F.col("range_end"))
    new = processed.join(own, "video_id").where(inside).select(*columns, F.col("video_id").cast("long"), F.col("seg_idx").cast("int"))
    touched = new.select("video_id", "seg_idx").distinct()
    kept = stored.withColumns({"video_id": F.col("video_id").cast("long"), "seg_idx": F.col("seg_idx").cast("int")})
    if block is None:
        kept = kept.join(touched, ["video_id", "seg_idx"], "left_semi").join(own, "video_id").where(~inside)
    else:
        folders = touched.select("video_id", F.floor(F.col("seg_idx") / block).cast("int").alias("seg_block")).distinct()
        kept = kept.join(folders, ["video_id", "seg_block"], "left_semi").join(touched.withColumn("_touched", F.lit(True)), ["video_id", "seg_idx"], "left")
        kept = kept.join(own, "video_id", "left").where(F.col("_touched").isNull() | ~inside)
    segment_sink(shared_table(kept.select(*columns, "video_id", "seg_idx").unionByName(new), "splice"), path, block=block)
