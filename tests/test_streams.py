"""Timers, breaks between the steps of a commit, and sets of frames by their sums."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vidtables.operators import segments, tracking
from vidtables.streaming import jobs


def test_only_the_timer_gives_up(spark, tmp_path):
    """Two indexes are missing and fewer wait than patience allows: nothing but the timer can release them."""
    rows = [(1, i) for i in range(12) if i not in (3, 8)] + [(2, 0)]
    spark.createDataFrame(rows, "video_id long, frame_idx int").write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_reassemble(spark.readStream.schema("video_id long, frame_idx int").parquet(f"{tmp_path}/in"), 1000, 1000)
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    with jobs.rocksdb(spark):
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        ends, got = time.time() + 90, []
        while time.time() < ends and len(got) < 13:
            time.sleep(1)
            if (tmp_path / "out").exists():
                got = [(r.video_id, r.frame_idx, r.status, r.batch) for r in spark.read.schema("video_id long, frame_idx int, status string, batch int").parquet(f"{tmp_path}/out").collect()]
    finally:
        query.stop()
    assert sorted(r[:3] for r in got) == [(1, i, "recovered" if i in (3, 8) else "in_order") for i in range(12)] + [(2, 0, "in_order")]
    batch = {r[1]: r[3] for r in got if r[0] == 1}
    assert batch[2] < batch[3] == batch[7] < batch[8] == batch[11]


@pytest.mark.parametrize("place", ["begin", "written", "marked"])
def test_no_segment_twice_and_none_lost(spark, tmp_path, place):
    """Broken off at a place of the second batch, and started again."""
    table = spark.range(0, 400).select((F.col("id") % 3).alias("video_id"), F.floor(F.col("id") / 3).cast("int").alias("frame_idx"))
    for i in range(4):
        table.where(f"frame_idx % 4 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    broken = []

    def at(now, n):
        if now == place and n == 1 and not broken:
            broken.append(n)
            raise ValueError(place)

    with pytest.raises(StreamingQueryException):
        jobs.write_segments(source, f"{tmp_path}/out", f"{tmp_path}/state", 0, 50, at).awaitTermination()
    jobs.write_segments(source, f"{tmp_path}/out", f"{tmp_path}/state", 0, 50, at).awaitTermination()
    rows = jobs.committed(spark, f"{tmp_path}/out")
    assert sorted((r.video_id, r.frame_idx) for r in rows.collect()) == sorted((r.video_id, r.frame_idx) for r in table.collect())
    said = {(r.video_id, r.seg_idx): r.frames for r in jobs.segment_checkpoint(spark, f"{tmp_path}/out").collect()}
    assert said == {(r.video_id, r.seg_idx): r["count"] for r in rows.groupBy("video_id", "seg_idx").count().collect()}


def test_frames_by_runs(spark):
    whole = spark.range(0, 4000).select((F.col("id") % 4).alias("video_id"), F.floor(F.col("id") / 400).cast("int").alias("seg_idx"), F.floor(F.col("id") / 4).cast("int").alias("frame_idx"))
    # one frame lost, one exchanged for another, one segment gone, one frame twice
    odd = whole.where("not (video_id = 1 and frame_idx = 150) and not (video_id = 2 and seg_idx = 7)")
    odd = odd.withColumn("frame_idx", F.when(F.expr("video_id = 3 and frame_idx = 333"), 334).otherwise(F.col("frame_idx"))).union(whole.where("video_id = 0 and frame_idx = 20"))
    got, plain = segments.frames_missing_extra_by_runs(whole, odd), segments.frames_missing_extra(whole, odd)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 102
    assert segments.suspicious_segments(whole, odd).count() == 4  # of 40: a tenth is compared frame by frame
    assert segments.frames_missing_extra_by_runs(whole, whole).count() == 0 and segments.suspicious_segments(whole.limit(0), whole.limit(0)).count() == 0


@pytest.mark.parametrize("max_age", [2, 3])
def test_lifespans_as_a_stream(spark, tmp_path, max_age):
    """Gaps of max_age and of max_age + 1 frames; a last frame far behind closes all other spans."""
    rows = [(1, k, f) for k in (1, 2) for f in (0, 1, 3, 6, 9, 13, 14, 20 + k)] + [(2, 1, 5), (9, 9, 10**6)]
    table = spark.createDataFrame(rows, "video_id long, track_id int, frame_idx int")
    table.write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_lifespans(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), max_age, 30000 / 1001)
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    plain = tracking.track_lifespans(table.withColumn("det_seq", F.lit(0)), max_age).where("video_id < 9").collect()
    assert sorted((r.video_id, r.track_id, r.first_frame, r.last_frame, r.length) for r in got) == sorted((r.video_id, r.track_id, r.first_frame, r.last_frame, r.length) for r in plain)
    assert len(got) > 4
