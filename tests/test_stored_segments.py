"""Segments that lie in a folder: counts from footers, and splicing that leaves other files alone."""

from pyspark.sql import functions as F

from vidtables.operators import segments, verify
from vidtables.sources import checkpoints
from vidtables.sources.shared import configured


def table(spark):
    return spark.range(0, 600).select((F.col("id") % 2).alias("video_id"), F.floor(F.col("id") / 100).cast("int").alias("seg_idx"), F.floor(F.col("id") / 2).cast("int").alias("frame_idx"), F.col("id").alias("x"))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_counts_come_from_footers(spark, tmp_path):
    checkpoints.segment_sink(table(spark), f"{tmp_path}/t")
    with configured(spark, verify.FOOTERS):
        counts = verify.footer_counts(spark, f"{tmp_path}/t")
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [video_id, seg_idx]" in plan
        assert "ReadSchema: struct<video_id:int,seg_idx:int,count(*):bigint>" in plan or "count(*)" in plan
    recorded = spark.createDataFrame([(0, 0, 50), (0, 1, 49), (1, 9, 3)], "video_id long, seg_idx int, frames long")
    got = {(r.video_id, r.seg_idx): (r.actual, r.status) for r in verify.segment_verify_stored(recorded, f"{tmp_path}/t").collect()}
    assert got == {(0, 0): (50, "ok"), (0, 1): (50, "corrected"), (1, 9): (0, "dropped")}
    plain = verify.segment_verify(recorded, table(spark))
    assert got == {(r.video_id, r.seg_idx): (r.actual, r.status) for r in plain.collect()}


def test_splice_rewrites_only_the_range(spark, tmp_path):
    checkpoints.segment_sink(table(spark), f"{tmp_path}/t")
    before = files(tmp_path / "t")
    ranges = spark.createDataFrame([(0, 70, 120)], "video_id long, range_start int, range_end int")
    checkpoints.splice_stored(table(spark).withColumn("x", -F.col("x")), ranges, f"{tmp_path}/t")
    after = files(tmp_path / "t")
    changed = {p.split("/t/")[1].rsplit("/", 1)[0] for p, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"video_id=0/seg_idx=1", "video_id=0/seg_idx=2"}
    rows = spark.read.parquet(f"{tmp_path}/t")
    expected = segments.splice(table(spark), table(spark).withColumn("x", -F.col("x")), ranges)
    assert sorted((r.video_id, r.frame_idx, r.x) for r in rows.collect()) == sorted((r.video_id, r.frame_idx, r.x) for r in expected.collect())
