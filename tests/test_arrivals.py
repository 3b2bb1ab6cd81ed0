"""Streams over tables of several files, and the state calls of a trigger."""

import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from test_units import Handle, Map
from vidtables.jobs import stateful_queries
from vidtables.operators import tracking, verify
from vidtables.sources import catalog, checkpoints
from vidtables.sources.shared import configured
from vidtables.streaming import jobs

SF = "/root/testdata/sf0.001"


class Counting(Handle):
    """A map of state that counts what is asked of it."""

    def getMapState(self, *_):
        held, self.calls = Map(self.map), []
        for name in ("keys", "containsKey", "updateValue", "removeKey"):
            setattr(held, name, lambda *x, f=getattr(held, name): self.calls.append(1) or f(*x))
        return held


def test_a_trigger_reads_and_writes_only_what_waits():
    """A fifth of 5,000 indexes is missing: state is asked once for what waits, not for each row and each gap."""
    video, handle = jobs.Reassembly(50, None), Counting()
    video.init(handle)
    there = [i for i in range(5000) if i % 5 != 2]
    got = []
    for lo, hi in ((0, 2000), (2000, 4000)):
        got += [tuple(r) for x in video.handleInputRows((1,), iter([pd.DataFrame({"frame_idx": there[lo:hi]})]), None) for r in x[["frame_idx", "status"]].values.tolist()]
    assert got == [(i, "recovered" if i % 5 == 2 else "in_order") for i in range(len(got))] and len(got) > 4900
    assert len(handle.calls) < 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "table"), [("stream_late", "events"), ("stream_reassemble", "events"), ("stream_track", "embeddings")])
def test_files_may_be_written_in_any_order(spark, tmp_path, name, table):
    """Six files of a table, the last one written first: the same rows as from one file."""
    rows = pq.read_table(f"{SF}/{table}.parquet")
    (tmp_path / f"{table}.parquet").mkdir()
    step = -(-len(rows) // 6)
    for i in range(6):
        path = tmp_path / f"{table}.parquet" / f"part-{i}.parquet"
        pq.write_table(rows.slice(i * step, step), path)
        os.utime(path, (10**9 - 1000 * i, 10**9 - 1000 * i))
    run = stateful_queries.QUERIES[name]
    one, several = run(spark, SF).collect(), run(spark, str(tmp_path)).collect()
    assert len(one) > 0 and sorted(map(str, several)) == sorted(map(str, one))


def test_files_of_a_batch_do_not_grow_with_its_segments(spark, tmp_path):
    """A thousand segments come as a file for each task, and are all there."""
    rows = pd.DataFrame({"video_id": [i % 10 for i in range(4000)], "frame_idx": pd.array([i // 10 for i in range(4000)], "int32")})
    (tmp_path / "in").mkdir()
    rows.to_parquet(tmp_path / "in" / "part-0.parquet")
    source = spark.readStream.schema("video_id long, frame_idx int").parquet(f"{tmp_path}/in")
    jobs.write_segments(source, f"{tmp_path}/out", f"{tmp_path}/state", 0, 4).awaitTermination()
    found = jobs.written_segments(jobs.committed(spark, f"{tmp_path}/out")).collect()
    assert len(found) == 1000 and {r.frames for r in found} == {4} and sum(not r.closed for r in found) == 10
    assert len(list((tmp_path / "out").rglob("*.parquet"))) < 20


def test_null_slots_are_not_dealt_by_their_name(spark):
    """Of 3,000 slots 1,000 are skipped: no partition of the join with the gallery gets those."""
    lists = spark.range(1000).select(F.col("id").alias("video_id"), F.concat_ws(",", F.col("id").cast("string"), F.lit(" Skip"), (F.col("id") + 1).cast("string")).alias("sources"))
    gallery = spark.range(500).select(F.col("id").cast("string").alias("name"), F.array(F.col("id").cast("float")).alias("embedding"))
    with configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        slots = catalog.slots_scan(lists, gallery)
        sizes = [n for n in slots.rdd.mapPartitions(lambda it: [sum(r.is_skip for r in it)]).collect() if n]
        got = {(r.video_id, r.position): r for r in slots.collect()}
    assert sum(sizes) == 1000 and max(sizes) < 1000
    assert len(got) == 3000 and got[7, 0].embedding == [7.0] and got[7, 2].embedding == [8.0] and got[700, 0].embedding is None
    assert [(got[7, i].is_skip, got[7, i].embedding is None) for i in range(3)] == [(False, False), (True, True), (False, False)]


def test_a_mean_is_worked_out_once(spark):
    """The plan weights a track's vectors in one place, and the mean is that of numpy, for histories longer than HISTORY too."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20, 6))
    table = spark.createDataFrame([(1, 0, i, i, v.tolist()) for i, v in enumerate(vectors)], "video_id long, track_id int, frame_idx int, det_seq long, embedding array<double>")
    for size in (3, 15):
        out = tracking.track_mean_embedding(table, size)
        got = {r.det_seq: r["mean"] for r in out.collect()}
        for i in range(20):
            held = np.array([*vectors[max(0, i + 1 - size) : i + 1], vectors[i]])
            mean = np.linspace(0.5, 1.0, len(held)) @ held
            assert np.allclose(got[i], mean / np.linalg.norm(mean))
        assert out._jdf.queryExecution().optimizedPlan().toString().count("concat(history") == 1


def test_segments_that_share_folders(spark, tmp_path):
    """600 segments in 6 folders: counted, and spliced with only the folders in range written again."""
    table = spark.range(0, 6000).select((F.col("id") % 2).alias("video_id"), F.floor(F.col("id") / 20).cast("int").alias("seg_idx"), F.floor(F.col("id") / 2).cast("int").alias("frame_idx"), F.col("id").alias("x"))
    checkpoints.segment_sink(table, f"{tmp_path}/t", block=100)
    files = lambda: {str(p.relative_to(tmp_path / "t")): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    assert len(before) == 6
    recorded = spark.createDataFrame([(0, 0, 10), (0, 1, 9), (1, 299, 10), (1, 900, 3)], "video_id long, seg_idx int, frames long")
    got = {(r.video_id, r.seg_idx): (r.actual, r.status) for r in verify.segment_verify_stored(recorded, f"{tmp_path}/t").collect()}
    assert got == {(0, 0): (10, "ok"), (0, 1): (10, "corrected"), (1, 299): (10, "ok"), (1, 900): (0, "dropped")}
    ranges = spark.createDataFrame([(0, 995, 1017)], "video_id long, range_start int, range_end int")
    new = table.where("frame_idx <> 1003").withColumn("x", -F.col("x"))
    checkpoints.splice_stored(new, ranges, f"{tmp_path}/t", 100)
    assert {p.rsplit("/", 1)[0] for p, _ in set(before.items()) ^ set(files().items())} == {"video_id=0/seg_block=0", "video_id=0/seg_block=1"}
    rows = sorted((r.video_id, r.seg_idx, r.frame_idx, r.x) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    spliced = [(i % 2, i // 20, i // 2, -i if i % 2 == 0 and 995 <= i // 2 < 1017 else i) for i in range(6000) if i != 2006]
    assert rows == sorted(spliced)
