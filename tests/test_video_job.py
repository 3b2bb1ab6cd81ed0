"""The whole job: what a broken and resumed run gives, damaged segments, checks."""

import random

import pytest

from vidtables.jobs import video_job
from vidtables.sources import checkpoints

SIZE = 10
SCHEMA = "x int"
LENGTHS = {1: 95, 2: 40, 3: 7, 4: 60}
RANGES = [(1, 5, 88), (2, 0, 40), (3, 0, 7)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(v, i, v * 1000 + i) for v, n in LENGTHS.items() for i in range(n)]
    frames = spark.createDataFrame(rows, "video_id long, frame_idx int, x int")
    results = spark.createDataFrame([(v, i, -x) for v, i, x in rows if rng.random() < 0.9], "video_id long, frame_idx int, x int")
    videos = spark.createDataFrame([(v, n, 10.0) for v, n in LENGTHS.items()], "video_id long, total_frames int, fps double")
    ranges = spark.createDataFrame(RANGES, "video_id long, range_start int, range_end int")
    return frames.cache(), results.cache(), videos, ranges


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def expected_frames(tables, lost=()):
    done = {(r.video_id, r.frame_idx) for r in tables[1].collect()} - set(lost)
    ends = {v: (a, b) for v, a, b in RANGES}
    out = []
    for v, n in LENGTHS.items():
        for i in range(n):
            inside = v in ends and ends[v][0] <= i < ends[v][1]
            x = v * 1000 + i
            out.append((v, i, -x if inside and (v, i) in done else x, "processed" if inside else "original", inside and (v, i) not in done))
    return sorted(out)


class Broken(Exception):
    pass


def start(tables, folder, at_once=2, broken_after=None, size=SIZE):
    def after(n):
        if n == broken_after:
            raise Broken

    return video_job.process(*tables, folder, SCHEMA, size, at_once, after)


COLUMNS = ("video_id", "frame_idx", "x", "origin", "recovered")


def test_a_broken_and_resumed_run_gives_the_same_frames(spark, tables, tmp_path):
    whole = start(tables, str(tmp_path / "whole"))
    assert rows_of(whole.frames, *COLUMNS) == expected_frames(tables)
    for k in (0, 2):
        folder = str(tmp_path / f"broken-{k}")
        with pytest.raises(Broken):
            start(tables, folder, broken_after=k)
        before = video_job.load(spark, folder, SCHEMA)[0].count()
        assert 0 < before < 14
        again = start(tables, folder)
        assert rows_of(again.frames, *COLUMNS) == rows_of(whole.frames, *COLUMNS)
        assert rows_of(again.merged, "video_id", "out_idx", "frame_idx", "x") == rows_of(whole.merged, "video_id", "out_idx", "frame_idx", "x")
        assert rows_of(again.checkpoint, "video_id", "seg_idx", "frames") == rows_of(whole.checkpoint, "video_id", "seg_idx", "frames")
        finished = {r.video_id: r for r in again.report.collect()}
        assert all(r.done and r.duration_ok and not r.remerge and r.written == r.expected and r.segments_planned == 0 for r in finished.values())


def test_a_finished_run_merges_what_it_has(tables, tmp_path):
    folder = str(tmp_path)
    start(tables, folder)
    again = start(tables, folder)
    assert again.plan.count() == 0 and again.written.where("is_new").count() == 0
    assert rows_of(again.frames, *COLUMNS) == expected_frames(tables)


def test_written_and_not_marked_is_planned_again(spark, tables, tmp_path, monkeypatch):
    """A failure between the segments' rows and their mark: they are replaced, none is there twice."""
    folder = str(tmp_path)
    sink = checkpoints.segment_sink

    def failing(rows, path, *more):
        sink(rows, path, *more)
        raise Broken

    monkeypatch.setattr(checkpoints, "segment_sink", failing)
    with pytest.raises(Broken):
        start(tables, folder)
    monkeypatch.setattr(checkpoints, "segment_sink", sink)
    assert video_job.load(spark, folder, SCHEMA)[0].count() == 0 and video_job.load(spark, folder, SCHEMA)[1].count() > 0
    assert rows_of(start(tables, folder).frames, *COLUMNS) == expected_frames(tables)


def test_another_segment_size_goes_on(tables, tmp_path):
    """The prefix stays as it is; what is left is cut anew."""
    folder = str(tmp_path)
    with pytest.raises(Broken):
        start(tables, folder, broken_after=1)
    got = start(tables, folder, size=7)
    assert rows_of(got.frames, *COLUMNS) == expected_frames(tables)


def test_damaged_segments(spark, tables, tmp_path):
    folder = str(tmp_path)
    start(tables, folder)
    frames, results, videos, ranges = tables
    done, stored = video_job.load(spark, folder, SCHEMA)
    # segment 3 of video 1 is gone, segment 1 of video 2 has lost its first frames, segment 0 of video 3 its last one
    kept = stored.where("not (video_id = 1 and seg_idx = 3) and not (video_id = 2 and frame_idx in (10, 11)) and not (video_id = 3 and frame_idx = 6)")
    got = video_job.run(*tables[:2], videos, ranges, done, kept, ["x"], SIZE)
    report = {r.video_id: r for r in got.report.collect()}
    assert report[1].segments_before == 3 and report[1].resume == 35 and report[1].frames_todo == 53
    assert report[2].segments_before == 4 and report[2].resume == 38 and report[2].lost_before == 2 and report[2].segments_corrected == 1
    assert report[3].resume == 6 and report[3].frames_todo == 1
    assert rows_of(got.frames, *COLUMNS) == expected_frames(tables, lost=[(2, 10), (2, 11)])
    assert {r.frame_idx for r in got.merged.where("video_id = 2").collect()} == set(range(40)) - {10, 11}
    assert sum(r.recovered_in_all for r in report.values()) == got.frames.where("recovered").count()
    first = [int(i) for i in report[1].first_recovered.split(",")]
    assert first == sorted(r.frame_idx for r in got.frames.where("recovered and video_id = 1").collect())[:20]


def test_empty_tables_and_no_range(spark, tables):
    frames, results, videos, ranges = tables
    done = spark.createDataFrame([], "video_id long, seg_idx int, frames long")
    stored = spark.createDataFrame([], "video_id long, seg_idx int, frame_idx int, x int, recovered boolean")
    got = video_job.run(frames, results, videos, ranges.limit(0), done, stored, ["x"], SIZE)
    assert got.plan.count() == got.merged.count() == got.checkpoint.count() == got.report.count() == 0
    assert {r.origin for r in got.frames.collect()} == {"original"} and got.frames.count() == frames.count()
    nothing = video_job.run(frames.limit(0), results, videos, ranges, done, stored, ["x"], SIZE)
    assert nothing.frames.count() == 0 and all(r.total_frames == 0 and r.written == 0 for r in nothing.report.collect())
