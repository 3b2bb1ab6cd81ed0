"""Hand-made edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oracles import differences
from vidtables.functions import scalars, vectors
from vidtables.jobs import catalogue
from vidtables.operators import boxes, matching, segments, stats, tracking, verify
from vidtables.sources import catalog
from vidtables.sources.shared import configured
from vidtables.streaming import jobs


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_time(spark):
    cases = [("90", 90.0), ("1:30", 90.0), ("0:01:30", 90.0), ("1:02:03.5", 3723.5), ("1:2:3:4", None), ("abc", None), (None, None), ("", None)]
    assert values(spark, [(a,) for a, _ in cases], "t string", scalars.parse_time(F.col("t"))) == [(b,) for _, b in cases]


def test_frame_to_time(spark):
    got = values(spark, [(0, 25.0), (2250, 25.0), (90000, 25.0), (None, 25.0)], "n int, f double", scalars.frame_to_time(F.col("n"), F.col("f")))
    assert got == [("00:00.000",), ("01:30.000",), ("01:00:00.000",), (None,)]


def test_format_duration(spark):
    got = values(spark, [(0.0,), (61.9,), (3600.0,), (36061.5,), (None,)], "s double", scalars.format_duration(F.col("s")))
    assert got == [("00:00",), ("01:01",), ("01:00:00",), ("10:01:01",), (None,)]


def test_fps_parse(spark):
    cases = [("30000/1001", 30000 / 1001), ("0/0", 30.0), ("N/A", 30.0), ("300", 30.0), ("240", 240.0), ("-5", 30.0), (None, 30.0), ("1/2/3", 30.0)]
    got = values(spark, [(a,) for a, _ in cases], "t string", scalars.fps_parse(F.col("t")))
    assert [g[0] for g in got] == pytest.approx([b for _, b in cases])


def test_fps_rational(spark):
    df = spark.createDataFrame([(29.97,), (23.98,), (24.0,), (12.5,), (None,)], "fps double")
    assert {(r.fps, r.fps_rational) for r in scalars.fps_rational(df).collect()} == {(29.97, "30000/1001"), (23.98, "24000/1001"), (24.0, "24/1"), (12.5, "25/2"), (None, None)}


def test_resolutions(spark):
    r = scalars.resolution_parse(F.col("t"))
    assert values(spark, [("512x512",), ("big",), (None,), ("1x2x3",)], "t string", r["width"], r["height"]) == [(512, 512), (256, 256), (256, 256), (256, 256)]
    e = scalars.resolution_even(F.col("w"), F.col("h"))
    assert values(spark, [(5, 7), (0, 4), (-1, 4), (8, 8)], "w int, h int", e["width"], e["height"]) == [(4, 8), (0, 0), (0, 0), (8, 8)]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), (None, [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([math.nan, 1.0], [1.0, 1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")), vectors.vec_valid(F.col("a")).isNotNull())
    assert [g[1] for g in got] == [True, True, False, False, False]
    assert [g[0] for g in got[:4]] == [1.0, -1.0, -1.0, -1.0]
    assert values(spark, [([3.0, 4.0],), ([0.0],), (None,)], "a array<double>", vectors.vec_normalize(F.col("a"))) == [([0.6, 0.8],), (None,), (None,)]


def test_tiers(spark):
    got = values(spark, [(149.0,), (150.0,), (350.0,), (199.0,), (200.0,)], "s double", boxes.box_tier(F.col("s")), boxes.box_tier(F.col("s"), True))
    assert got == [(128, 256), (256, 256), (512, 768), (256, 256), (256, 512)]


def test_greedy_assign(spark):
    rows = [(1, 0, p, r, p, s) for p, r, s in ((0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.2))]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, position int, ref int, det_seq long, similarity double")
    assert sorted((r.position, r.ref) for r in matching.greedy_assign(df).collect()) == [(0, 0), (1, 1)]
    assert matching.greedy_assign(df.limit(0)).count() == 0


def test_greedy_assign_is_one_to_one_and_maximal(spark):
    rng = random.Random(3)
    rows = [(v, 0, p, r, p, round(rng.random(), 1)) for v in range(20) for p in range(4) for r in range(3) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, position int, ref int, det_seq long, similarity double")
    got = {(r.video_id, r.position, r.ref) for r in matching.greedy_assign(df).collect()}
    for v in range(20):
        used, expected = set(), set()
        for s, p, r in sorted((-s, p, r) for w, _, p, r, _, s in rows if w == v):
            if ("p", p) not in used and ("r", r) not in used:
                used |= {("p", p), ("r", r)}
                expected.add((v, p, r))
        assert {g for g in got if g[0] == v} == expected


def done(spark, rows):
    return spark.createDataFrame([(v, i, n) for v, d in rows.items() for i, n in d.items()], "video_id long, seg_idx int, frames int")


def test_prefix_and_next(spark):
    d = done(spark, {1: {0: 600, 1: 600, 3: 412}, 2: {1: 600}, 3: {0: 1, 1: 1}})
    assert {r.video_id: r.prefix_frames for r in segments.contiguous_prefix(d).collect()} == {1: 1200, 2: 0, 3: 2}
    assert {r.video_id: r.next_segment for r in segments.next_segment(d).collect()} == {1: 2, 2: 0, 3: 2}


def test_segment_plan(spark):
    ranges = spark.createDataFrame([(1, 0, 1500), (2, 0, 1500), (3, 5, 5)], "video_id long, range_start int, range_end int")
    got = segments.segment_plan(segments.resume_frame(ranges, done(spark, {2: {0: 600}})), 600)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 600), (1, 1, 600, 1200), (1, 2, 1200, 1500), (2, 1, 600, 1200), (2, 2, 1200, 1500)]


def test_segment_sample_size(spark):
    d = done(spark, {n: {i: 1 for i in range(n)} for n in (1, 9, 25, 1000)})
    assert {r.video_id: r["count"] for r in segments.segment_sample(d).groupBy("video_id").count().collect()} == {1: 1, 9: 1, 25: 2, 1000: 50}


def test_similarity_join_with_many_references(spark):
    rng = random.Random(4)
    rows = [(v, f, p, 10 * f + p, [rng.gauss(0, 1) for _ in range(4)]) for v in (1, 2) for f in range(40) for p in range(2)]
    dets = spark.createDataFrame(rows, "video_id long, frame_idx int, position int, det_seq long, embedding array<float>")
    refs = dets.where("frame_idx = 0")
    few, many = (matching.similarity_join(dets, refs, 0.3, n) for n in (None, matching.BROADCAST_ROWS + 1))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() > 10


def test_progress_marks_by_spans(spark):
    log = spark.createDataFrame([(w, 3 * i + w, float(i % 7)) for w in (0, 1) for i in range(1050)], "worker_id long, frame_idx long, elapsed_ms double")
    totals = log.groupBy("worker_id").agg(F.count("*").alias("total"))
    got = {span: sorted(map(str, stats.progress_marks(log, totals, span=span).collect())) for span in (4, 1 << 16)}
    assert got[4] == got[1 << 16] and len(got[4]) == 20


def test_duration_check(spark):
    rows = [(100.0, 101.0), (100.0, 101.1), (1500.0, 1501.5), (3600.0, 3602.0), (3600.0, 3602.1)]
    df = spark.createDataFrame(rows, "original double, final double")
    assert [r.ok for r in verify.duration_check(df).collect()] == [True, False, True, True, False]


def test_splice_keeps_the_frames(spark):
    frames = spark.createDataFrame([(1, i, i) for i in range(10)] + [(2, 0, 0)], "video_id long, frame_idx int, x int")
    ranges = spark.createDataFrame([(1, 3, 6)], "video_id long, range_start int, range_end int")
    got = segments.splice(frames, frames.withColumn("x", -F.col("x")), ranges).collect()
    assert sorted((r.video_id, r.frame_idx) for r in got) == [(1, i) for i in range(10)] + [(2, 0)]
    assert {r.frame_idx for r in got if r.origin == "processed"} == {3, 4, 5}


def random_video(rng, frames, people=3, size=16):
    base = rng.normal(size=(people + 1, size))
    rows = []
    for f in range(frames):
        if f % 11 == 7:
            continue
        seen = [k for k in range(people) if f == 0 or rng.random() < 0.8] + [people] * (f > frames // 2)  # one more comes late
        rows += [(f, p, base[k] + rng.normal(scale=0.4, size=size)) for p, k in enumerate(seen)]
    return rows


def slow_tracks(rows, params, n_slots, skips):
    tracker = tracking.Tracker(params, n_slots, skips)
    out = []
    for f in sorted({r[0] for r in rows}):
        out += tracking.rows_of(1, f, [(p, 10 * f + p, v) for g, p, v in rows if g == f], tracker)
    return out


@pytest.mark.parametrize("apply_all", [False, True])
def test_tracker_gives_no_track_twice_in_a_frame(apply_all):
    params = tracking.Params(max_age=4, reset_interval=10, apply_all=apply_all)
    out = slow_tracks(random_video(np.random.default_rng(5), 80), params, 3, (1,))
    seen = [(r[1], r[4]) for r in out if r[4] is not None]
    assert len(seen) == len(set(seen)) and len(seen) > 100
    assert any(r[9] for r in out) and (not apply_all or any(r[11] for r in out))


def test_tracker_does_not_depend_on_batches():
    params = tracking.Params(max_age=4, reset_interval=10)
    rows = random_video(np.random.default_rng(6), 60)
    table = pd.DataFrame([(1, 0, f, p, 10 * f + p, v, 3, [1]) for f, p, v in rows])
    whole = pd.concat(tracking.track_batches(iter([table]), params))
    cut = pd.concat(tracking.track_batches(iter([table[i : i + 7] for i in range(0, len(table), 7)]), params))
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), cut.reset_index(drop=True))
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), tracking.frame_of(slow_tracks(rows, params, 3, (1,))).reset_index(drop=True))


class State:
    """Stands in for the engine's keyed state."""

    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def stream_params():
    return tracking.Params(max_age=4, reset_interval=10)


def detection_table(seed, frames):
    rows = random_video(np.random.default_rng(seed), frames)
    return rows, pd.DataFrame([(1, f, p, 10 * f + p, v.tolist(), 3, [1]) for f, p, v in rows], columns=["video_id", "frame_idx", "position", "det_seq", "embedding", "n_slots", "skips"])


def test_stream_tracker_equals_batch():
    rows, table = detection_table(7, 40)
    frames = table.frame_idx.unique()
    for shuffled in (False, True):
        state, out, patience = State(), [], 6
        order = sorted(range(len(table)), key=lambda i: table.frame_idx[i] // 5) if not shuffled else sorted(range(len(table)), key=lambda i: (table.frame_idx[i] // 3, -i))
        for i in range(0, len(table), 9):
            out += jobs.track_group((1,), iter([table.iloc[order[i : i + 9]]]), state, stream_params(), patience)
        expected = tracking.frame_of([r for r in slow_tracks(rows, stream_params(), 3, (1,)) if r[1] in frames[:-patience]])
        pd.testing.assert_frame_equal(pd.concat([x for x in out if len(x)]).reset_index(drop=True), expected.reset_index(drop=True))
        held = pd.concat(jobs.flushed(iter([pd.DataFrame({"video_id": [1], "held": [state.get[0]]})])))
        assert len(held) + len(expected) == len(table) and set(held.frame_idx) == set(frames[-patience:])


def test_a_late_detection_is_told():
    _, table = detection_table(7, 40)
    state = State()
    list(jobs.track_group((1,), iter([table[3:]]), state, stream_params(), 2))
    late = pd.concat(jobs.track_group((1,), iter([table[:3]]), state, stream_params(), 2))
    assert late.decision.tolist() == ["late"] * 3 and late.track_id.isna().all() and late.det_seq.tolist() == table.det_seq[:3].tolist()


def drained(spark, table, folder, stream, flush, parts):
    """Rows of a stream over `parts` files in a mixed order, and of its flush."""
    for i in range(parts):
        table.iloc[i::parts].to_parquet(f"{folder}/in-{i}.parquet")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in-*.parquet").schema).option("maxFilesPerTrigger", 2).option("pathGlobFilter", "in-*.parquet").parquet(str(folder))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    with jobs.rocksdb(spark):
        query = stream(source).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch").unionByName(flush(spark, f"{folder}/state"))


def test_stream_and_flush_give_what_the_batch_gives(spark, tmp_path):
    rows, table = detection_table(8, 40)
    got = drained(spark, table, tmp_path, lambda s: jobs.stream_track(s, stream_params(), 50), jobs.flush_tracks, 9)
    expected = {(r[1], r[3]): (r[4], r[7]) for r in slow_tracks(rows, stream_params(), 3, (1,))}
    assert {(r.frame_idx, r.det_seq): (r.track_id, r.decision) for r in got.collect()} == expected and got.count() == len(table)


def test_stream_reassembly_with_flush(spark, tmp_path):
    frames = [i for i in range(90) if i % 13 != 5]
    table = pd.DataFrame({"video_id": [1] * len(frames), "frame_idx": pd.array(frames, "int32")})
    got = drained(spark, table, tmp_path, lambda s: jobs.stream_reassemble(s, 80), jobs.flush_reassembly, 9)
    assert sorted((r.frame_idx, r.status) for r in got.collect()) == [(i, "in_order" if i in frames else "recovered") for i in range(90)]


class Handle:
    """Stands in for the engine's state variables."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Map(self.map)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map:
    def __init__(self, held):
        self.keys, self.containsKey = held.keys, held.__contains__
        self.removeKey, self.updateValue = held.pop, held.__setitem__


def test_reassembly():
    video = jobs.Reassembly(2, None)
    video.init(Handle())
    feed = lambda *x: list(map(tuple, pd.concat(video.handleInputRows((1,), iter([pd.DataFrame({"frame_idx": x})]), None))[["frame_idx", "status"]].values.tolist()))
    assert feed(1, 0) == [(0, "in_order"), (1, "in_order")]
    assert feed(3, 4) == []
    assert feed(5) == [(2, "recovered"), (3, "in_order"), (4, "in_order"), (5, "in_order")]
    assert feed(2) == [(2, "late")]


def test_fallback_takes_the_first_pass_of_the_plan(spark):
    schema = "video_id long, frame_idx int, pass_no int, det_seq long, x1 double, y1 double, x2 double, y2 double, kps array<array<double>>"
    rows = [(1, 0, 2, 1, 10.0, 20.0, 30.0, 40.0, [[5.0, 6.0]]), (1, 0, 3, 2, 1.0, 1.0, 2.0, 2.0, None), (1, 1, 0, 3, 1.0, 2.0, 3.0, 4.0, None), (1, 1, 1, 4, 9.0, 9.0, 9.0, 9.0, None)]
    rows += [(2, 0, 1, 5, 16.0, 16.0, 32.0, 32.0, [[8.0, 8.0]]), (3, 0, 1, 6, 1.0, 1.0, 2.0, 2.0, None), (4, 0, 0, 7, 1.0, 1.0, 2.0, 2.0, None)]
    videos = spark.createDataFrame([(1, 1920, 1080), (2, 400, 300), (3, 640, 480)], "video_id long, width int, height int")
    got = {r.det_seq: r for r in boxes.detect_with_fallback(spark.createDataFrame(rows, schema), videos).collect()}
    assert set(got) == {1, 3, 5}  # video 3 has one pass only, video 4 no size
    assert (got[1].scale, got[1].x1, got[1].y2, got[1].kps) == (0.5, 20.0, 80.0, [[10.0, 12.0]])
    assert (got[3].scale, got[3].x2, got[3].kps) == (1.0, 3.0, None) and (got[5].scale, got[5].x1, got[5].kps) == (1.6, 10.0, [[5.0, 5.0]])


def test_places_go_on_from_range_to_range(spark):
    draw = random.Random(4)
    rows = [(draw.choice((1, 1, 1, 2, None)), draw.choice((None, draw.randrange(-(10**12), 10**12)))) for _ in range(3000)] + [(1, 7)] * 40
    last = lambda v: (v is None, v or 0)
    with configured(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        numbered = catalog.numbered(spark.createDataFrame(rows, "video_id int, k long"), "video_id", "k")
        assert len(numbered.inputFiles()) > 2  # ranges
        got = numbered.collect()
    assert len(got) == len(rows)
    for video in (1, 2, None):
        own = sorted((r.place, r.k) for r in got if r.video_id == video)
        assert own == list(enumerate(sorted((k for v, k in rows if v == video), key=last)))
    assert catalog.numbered(spark.createDataFrame([], "video_id int, k long"), "video_id", "k").count() == 0


def test_frames_without_detections_are_numbered_whatever_their_ids(spark, tmp_path):
    """Ids with gaps, equal, negative and beyond 2^31 times ten: frames count on from 0 in each video, three detections to each of the first."""
    draw = random.Random(5)
    ids = [draw.randrange(-(10**12), 10**12) * 10 for _ in range(400)] + [30] * 5
    events = [(i, draw.choice((3, 14, 25, None)), "view", 1.0) for i in ids]
    detected = [(draw.randrange(10**12), draw.choice((3, 4, 4, 5, None))) for _ in range(200)]
    columns = dict(zip(("event_id", "user_id", "event_type", "value"), map(list, zip(*events))))
    pq.write_table(pa.table(columns | {"ts": pa.array([0] * len(events), pa.timestamp("us"))}), tmp_path / "events.parquet")
    embeddings = {"vec_id": [i for i, _ in detected], "label": pa.array([label for _, label in detected], pa.int32()), "embedding": [[1.0]] * len(detected)}
    pq.write_table(pa.table(embeddings), tmp_path / "embeddings.parquet")
    expected = []
    for video in (3, 4, 5, None):
        own = sorted(i for i, user, *_ in events if (user if user is None else user % 10) == video)
        found = 0 if video is None else -(-sum(label == video for _, label in detected) // 3)
        expected += [(video, n, i) for n, i in enumerate(own) if n >= found]
    run = catalogue.queries()["frames_without_detections"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect()), key=order) == sorted(expected, key=order)
    assert differences(spark, str(tmp_path), run, catalogue.oracle_sql()["frames_without_detections"]) == ([], [], 0)
