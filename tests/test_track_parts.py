"""Speculative parts give what the tracker gives over whole videos."""

import numpy as np
import pandas as pd
import pytest

from test_units import random_video
from vidtables.operators import tracking


@pytest.mark.parametrize(("apply_all", "size"), [(False, 10), (True, 40)])
def test_parts_equal_the_sequential_tracker(spark, apply_all, size):
    params = tracking.Params(max_age=4, reset_interval=10, apply_all=apply_all)
    rows = [(v, f, p, 10 * f + p, x.tolist()) for v, frames in ((1, 200), (2, 23), (3, 1)) for f, p, x in random_video(np.random.default_rng(v), frames)]
    table = spark.createDataFrame(rows, "video_id long, frame_idx int, position int, det_seq long, embedding array<double>")
    slots = spark.createDataFrame([(v, p, p == 1) for v in (1, 2, 3) for p in range(3)], "video_id long, position int, is_skip boolean")
    whole = tracking.track_detections(table, slots, params)
    parts, rounds = tracking.track_detections_in_parts(table, slots, params, size)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    print(rounds)
    assert rounds[0] == table.selectExpr("video_id", f"frame_idx div {size}").distinct().count() and len(rounds) > 1
    assert sum(rounds) < 10 * rounds[0]  # run again are few parts


def test_rows_of_many_parts_go_on_together():
    video = random_video(np.random.default_rng(3), 200)
    pdf = pd.DataFrame([(1, f // 5, f, p, 10 * f + p, x, 3, (1,), None) for f, p, x in video], dtype=object)
    together, alone = (list(tracking.track_part_batches(iter([pdf]), tracking.Params(), at_once)) for at_once in (4 << 20, 1))
    assert len(together) == 1 and len(alone) > 40
    rows = [[tuple(None if pd.isna(v) else v for v in r) for x in found for r in x.itertuples(index=False)] for found in (together, alone)]
    assert rows[0] == rows[1]
    assert len(together[0]) == len(video) + len({f // 5 for f, _, _ in video})


def test_a_state_comes_back(spark):
    params = tracking.Params(max_age=4, reset_interval=10, apply_all=True)
    tracker = tracking.Tracker(params, 3, (1,))
    rows = random_video(np.random.default_rng(9), 40)
    for f in sorted({r[0] for r in rows}):
        tracking.rows_of(1, f, [(p, 10 * f + p, v) for g, p, v in rows if g == f], tracker)
        assert tracking.Tracker.of_state(params, tracker.state()).state() == tracker.state()


def test_no_rows(spark):
    table = spark.createDataFrame([], "video_id long, frame_idx int, position int, det_seq long, embedding array<double>")
    slots = spark.createDataFrame([], "video_id long, position int, is_skip boolean")
    parts, rounds = tracking.track_detections_in_parts(table, slots)
    assert parts.count() == 0 and rounds == [0]
