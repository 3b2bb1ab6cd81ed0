"""Identities over frames: a stateful tracker for each video, and analyses of tracks.

A track has its newest vector, the last 12 vectors, its first vector, a stability and a
tolerance. Detections are scored against the weighted mean of a track's vectors under a
threshold that adapts to the track; the best pairs win one-to-one. Every `reset_interval`
frames tracks are bound again to the references of the first frame; tracks unseen for more
than `max_age` frames are lost, and may be recovered for eight times that span.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidtables.functions import vectors
from vidtables.sources.shared import shared_path

HISTORY = 12
OUTPUT = "video_id long, frame_idx int, position int, det_seq long, track_id int, source string, similarity double, decision string, stability int, is_reset boolean, is_recovered boolean, is_new boolean"


@dataclass
class Params:
    max_age: int = 70
    threshold: float = 0.16
    reset_interval: int = 60
    apply_all: bool = False


@dataclass
class Track:
    vector: np.ndarray
    seen: int
    first: np.ndarray
    source: str
    stability: int = 1
    tolerance: int = 0
    history: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.learn()

    def learn(self) -> None:
        """The features that scoring needs, after the history has changed."""
        held = np.array([*self.history, self.vector])
        mean = np.linspace(0.5, 1.0, len(held)) @ held if self.history else self.vector
        size = np.linalg.norm(mean)
        self.mean = mean / size if size > 0 else mean
        self.steps = self.origin = None
        if len(self.history) >= 5:
            steps = np.einsum("ij,ij->i", held[:-2], held[1:-1])
            steps = steps[steps > 0]
            self.steps = (float(steps.var()), float(steps.mean())) if len(steps) else None
        if len(self.history) >= 3:
            origin = held[-4:-1] @ self.first
            origin = origin[origin > 0]
            self.origin = float(origin.mean()) if len(origin) else None

    def add(self, vector: np.ndarray, frame: int) -> None:
        self.vector, self.seen = vector, frame
        self.history = [*self.history, vector][-HISTORY:]
        self.learn()

    def accepts(self, score: float, vector: np.ndarray, t: float) -> bool:
        """Whether a score is enough; near misses are counted in the tolerance."""
        if score < 0:
            return False
        need = max(t, 0.18)
        if self.steps:
            variance, mean = self.steps
            need *= 0.85 if variance > 0.02 else 0.90 if variance > 0.01 else 0.93 if mean < need + 0.03 else 1.0
        if len(self.history) >= 3 and (origin := float(vector @ self.first)) > 0:
            need *= 0.8 if origin > need + 0.1 else 0.85 if origin > need + 0.05 else 1.0
            if self.origin is not None and origin - self.origin > 0.03:
                need *= 0.85
        if need - 0.06 < score < need + 0.02:
            self.tolerance += 1
            if self.tolerance >= 2:
                need *= 1 - min(0.15, 0.03 * self.tolerance)
        elif score > need + 0.02:
            self.tolerance = 0
        need = max(need, 0.15)
        return any(score >= need + margin and self.stability >= least for margin, least in ((0.03, 0), (0.0, 1), (-0.03, 2), (-0.06, 3)))


@dataclass
class Lost:
    vector: np.ndarray
    source: str
    frame: int
    history: list


def verdict(score: float, t: float, stability: int) -> str:
    if score > t + 0.03 or (score > t and stability >= 1) or (score > t - 0.03 and stability >= 2):
        return "act"
    return "hold" if score > t - 0.03 else "none"


class Tracker:
    """The state of one video. The first frame given is its reference frame."""

    def __init__(self, params: Params, n_slots: int, skips: tuple[int, ...]):
        self.p, self.n_slots, self.skips = params, n_slots, frozenset(skips)
        self.refs: dict[int, np.ndarray] = {}
        self.tracks: dict[int, Track] = {}
        self.lost: dict[int, Lost] = {}
        self.begun = False

    def source(self, position: int) -> str:
        if position in self.skips:
            return "SKIP"
        return "SWAP" if self.p.apply_all else str(position)

    def begin(self, frame: int, dets: list[np.ndarray | None]) -> None:
        self.begun = True
        for i, v in enumerate(dets):
            if v is not None and (self.p.apply_all or i < self.n_slots):
                self.refs[i] = v
                self.tracks[i] = Track(v, frame, v, self.source(i))

    def prune(self, frame: int) -> None:
        """Moves tracks that are too old at a frame to the lost ones, and drops old lost ones."""
        age = self.p.max_age
        if age < 0:
            return
        for k, x in list(self.tracks.items()):
            if frame - x.seen > age and not (self.p.apply_all and x.source == "SKIP"):
                self.lost[k] = Lost(x.vector, x.source, x.seen + age + 1, x.history)
                del self.tracks[k]
        for k, x in list(self.lost.items()):
            if frame - x.frame > 8 * age:
                del self.lost[k]

    def reset(self, frame: int, dets: list[np.ndarray | None]) -> None:
        pairs = [(-float(v @ r), i, k) for i, v in enumerate(dets) if v is not None for k, r in self.refs.items() if float(v @ r) >= 0.6 * self.p.threshold]
        used: set[int] = set()
        bound: dict[int, Track] = {}
        for _, i, k in sorted(pairs):
            if i not in used and k not in bound:
                used.add(i)
                old = self.tracks.get(k)
                bound[k] = Track(dets[i], frame, old.first if old else self.refs[k], self.source(k), 2)
        self.tracks = bound | {k: x for k, x in self.tracks.items() if k not in bound and frame - x.seen <= 5}
        for k in bound:
            self.lost.pop(k, None)

    def recover(self, frame: int, dets: list[np.ndarray | None]) -> set[int]:
        found: set[int] = set()
        for v in dets:
            best = (0.0, -1)
            if v is not None:
                for k, x in self.lost.items():
                    skip = x.source == "SKIP"
                    score = max(float(v @ y) for y in (x.vector, *x.history[-3 if skip else -2 :]))
                    if score > (0.75 if skip else 0.7) * self.p.threshold and score > best[0]:
                        best = (score, k)
            if best[1] >= 0:
                x = self.lost.pop(best[1])
                self.tracks[best[1]] = Track(v, frame, x.vector, x.source, 1, 0, x.history)
                found.add(best[1])
        return found

    def frame(self, frame: int, dets: list[np.ndarray | None]) -> list[tuple]:
        """(track, source, similarity, decision, stability, reset, recovered, new) of each detection from the left."""
        t = self.p.threshold
        if not self.begun:
            self.begin(frame, dets)
        self.prune(frame - 1)
        is_reset = bool(self.refs) and frame > 0 and self.p.reset_interval > 0 and frame % self.p.reset_interval == 0
        if is_reset:
            self.reset(frame, dets)
        recovered = self.recover(frame, dets)
        pairs = []
        there = [i for i, v in enumerate(dets) if v is not None]
        if there and self.tracks:
            scores = np.array([dets[i] for i in there]) @ np.array([x.mean for x in self.tracks.values()]).T
            for i, own in zip(there, scores.tolist(), strict=True):
                for order, (k, x) in enumerate(self.tracks.items()):
                    if x.accepts(own[order], dets[i], t):
                        pairs.append((-own[order], i, order, k))
        out: list[tuple] = [(None, None, None, "none", None, is_reset, False, False)] * len(dets)
        matched: set[int] = set()
        taken: set[int] = set()
        for score, i, _, k in sorted(pairs):
            if i in taken or k in matched:
                continue
            taken.add(i), matched.add(k)
            x = self.tracks[k]
            said = verdict(-score, t, x.stability)
            x.stability += said != "none"
            x.add(dets[i], frame)
            out[i] = (k, x.source, -score, said, x.stability, is_reset, k in recovered, False)
        for k, x in self.tracks.items():
            if k not in matched:
                x.stability = max(1, x.stability - 1)
        if self.p.apply_all:
            for i, v in enumerate(dets):
                if v is not None and i not in taken:
                    k = max([-1, *self.tracks, *self.lost]) + 1
                    self.tracks[k] = Track(v, frame, v, "SWAP")
                    out[i] = (k, "SWAP", None, "act", 1, is_reset, False, True)
        self.prune(frame)
        return out


    def state(self) -> bytes:
        """All that decides about later frames, the same bytes for the same state."""
        raw = lambda v: np.ascontiguousarray(v, np.float64).tobytes()
        tracks = [(int(k), raw(x.vector), int(x.seen), raw(x.first), str(x.source), int(x.stability), int(x.tolerance), [raw(h) for h in x.history]) for k, x in self.tracks.items()]
        lost = [(int(k), raw(x.vector), str(x.source), int(x.frame), [raw(h) for h in x.history]) for k, x in self.lost.items()]
        return repr((int(self.n_slots), sorted(map(int, self.skips)), self.begun, [(int(k), raw(r)) for k, r in self.refs.items()], tracks, lost)).encode()

    @staticmethod
    def of_state(params: Params, state: bytes) -> Tracker:
        back = lambda b: np.frombuffer(b, np.float64)
        n_slots, skips, begun, refs, tracks, lost = ast.literal_eval(state.decode())
        out = Tracker(params, n_slots, tuple(skips))
        out.begun, out.refs = begun, {k: back(r) for k, r in refs}
        out.tracks = {k: Track(back(v), seen, back(first), source, stability, tolerance, [back(h) for h in history]) for k, v, seen, first, source, stability, tolerance, history in tracks}
        out.lost = {k: Lost(back(v), source, frame, [back(h) for h in history]) for k, v, source, frame, history in lost}
        return out


def unit(v) -> np.ndarray | None:
    """A vector of length 1, or None where it isn't valid."""
    if v is None:
        return None
    x = np.asarray(v, np.float64)
    size = np.linalg.norm(x)
    return x / size if len(x) and np.isfinite(size) and size > 0 else None


def rows_of(video: int, frame: int, rows: list[tuple], tracker: Tracker) -> list[tuple]:
    """Output rows of one frame from (position, det_seq, embedding)."""
    rows = sorted(rows, key=lambda r: r[0])
    said = tracker.frame(frame, [unit(r[2]) for r in rows])
    return [(video, frame, r[0], r[1], *s) for r, s in zip(rows, said, strict=True)]


COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def track_batches(batches: Iterator[pd.DataFrame], params: Params) -> Iterator[pd.DataFrame]:
    """Runs trackers over rows sorted by video, part, frame and position; a frame may span batches."""
    key = tracker = None
    waiting: list[tuple] = []
    out: list[tuple] = []
    for pdf in batches:
        for video, part, frame, position, seq, vector, n_slots, skips in pdf.itertuples(index=False):
            if key != (video, part, frame):
                if waiting:
                    out += rows_of(key[0], key[2], waiting, tracker)
                    waiting = []
                if key is None or key[:2] != (video, part):
                    tracker = Tracker(params, int(n_slots), tuple(skips))
                key = (video, part, frame)
            waiting.append((position, seq, vector))
        if out:
            yield frame_of(out)
            out = []
    if waiting:
        yield frame_of(rows_of(key[0], key[2], waiting, tracker))


def frame_of(rows: list[tuple], columns: list[str] = COLUMNS) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"track_id": "Int32", "stability": "Int32"})


PARTED = f"{OUTPUT}, part int, end_state binary"
PART_COLUMNS = [*COLUMNS, "part", "end_state"]


def track_part_batches(batches: Iterator[pd.DataFrame], params: Params, at_once: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Runs parts, each from the state that its first row has (frame -1), and tells the state at its end in a further row.

    Rows of many parts, about at_once bytes of them, go on together: a table of its own for each part would cost more than the part."""
    key = tracker = None
    waiting: list[tuple] = []
    out: list[tuple] = []
    size = 0

    def tell(rows: list[tuple], state: bytes | None = None) -> int:
        out.extend((*r, key[1], state) for r in rows)
        return 256 * len(rows) + len(state or b"")

    def end() -> int:
        told = tell(rows_of(key[0], key[2], waiting, tracker)) if waiting else 0
        return told + tell([(key[0], -1, -1, -1, None, None, None, "state", None, False, False, False)], tracker.state())

    for pdf in batches:
        for video, part, frame, position, seq, vector, n_slots, skips, state in pdf.itertuples(index=False):
            if key is None or key[:2] != (video, part):
                if key:
                    size += end()
                key, waiting = (video, part, frame), []
                tracker = Tracker.of_state(params, state) if state is not None else Tracker(params, int(n_slots), tuple(skips))
                if frame < 0:
                    continue
            if frame != key[2]:
                if waiting:
                    size += tell(rows_of(video, key[2], waiting, tracker))
                    waiting = []
                key = (video, part, frame)
            waiting.append((position, seq, vector))
            if size >= at_once:
                yield frame_of(out, PART_COLUMNS)
                out.clear()
                size = 0
    if key:
        end()
        yield frame_of(out, PART_COLUMNS)


def track_detections_in_parts(positions: DataFrame, slots: DataFrame, params: Params = Params(), part_frames: int = 2000) -> tuple[DataFrame, list[int]]:
    """track_detections() with long videos cut in parts that run in parallel, and the number of parts run in each round.

    At first every part begins with the state after the video's first frame. Where the state at the end of a part
    differs from the one that the next part began with, that part runs again from the right one, until none
    differs; so the result is that of the whole video. Rounds end because after each at least one more part of
    a video is final; tracks come together at resets, so few parts run more than twice. A part's rows of its last round count.
    """
    spark = positions.sparkSession
    root = shared_path(spark, "track-parts")
    part = F.floor(F.col("frame_idx") / part_frames).cast("int").alias("part")
    bound = _slots_of(slots)
    rows = positions.select("video_id", part, "frame_idx", "position", "det_seq", "embedding").join(bound, "video_id", "left")
    rows = _with_slots(rows).withColumn("state", F.lit(None).cast("binary"))
    rows.write.parquet(f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    parts = rows.select("video_id", "part").distinct()
    order = Window.partitionBy("video_id").orderBy("part")

    def run(which: DataFrame, begins: DataFrame | None, n: int) -> DataFrame:
        own = rows.join(which, ["video_id", "part"], "left_semi")
        if begins is not None:
            head = begins.select("video_id", "part", *[F.lit(-1).cast(rows.schema[c].dataType).alias(c) for c in ("frame_idx", "position", "det_seq")], *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("embedding", "n_slots", "skips")], "state")
            own = own.unionByName(head)
        dealt = own.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx", "position")
        dealt.mapInPandas(lambda it: track_part_batches(it, params), PARTED).write.parquet(f"{root}/out/round={n}")
        return spark.read.schema(PARTED).parquet(f"{root}/out/round={n}")

    first_frame = rows.groupBy("video_id").agg(F.min("frame_idx").alias("frame_idx"))
    reference = rows.join(first_frame, ["video_id", "frame_idx"], "left_semi").select(rows.columns)
    reference = reference.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx", "position")
    said = reference.mapInPandas(lambda it: track_part_batches(it, params), PARTED).where("decision = 'state'")
    said.select("video_id", F.col("end_state").alias("state")).write.parquet(f"{root}/reference")
    states = spark.read.schema("video_id long, state binary").parquet(f"{root}/reference")

    first = parts.groupBy("video_id").agg(F.min("part").alias("_first"))
    begun = parts.join(first, "video_id").where("part > _first").select("video_id", "part").join(states, "video_id")  # the first part begins by itself
    def held(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{root}/{name}")
        return spark.read.schema(table.schema).parquet(f"{root}/{name}")

    def ends(ran: DataFrame, begins: DataFrame, n: int) -> DataFrame:
        found = ran.where("decision = 'state'").select("video_id", "part", "end_state")
        return found.join(begins, ["video_id", "part"], "left").select("video_id", "part", "state", "end_state", F.lit(n).alias("round"))

    now = held(ends(run(parts, begun, 0), begun, 0), "states/0")
    rounds = [now.count()]
    while True:
        n = len(rounds)
        right = now.withColumn("right", F.lag("end_state").over(order))
        again = held(right.where("right is not null and not (state <=> right)").select("video_id", "part", F.col("right").alias("state")), f"begins/{n}")
        count = again.count()
        if not count:
            break
        rounds.append(count)
        new = ends(run(again.select("video_id", "part"), again, n), again, n)
        now = held(now.join(again.select("video_id", "part"), ["video_id", "part"], "left_anti").select(now.columns).unionByName(new), f"states/{n}")
    out = spark.read.schema(f"{PARTED}, round int").parquet(f"{root}/out").where("decision <> 'state'")
    return out.join(now.select("video_id", "part", "round"), ["video_id", "part", "round"], "left_semi").select(*COLUMNS), rounds


def _slots_of(slots: DataFrame) -> DataFrame:
    return slots.groupBy("video_id").agg(F.count("*").cast("int").alias("n_slots"), F.array_compact(F.collect_set(F.when(F.col("is_skip"), F.col("position")))).alias("skips"))


def _with_slots(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_slots", F.coalesce("n_slots", F.lit(0))).withColumn("skips", F.coalesce("skips", F.array().cast("array<int>")))


def track_detections(positions: DataFrame, slots: DataFrame, params: Params = Params(), part_frames: int | None = None) -> DataFrame:
    """One row for each detection with its track. Slots (video_id, position, is_skip) bind the first frame.

    With part_frames, videos are cut in parts that begin anew, so that long ones spread over tasks.
    """
    part = F.floor(F.col("frame_idx") / part_frames).cast("int") if part_frames else F.lit(0)
    rows = positions.select("video_id", part.alias("part"), "frame_idx", "position", "det_seq", "embedding").join(_slots_of(slots), "video_id", "left")
    dealt = _with_slots(rows).repartition("video_id", "part").sortWithinPartitions("video_id", "part", "frame_idx", "position")
    return dealt.mapInPandas(lambda it: track_batches(it, params), OUTPUT)


def track_detections_all(positions: DataFrame, skips: DataFrame, params: Params = Params(apply_all=True), part_frames: int | None = None) -> DataFrame:
    """The same with one source for all; skips (video_id, position) are left as they are. Unmatched detections open tracks."""
    return track_detections(positions, skips.withColumn("is_skip", F.lit(True)), params, part_frames)


def track_summary(tracked: DataFrame) -> DataFrame:
    return tracked.where("track_id is not null").groupBy("video_id", "track_id").agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count("*").alias("detections"),
        F.round(F.avg("similarity"), 6).alias("mean_similarity"),
        F.count_if(F.col("decision") == "act").alias("acts"),
        F.count_if(F.col("decision") == "hold").alias("holds"),
        F.count_if("is_recovered").alias("recoveries"),
    )


def _track(rows: int | None = None):
    w = Window.partitionBy("video_id", "track_id").orderBy("frame_idx", "det_seq")
    return w.rowsBetween(-rows, 0) if rows is not None else w


def history_window(tracked: DataFrame, size: int = HISTORY) -> DataFrame:
    """Adds history, the last vectors of each track up to each row."""
    return tracked.withColumn("history", F.collect_list("embedding").over(_track(size - 1)))


def track_lifespans(tracked: DataFrame, max_age: int) -> DataFrame:
    """Spans of each track; a gap of more than max_age frames (-1: none) ends one."""
    gap = F.col("frame_idx") - F.lag("frame_idx").over(_track())
    begins = F.coalesce(gap > max_age, F.lit(False)) if max_age >= 0 else F.lit(False)
    rows = tracked.withColumn("_g", gap).withColumn("_b", begins.cast("int")).withColumn("span", F.sum("_b").over(_track().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "track_id", F.col("span").cast("int").alias("span")).agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        (F.max("frame_idx") - F.min("frame_idx") + 1).alias("length"),
        F.count_if((F.col("_g") > 1) & (F.col("_b") == 0)).alias("gaps"),
    )


def track_mean_embedding(tracked: DataFrame, size: int = HISTORY) -> DataFrame:
    """Adds mean, the weighted mean of the history and the newest vector, weights from 0.5 to 1, of length 1."""
    rows = history_window(tracked, size).withColumn("_n", F.size("history"))

    def mean(held: Column) -> Column:
        weighted = F.transform(held, lambda v, i: F.transform(v, lambda x: x.cast("double") * (0.5 + 0.5 * i / F.col("_n"))))
        return _once(weighted, lambda w: F.aggregate(F.slice(w, 2, size), F.element_at(w, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)))

    total = mean(F.concat("history", F.array("embedding")))
    return rows.withColumn("mean", _once(total, vectors.vec_normalize)).drop("history", "_n")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def track_step_similarity(tracked: DataFrame) -> DataFrame:
    """Mean and population variance of the positive cosines of each track's consecutive vectors."""
    step = vectors.cosine(F.col("embedding"), F.lag("embedding").over(_track()))
    rows = tracked.withColumn("_s", step).where("_s > 0")
    return rows.groupBy("video_id", "track_id").agg(F.round(F.avg("_s"), 6).alias("mean"), F.round(F.var_pop("_s"), 6).alias("variance"))


def track_origin_trend(tracked: DataFrame) -> DataFrame:
    """Adds origin, the cosine to the track's first vector, and trend, origin less the mean of the positive ones among the three rows before."""
    first = F.first("embedding").over(_track().rowsBetween(Window.unboundedPreceding, 0))
    rows = tracked.withColumn("origin", vectors.cosine(F.col("embedding"), first))
    before = F.avg(F.when(F.col("origin") > 0, F.col("origin"))).over(_track().rowsBetween(-3, -1))
    return rows.withColumn("trend", F.col("origin") - before)
