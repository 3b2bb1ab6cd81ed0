"""Detections against references: similarity pairs and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.functions import vectors

BROADCAST_ROWS = 20_000


SALTS = 32


def similarity_join(detections: DataFrame, references: DataFrame, threshold: float, n_references: int | None = None) -> DataFrame:
    """Pairs of detections and references of one video with a cosine of at least threshold.

    Vectors are made unit length once on either side, so a pair costs one dot product. At most
    BROADCAST_ROWS references are broadcast, and detections aren't shuffled; n_references is
    their number where the caller knows it, else they are counted up to that bound. More
    references are shuffled with the detections, a video's frames spread over SALTS keys.
    """
    unit = lambda df: df.withColumn("_unit", vectors.vec_normalize(F.col("embedding"))).where("_unit is not null")
    a = unit(detections).select("video_id", "frame_idx", "position", "det_seq", F.col("_unit").alias("_a"))
    b = unit(references).select("video_id", F.col("position").alias("ref"), F.col("_unit").alias("_b"))
    n = references.select("video_id").limit(BROADCAST_ROWS + 1).count() if n_references is None else n_references
    if n <= BROADCAST_ROWS:
        rows = a.join(F.broadcast(b), "video_id")
    else:
        a = a.withColumn("_salt", F.pmod("frame_idx", F.lit(SALTS)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = a.join(b, ["video_id", "_salt"]).drop("_salt")
    rows = rows.withColumn("similarity", vectors.dot(F.col("_a"), F.col("_b")))
    return rows.where(F.col("similarity") >= threshold).drop("_a", "_b")


def greedy_assign(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of each frame: best similarity first, ties by position and reference.

    The pairs of a frame are few: its detections times the references of its video.
    """
    item = F.struct((-F.col("similarity")).alias("s"), "position", "ref", "det_seq")
    ranked = F.array_sort(F.collect_list(item))
    start = F.struct(F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("r"), F.array().cast("array<struct<s:double,position:int,ref:int,det_seq:bigint>>").alias("kept"))

    def take(acc, x):
        free = ~F.array_contains(acc["p"], x["position"]) & ~F.array_contains(acc["r"], x["ref"])
        added = F.struct(F.concat(acc["p"], F.array(x["position"])).alias("p"), F.concat(acc["r"], F.array(x["ref"])).alias("r"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(free, added).otherwise(acc)

    chosen = pairs.groupBy("video_id", "frame_idx").agg(F.aggregate(ranked, start, take, lambda acc: acc["kept"]).alias("kept"))
    rows = chosen.select("video_id", "frame_idx", F.explode("kept").alias("k"))
    return rows.select("video_id", "frame_idx", "k.position", "k.det_seq", "k.ref", (-F.col("k.s")).alias("similarity"))


def best_match(pairs: DataFrame) -> DataFrame:
    """The best reference of each detection, the least of equals."""
    best = pairs.groupBy("video_id", "frame_idx", "position", "det_seq").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "ref")).alias("m"))
    return best.select("video_id", "frame_idx", "position", "det_seq", F.col("m.ref").alias("ref"), (-F.col("m.s")).alias("similarity"))


def reset_match(detections: DataFrame, references: DataFrame, threshold: float, interval: int) -> DataFrame:
    """One-to-one matches at 0.6 of the threshold on frames over 0 that interval divides."""
    due = detections.where((F.col("frame_idx") > 0) & (F.pmod("frame_idx", F.lit(interval)) == 0))
    return greedy_assign(similarity_join(due, references, 0.6 * threshold))


def post_reset_match(detections: DataFrame, references: DataFrame, threshold: float) -> DataFrame:
    """For each reference and frame the leftmost detection over the threshold."""
    pairs = similarity_join(detections, references, threshold).where(F.col("similarity") > threshold)
    first = pairs.groupBy("video_id", "frame_idx", "ref").agg(F.min(F.struct("position", "det_seq", "similarity")).alias("m"))
    return first.select("video_id", "frame_idx", "ref", "m.position", "m.det_seq", "m.similarity")


def lost_recover(detections: DataFrame, lost: DataFrame, threshold: float, max_age: int) -> DataFrame:
    """Each detection with the best track lost at most 8 * max_age frames before.

    lost: video_id, track_id, lost_frame, is_skip, embedding and history (arrays of vectors,
    newest last). A track's similarity is the best over its vector and the last 2 of its
    history (3 for skips), over 0.7 of the threshold (0.75). Frames go in buckets of the whole
    time to live, so the look-back is an equi-join with two buckets.
    """
    ttl = max(8 * max_age, 1)
    a = detections.withColumn("_bucket", F.explode(F.array(F.floor(F.col("frame_idx") / ttl), F.floor(F.col("frame_idx") / ttl) - 1))).alias("d")
    b = lost.withColumn("_bucket", F.floor(F.col("lost_frame") / ttl)).alias("l")
    near = (F.col("d.video_id") == F.col("l.video_id")) & (F.col("d._bucket") == F.col("l._bucket")) & (F.col("d.frame_idx") >= F.col("l.lost_frame")) & (F.col("d.frame_idx") <= F.col("l.lost_frame") + ttl)
    recent = F.expr("slice(l.history, greatest(1, size(l.history) - if(l.is_skip, 3, 2) + 1), 3)")
    known = F.concat(F.array("l.embedding"), recent)
    score = F.array_max(F.transform(known, lambda v: vectors.cosine(v, F.col("d.embedding"))))
    rows = a.join(b, near).select("d.video_id", "d.frame_idx", "d.det_seq", "l.track_id", "l.is_skip", score.alias("similarity"))
    rows = rows.where(F.col("similarity") > F.when(F.col("is_skip"), 0.75).otherwise(0.7) * threshold)
    best = rows.groupBy("video_id", "frame_idx", "det_seq").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "track_id")).alias("m"))
    return best.select("video_id", "frame_idx", "det_seq", F.col("m.track_id").alias("track_id"), (-F.col("m.s")).alias("similarity"))


def retain_unmatched(matched: DataFrame, tracks: DataFrame, max_age: int) -> DataFrame:
    """At each frame the tracks matched there, and those known but not matched that aren't older than
    max_age (-1: any). Both tables: video_id, frame_idx, track_id, last_seen."""
    young = tracks if max_age == -1 else tracks.where(F.col("frame_idx") - F.col("last_seen") <= max_age)
    keys = ["video_id", "frame_idx", "track_id"]
    old = young.join(matched.select(keys), keys, "left_anti")
    return matched.withColumn("matched", F.lit(True)).unionByName(old.withColumn("matched", F.lit(False)))


