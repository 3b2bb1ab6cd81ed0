"""Detections' boxes: geometry, tiers, detector passes and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_geometry(detections: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Adds w, h, cx, cy, geo_size (root of the area), mean_size and rel_area of the image."""
    out = detections.withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1"))
    out = out.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    area = F.abs(F.col("w") * F.col("h"))
    return out.withColumn("geo_size", F.sqrt(area)).withColumn("mean_size", (F.col("w") + F.col("h")) / 2).withColumn("rel_area", area / (width * height))


def box_tier(mean_size: Column, large: bool = False) -> Column:
    """Tier by mean size: 128, 256 or 512, or for the large family 256, 512 or 768."""
    low, mid, high, step = (256, 512, 768, 200) if large else (128, 256, 512, 150)
    return F.when(mean_size >= 350, high).when(mean_size >= step, mid).otherwise(low)


def nearest(value: Column, options: list[int]) -> Column:
    """The option nearest to value, the first of equals."""
    ranked = F.array(*[F.struct(F.abs(value - o).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    return F.array_min(ranked)["o"]


def box_tier_relative(geo_size: Column, rel_area: Column, options: list[int], large: bool = False) -> Column:
    """Tier by geometric size, the top one for a large share of the image only, then the nearest option."""
    if large:
        tier = F.when(geo_size < 240, 256).when(geo_size < 400, 512).otherwise(F.when(rel_area > 0.15, 768).otherwise(512))
    else:
        tier = F.when(geo_size < 120, 128).when(geo_size < 320, 256).when(geo_size < 480, F.when(rel_area > 0.1, 512).otherwise(256)).otherwise(512)
    return nearest(tier, options)


def box_upscale_needed(geo_size: Column, base: int) -> Column:
    return geo_size > 1.5 * base


def tier_validate(tier: Column, mean_size: Column, options: list[int], base: int) -> Column:
    """(tier, tiles): a tier that isn't an option becomes the last for sizes over 300, else the first; tiles a side."""
    held = F.when(tier.isin(options), tier).otherwise(F.when(mean_size > 300, options[-1]).otherwise(options[0]))
    return F.struct(held.cast("int").alias("tier"), F.floor(held / base).cast("int").alias("tiles"))


def box_rescale(detections: DataFrame, scale: Column) -> DataFrame:
    """Boxes, and key points if there are any, divided by the scale of their pass."""
    out = detections
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(c, F.col(c) / scale)
    if "kps" in detections.columns:
        out = out.withColumn("kps", F.transform("kps", lambda p: F.transform(p, lambda x: x / scale)))
    return out


def pass_plan(videos: DataFrame) -> DataFrame:
    """The detector's passes over images of width x height: pass_no, scale and even pass sizes."""
    side = F.greatest("width", "height")
    scales = F.flatten(
        F.array(
            F.array(F.lit(1.0)),
            F.when(side > 1080, F.array(F.lit(0.7), F.lit(0.5), F.lit(0.35))).otherwise(F.array().cast("array<double>")),
            F.when(side < 480, F.array(F.lit(640.0) / side)).otherwise(F.array().cast("array<double>")),
        )
    )
    rows = videos.select(*videos.columns, F.posexplode(scales).alias("pass_no", "scale"))
    even = lambda c: F.when(F.col("pass_no") == 0, F.col(c)).otherwise(F.floor((F.col(c) * F.col("scale")).cast("int") / 2).cast("int") * 2)
    return rows.withColumn("pass_width", even("width")).withColumn("pass_height", even("height"))


def first_nonempty_pass(detections: DataFrame, pass_col: str = "pass_no") -> DataFrame:
    """Detections of the first pass of each frame that found any."""
    first = F.min(pass_col).over(Window.partitionBy("video_id", "frame_idx"))
    return detections.withColumn("_first", first).where(F.col(pass_col) == F.col("_first")).drop("_first")


def detect_with_fallback(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """Detections (video_id, frame_idx, pass_no, boxes and maybe kps at the pass's size) of the first pass of each
    frame that found any, at the size of the image (videos: video_id, width, height), with the pass's scale.

    Passes that the video's plan hasn't, and videos without a size, give nothing. The plan has at most four rows a video."""
    plan = pass_plan(videos.select("video_id", "width", "height")).select("video_id", "pass_no", "scale")
    rows = first_nonempty_pass(detections.join(plan, ["video_id", "pass_no"]))
    return box_rescale(rows, F.col("scale"))


# The order of rotations tried.
ROTATIONS = [0, -30, 30]


def rotation_pass(detections: DataFrame, angle_col: str = "angle") -> DataFrame:
    """Detections of the first rotation of each frame that found any; coordinates stay as they are."""
    order = F.array_position(F.array(*map(F.lit, ROTATIONS)), F.col(angle_col))
    return first_nonempty_pass(detections.withColumn("_order", order).where("_order > 0"), "_order").drop("_order")


def det_pick(detections: DataFrame, index: int, from_right: bool = False) -> DataFrame:
    """The index-th detection of each frame from the left or the right; from the right ties turn round too."""
    order = (F.desc("x1"), F.desc("det_seq")) if from_right else (F.asc("x1"), F.asc("det_seq"))
    rank = F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy(*order))
    return detections.withColumn("_n", rank).where(F.col("_n") == index + 1).drop("_n")


def det_pick_side(detections: DataFrame, width: int = 1920, from_right: bool = False) -> DataFrame:
    """The first detection, in detector order, with its centre on the wanted side, else the very first."""
    cx = (F.col("x1") + F.col("x2")) / 2
    off = ~(cx > width / 2) if from_right else ~(cx < width / 2)
    rank = F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy(off, "det_seq"))
    return detections.withColumn("_n", rank).where("_n = 1").drop("_n")


def center_distance(a: str, b: str) -> Column:
    """Distance of the centres of boxes a and b; a's corners are cut to whole numbers."""
    mid = lambda t, p, q: (F.col(f"{t}.{p}") + F.col(f"{t}.{q}")) / 2
    cut = lambda p, q: (F.col(f"{a}.{p}").cast("int") + F.col(f"{a}.{q}").cast("int")) / 2
    return F.hypot(cut("x1", "x2") - mid(b, "x1", "x2"), cut("y1", "y2") - mid(b, "y1", "y2"))


def nearest_box_match(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each detection of first the nearest of second in its frame, first of equals, nearer than 1e9."""
    a, b = first.alias("a"), second.alias("b")
    rows = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.frame_idx") == F.col("b.frame_idx")))
    rows = rows.select("a.video_id", "a.frame_idx", F.col("a.det_seq").alias("det_seq"), F.col("b.det_seq").alias("other"), center_distance("a", "b").alias("distance")).where("distance < 1e9")
    best = rows.groupBy("video_id", "frame_idx", "det_seq").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select("video_id", "frame_idx", "det_seq", F.col("m.other").alias("other"), F.round("m.distance", 6).alias("distance"))


def frames_without_detections(frames: DataFrame, detections: DataFrame) -> DataFrame:
    return frames.join(detections.select("video_id", "frame_idx"), ["video_id", "frame_idx"], "left_anti")
