"""Queries over scalar, vector, box and catalog functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.functions import scalars, vectors
from vidtables.jobs.registry import Registry
from vidtables.operators import boxes, requests
from vidtables.sources import catalog
from vidtables.sources.fixtures import TIME

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col

RATE = """, n AS (SELECT *, string_split(avg_frame_rate, '/') AS p FROM videos), q AS (SELECT *, CASE WHEN len(p) = 1 THEN TRY_CAST(p[1] AS DOUBLE) WHEN len(p) = 2 AND TRY_CAST(p[2] AS DOUBLE) <> 0 THEN TRY_CAST(p[1] AS DOUBLE) / TRY_CAST(p[2] AS DOUBLE) END AS x FROM n),
rates AS (SELECT video_id, CASE WHEN x > 0 AND x <= 240 THEN x ELSE 30e0 END AS fps FROM q)"""
SIZE = ", m AS (SELECT video_id, regexp_extract(resolution, '^([0-9]+)x([0-9]+)$', ['w', 'h']) AS r FROM videos)"
R.add("parse_time", "requests", lambda r: r.select("request_id", "start_time", scalars.parse_time(c("start_time")).alias("seconds")), f"SELECT request_id, start_time, {TIME} AS seconds FROM requests")
R.add(
    "time_to_frame",
    "requests typed",
    lambda r, v: r.join(v, "video_id").select("request_id", scalars.time_to_frame(scalars.parse_time(c("start_time")), c("fps")).alias("frame")),
    f"SELECT request_id, CAST(trunc({TIME} * fps) AS INT) AS frame FROM requests JOIN typed USING (video_id)",
)
R.add(
    "frame_to_time",
    "typed",
    lambda v: v.select("video_id", scalars.frame_to_time(c("total_frames") * 40, F.lit(25.0)).alias("time")),
    """, t AS (SELECT video_id, CAST(total_frames * 40 / 25.0 AS DOUBLE) AS s FROM typed)
SELECT video_id, CASE WHEN s >= 3600 THEN lpad(CAST(CAST(floor(s / 3600) AS INT) AS VARCHAR), 2, '0') || ':' ELSE '' END || printf('%02d:%06.3f', CAST(floor((s % 3600) / 60) AS INT), s % 60) AS time FROM t""",
)
R.add(
    "format_duration",
    "frame_log",
    lambda f: f.select("frame_idx", scalars.format_duration(c("elapsed_ms") * 10 + c("frame_idx") % 5000).alias("duration")),
    """, t AS (SELECT frame_idx, CAST(floor(elapsed_ms * 10 + frame_idx % 5000) AS BIGINT) AS s FROM frame_log)
SELECT frame_idx, CASE WHEN s >= 3600 THEN printf('%02d:', s // 3600) ELSE '' END || printf('%02d:%02d', (s % 3600) // 60, s % 60) AS duration FROM t""",
)
R.add("fps_parse", "videos", lambda v: v.select("video_id", F.round(scalars.fps_parse(c("avg_frame_rate")), 6).alias("fps")), f"{RATE} SELECT video_id, round(fps, 6) AS fps FROM rates")
R.add(
    "fps_rational",
    "videos",
    lambda v: scalars.fps_rational(v.select("video_id", F.element_at(F.array(*map(F.lit, (12.5, 30000 / 1001, 25.0, 24000 / 1001, 30.0, 7.5, 48.0))), (c("video_id") % 7 + 1).cast("int")).alias("fps"))).select("video_id", "fps_rational"),
    "SELECT video_id, CASE video_id % 7 WHEN 0 THEN '25/2' WHEN 1 THEN '30000/1001' WHEN 2 THEN '25/1' WHEN 3 THEN '24000/1001' WHEN 4 THEN '30/1' WHEN 5 THEN '15/2' ELSE '48/1' END AS fps_rational FROM videos",
)
R.add(
    "resolution_parse",
    "videos",
    lambda v: v.select("video_id", scalars.resolution_parse(c("resolution")).alias("r")).select("video_id", "r.width", "r.height"),
    f"{SIZE} SELECT video_id, coalesce(TRY_CAST(r.w AS INT), 256) AS width, coalesce(TRY_CAST(r.h AS INT), 256) AS height FROM m",
)
R.add(
    "resolution_even",
    "typed",
    lambda v: v.select("video_id", scalars.resolution_even(c("total_frames") % 700, c("video_id") % 500).alias("r")).select("video_id", "r.width", "r.height"),
    """, t AS (SELECT video_id, CAST(total_frames % 700 AS BIGINT) AS w, CAST(video_id % 500 AS BIGINT) AS h FROM typed)
SELECT video_id, CAST(CASE WHEN w > 0 AND h > 0 THEN CASE WHEN w % 2 = 0 THEN w WHEN w % 4 = 1 THEN w - 1 ELSE w + 1 END ELSE 0 END AS INT) AS width,
 CAST(CASE WHEN w > 0 AND h > 0 THEN CASE WHEN h % 2 = 0 THEN h WHEN h % 4 = 1 THEN h - 1 ELSE h + 1 END ELSE 0 END AS INT) AS height FROM t""",
)
DD = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def odd():
    """Vectors of which some are null or have no length."""
    return F.when(c("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).when(c("vec_id") % 11 == 0, F.lit(None)).otherwise(c("embedding"))


ODD_SQL = "SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings"
R.add("vec_valid", "embeddings", lambda e: e.select("vec_id", vectors.vec_valid(odd()).isNotNull().alias("valid")), f"SELECT vec_id, v IS NOT NULL AS valid FROM ({ODD_SQL})")
R.add(
    "vec_normalize",
    "embeddings",
    lambda e: e.select("vec_id", F.posexplode_outer(vectors.vec_normalize(F.transform(odd(), lambda x: x * 3))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")),
    f"""WITH o AS ({ODD_SQL}), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM o)
SELECT vec_id, CAST(i - 1 AS INT) AS i, round(v[i] / n, 6) AS x FROM (SELECT vec_id, v, n, unnest(range(1, len(v) + 1)) AS i FROM n WHERE v IS NOT NULL) UNION ALL SELECT vec_id, NULL, NULL FROM n WHERE v IS NULL""",
)
R.add(
    "cosine",
    "embeddings",
    lambda e: e.select("vec_id", "label", odd().alias("a")).join(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b")), "label").select("vec_id", F.round(vectors.cosine(c("a"), c("b")), 6).alias("similarity")),
    f"""WITH o AS ({ODD_SQL}), b AS (SELECT label, list_transform(arg_min(embedding, vec_id), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings GROUP BY label)
SELECT vec_id, coalesce(round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * b[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 6), -1e0) AS similarity FROM o JOIN b USING (label)""",
)
R.add(
    "decision",
    "frame_log",
    lambda f: f.select("frame_idx", scalars.decision(F.pmod("elapsed_ms", F.lit(0.3)), F.lit(0.16), (c("frame_idx") % 4).cast("int")).alias("decision")),
    """, t AS (SELECT frame_idx, elapsed_ms % 0.3e0 AS s, frame_idx % 4 AS k FROM frame_log)
SELECT frame_idx, CASE WHEN s > 0.16e0 + 0.03e0 OR (s > 0.16e0 AND k >= 1) OR (s > 0.16e0 - 0.03e0 AND k >= 2) THEN 'act' WHEN s > 0.16e0 - 0.03e0 THEN 'hold' ELSE 'none' END AS decision FROM t""",
)


def _adaptive(f):
    k = c("frame_idx")
    features = [F.lit(0.16), (k % 13), (k % 30) / 1000.0, (k % 40) / 100.0, (k % 50) / 100.0, (k % 9) / 100.0, (k % 8)]
    need = scalars.adaptive_threshold(*features)
    return f.select("frame_idx", F.round(need, 6).alias("threshold"), scalars.accepts((k % 37) / 100.0, need, k % 4).alias("accepted"))


R.add(
    "adaptive_threshold",
    "frame_log",
    _adaptive,
    """, a AS (SELECT frame_idx AS k, 0.18e0 AS base, frame_idx % 13 AS h, (frame_idx % 30) / 1000e0 AS v, (frame_idx % 40) / 100e0 AS m, (frame_idx % 50) / 100e0 AS o, (frame_idx % 9) / 100e0 AS tr, frame_idx % 8 AS tol FROM frame_log),
b AS (SELECT *, CASE WHEN h < 5 THEN base WHEN v > 0.02e0 THEN base * 0.85e0 WHEN v > 0.01e0 THEN base * 0.90e0 WHEN m < base + 0.03e0 THEN base * 0.93e0 ELSE base END AS s FROM a),
d AS (SELECT *, CASE WHEN h >= 3 AND o > 0 THEN (CASE WHEN o > s + 0.1e0 THEN s * 0.8e0 WHEN o > s + 0.05e0 THEN s * 0.85e0 ELSE s END) * (CASE WHEN tr > 0.03e0 THEN 0.85e0 ELSE 1e0 END) ELSE s END AS n FROM b),
e AS (SELECT *, greatest(CASE WHEN tol >= 2 THEN n * (1e0 - least(0.15e0, tol * 0.03e0)) ELSE n END, 0.15e0) AS t, (k % 37) / 100e0 AS x, k % 4 AS st FROM d)
SELECT k AS frame_idx, round(t, 6) AS threshold, x >= 0 AND (x >= t + 0.03e0 OR (x >= t AND st >= 1) OR (x >= t - 0.03e0 AND st >= 2) OR (x >= t - 0.06e0 AND st >= 3)) AS accepted FROM e""",
)

PATHS = "SELECT part.*, CASE p_partkey % 5 WHEN 0 THEN '/v/' || p_partkey || '.mp4' WHEN 1 THEN '/v/' || p_partkey || '.PNG' WHEN 2 THEN '/i.d/' || p_partkey || '.webp' WHEN 3 THEN '/v/clip' || p_partkey || '.tar.mkv' ELSE '/v.x/noext' || p_partkey END AS path FROM part"


def _paths(p):
    k, s = c("p_partkey") % 5, c("p_partkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/v/"), s, F.lit(".mp4"))).when(k == 1, F.concat(F.lit("/v/"), s, F.lit(".PNG"))).when(k == 2, F.concat(F.lit("/i.d/"), s, F.lit(".webp"))).when(k == 3, F.concat(F.lit("/v/clip"), s, F.lit(".tar.mkv"))).otherwise(F.concat(F.lit("/v.x/noext"), s))
    return p.select("p_partkey", path.alias("path"))


R.add(
    "media_catalog",
    "part",
    lambda p: catalog.media_catalog(_paths(p)),
    f"""WITH p AS ({PATHS}), e AS (SELECT p_partkey, path, regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1) AS ext FROM p)
SELECT p_partkey, path, CASE WHEN lower(ext) IN ('.png', '.jpg', '.jpeg', '.bmp', '.webp') THEN 'image' ELSE 'video' END AS kind, substr(path, 1, length(path) - length(ext)) || '-swapped' || ext AS output FROM e""",
)
R.add(
    "probe_catalog",
    "videos",
    lambda v: catalog.probe_catalog(v).select("video_id", "total_frames", "count_method"),
    "SELECT video_id, coalesce(TRY_CAST(nb_read_packets AS INT), TRY_CAST(nb_frames AS INT), decoder_frames, 0) AS total_frames, CASE WHEN nb_read_packets IS NOT NULL THEN 'packets' WHEN TRY_CAST(nb_frames AS INT) IS NOT NULL THEN 'nb_frames' WHEN decoder_frames IS NOT NULL THEN 'decoder' ELSE 'none' END AS count_method FROM videos",
)
R.add("probe_resolution", "videos", lambda v: catalog.probe_resolution(v).select("video_id", "width", "height"), f"{SIZE} SELECT video_id, coalesce(TRY_CAST(r.w AS INT), 1920) AS width, coalesce(TRY_CAST(r.h AS INT), 1080) AS height FROM m")
R.add(
    "detections_scan",
    "detections",
    lambda d: catalog.detections_scan(d.withColumn("embedding", F.when(c("det_seq") % 7 == 0, F.lit(None)).otherwise(c("embedding")))).groupBy("video_id", "valid").agg(F.count("*").alias("n")),
    "SELECT video_id, det_seq % 7 <> 0 AS valid, count(*) AS n FROM detections GROUP BY 1, 2",
)
R.add(
    "slots_scan",
    "requests embeddings",
    lambda r, e: catalog.slots_scan(
        r.select(c("request_id").alias("video_id"), F.concat_ws(",", (c("request_id") % 300).cast("string"), F.lit("Skip"), ((c("request_id") + 1) % 300).cast("string")).alias("sources")), e.select(c("vec_id").cast("string").alias("name"), "embedding")
    ).select("video_id", "position", "is_skip", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x")),
    """, s AS (SELECT request_id AS video_id, unnest([0, 1, 2]) AS position FROM requests),
n AS (SELECT video_id, CAST(position AS INT) AS position, CASE position WHEN 0 THEN video_id % 300 WHEN 2 THEN (video_id + 1) % 300 END AS k FROM s)
SELECT video_id, position, position = 1 AS is_skip, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM n LEFT JOIN embeddings ON vec_id = k""",
)
R.add(
    "batch_fanout",
    "typed",
    lambda v: catalog.batch_fanout(v, 20).select("video_id", "part", "start_frame", "end_frame"),
    """, s AS (SELECT video_id, total_frames, CAST(trunc(fps * 20) AS INT) AS step FROM typed WHERE total_frames > 0),
p AS (SELECT video_id, total_frames, step, CAST(unnest(range(0, (total_frames - 1) // step + 1)) AS INT) AS part FROM s)
SELECT video_id, part, part * step AS start_frame, least((part + 1) * step, total_frames) AS end_frame FROM p""",
)

R.add(
    "box_geometry",
    "detections",
    lambda d: boxes.box_geometry(d).select("det_seq", "w", "h", "cx", "cy", F.round("geo_size", 6).alias("geo_size"), "mean_size", F.round("rel_area", 9).alias("rel_area")),
    "SELECT det_seq, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round(sqrt(abs((x2 - x1) * (y2 - y1))), 6) AS geo_size, (x2 - x1 + y2 - y1) / 2 AS mean_size, round(abs((x2 - x1) * (y2 - y1)) / (1920 * 1080), 9) AS rel_area FROM detections",
)
MEAN = "(x2 - x1 + y2 - y1) / 2"
R.add(
    "box_tier",
    "detections",
    lambda d: boxes.box_geometry(d).select("det_seq", boxes.box_tier(c("mean_size")).alias("tier"), boxes.box_tier(c("mean_size"), True).alias("large_tier")),
    f"SELECT det_seq, CASE WHEN {MEAN} < 150 THEN 128 WHEN {MEAN} < 350 THEN 256 ELSE 512 END AS tier, CASE WHEN {MEAN} < 200 THEN 256 WHEN {MEAN} < 350 THEN 512 ELSE 768 END AS large_tier FROM detections",
)
GEO = ", g AS (SELECT *, sqrt(abs((x2 - x1) * (y2 - y1))) AS s, abs((x2 - x1) * (y2 - y1)) / (1920e0 * 1080) AS r FROM detections)"
R.add(
    "box_tier_relative",
    "detections",
    lambda d: boxes.box_geometry(d).select("det_seq", boxes.box_tier_relative(c("geo_size"), c("rel_area"), [128, 384, 512]).alias("tier"), boxes.box_tier_relative(c("geo_size"), c("rel_area"), [256, 512, 768], True).alias("large_tier")),
    f"""{GEO} SELECT det_seq, CASE WHEN s < 120 THEN 128 WHEN s < 320 THEN 128 WHEN s < 480 AND r <= 0.1e0 THEN 128 ELSE 512 END AS tier,
 CASE WHEN s < 240 THEN 256 WHEN s < 400 THEN 512 WHEN r > 0.15e0 THEN 768 ELSE 512 END AS large_tier FROM g""",
)
R.add("box_upscale_needed", "detections", lambda d: boxes.box_geometry(d).select("det_seq", boxes.box_upscale_needed(c("geo_size"), 128).alias("needed")), f"{GEO} SELECT det_seq, s > 192 AS needed FROM g")
R.add(
    "tier_validate",
    "detections",
    lambda d: boxes.box_geometry(d).select("det_seq", boxes.tier_validate(boxes.box_tier(c("mean_size")), c("mean_size"), [128, 512, 1024], 128).alias("t")).select("det_seq", "t.tier", "t.tiles"),
    f"""SELECT det_seq, CASE WHEN {MEAN} < 150 THEN 128 WHEN {MEAN} >= 350 THEN 512 WHEN {MEAN} > 300 THEN 1024 ELSE 128 END AS tier,
 CASE WHEN {MEAN} < 150 THEN 1 WHEN {MEAN} >= 350 THEN 4 WHEN {MEAN} > 300 THEN 8 ELSE 1 END AS tiles FROM detections""",
)
R.add(
    "box_rescale",
    "detections",
    lambda d: boxes.box_rescale(d, F.element_at(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.5), F.lit(0.35)), c("pass_no") + 1)).select("det_seq", *[F.round(x, 6).alias(x) for x in ("x1", "y1", "x2", "y2")]),
    ", s AS (SELECT *, CASE pass_no WHEN 0 THEN 1e0 WHEN 1 THEN 0.7e0 WHEN 2 THEN 0.5e0 ELSE 0.35e0 END AS k FROM detections) SELECT det_seq, round(x1 / k, 6) AS x1, round(y1 / k, 6) AS y1, round(x2 / k, 6) AS x2, round(y2 / k, 6) AS y2 FROM s",
)
SHIFTED = ", moved AS (SELECT video_id, frame_idx, det_seq, x1 + (det_seq % 4) * 0.25e0 AS x1, x2 + (det_seq % 3) * 0.375e0 AS x2, y1 + (det_seq % 5) * 0.125e0 AS y1, y2 + 0.75e0 AS y2 FROM detections)"


def shifted(d):
    """Detections with corners between whole numbers."""
    return d.select("video_id", "frame_idx", "det_seq", (c("x1") + (c("det_seq") % 4) * 0.25).alias("x1"), (c("x2") + (c("det_seq") % 3) * 0.375).alias("x2"), (c("y1") + (c("det_seq") % 5) * 0.125).alias("y1"), (c("y2") + 0.75).alias("y2"))


R.add(
    "center_distance",
    "detections",
    lambda d: shifted(d).alias("a").join(shifted(d).alias("b"), (c("a.video_id") == c("b.video_id")) & (c("a.frame_idx") == c("b.frame_idx")) & (c("a.det_seq") < c("b.det_seq"))).select(c("a.det_seq").alias("det_seq"), c("b.det_seq").alias("other"), F.round(boxes.center_distance("a", "b"), 6).alias("distance")),
    f"{SHIFTED} SELECT a.det_seq, b.det_seq AS other, round(sqrt(pow((trunc(a.x1) + trunc(a.x2) - b.x1 - b.x2) / 2, 2) + pow((trunc(a.y1) + trunc(a.y2) - b.y1 - b.y2) / 2, 2)), 6) AS distance FROM moved a JOIN moved b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_seq < b.det_seq",
)
R.add(
    "nearest_box_match",
    "detections",
    lambda d: boxes.nearest_box_match(shifted(d), shifted(d).withColumn("x1", c("x1") + 31.5)),
    f"""{SHIFTED}, p AS (SELECT a.video_id, a.frame_idx, a.det_seq, b.det_seq AS other, sqrt(pow((trunc(a.x1) + trunc(a.x2) - b.x1 - 31.5e0 - b.x2) / 2, 2) + pow((trunc(a.y1) + trunc(a.y2) - b.y1 - b.y2) / 2, 2)) AS d
 FROM moved a JOIN moved b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx)
SELECT video_id, frame_idx, det_seq, other, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, det_seq ORDER BY d, other) AS n FROM p) WHERE n = 1""",
)
R.add(
    "det_position",
    "detections",
    lambda d: requests.det_position(d).select("video_id", "frame_idx", "det_seq", "position"),
    "SELECT a.video_id, a.frame_idx, a.det_seq, CAST((SELECT count(*) FROM detections b WHERE b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND (b.x1 < a.x1 OR (b.x1 = a.x1 AND b.det_seq < a.det_seq))) AS INT) AS position FROM detections a",
)
R.add(
    "det_pick",
    "detections",
    lambda d: boxes.det_pick(d, 1, True).select("video_id", "frame_idx", "det_seq"),
    "SELECT video_id, frame_idx, det_seq FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY x1 DESC, det_seq DESC) AS n FROM detections) WHERE n = 2",
)
R.add(
    "det_pick_side",
    "detections",
    lambda d: boxes.det_pick_side(d, from_right=True).select("video_id", "frame_idx", "det_seq"),
    "SELECT video_id, frame_idx, coalesce(min(CASE WHEN (x1 + x2) / 2 > 960 THEN det_seq END), min(det_seq)) AS det_seq FROM detections GROUP BY 1, 2",
)
R.add(
    "first_nonempty_pass",
    "detections",
    lambda d: boxes.first_nonempty_pass(d).select("video_id", "frame_idx", "det_seq", "pass_no"),
    "SELECT d.video_id, d.frame_idx, det_seq, pass_no FROM detections d JOIN (SELECT video_id, frame_idx, min(pass_no) AS m FROM detections GROUP BY 1, 2) f ON d.video_id = f.video_id AND d.frame_idx = f.frame_idx AND pass_no = m",
)
R.add(
    "rotation_pass",
    "detections",
    lambda d: boxes.rotation_pass(d.withColumn("angle", F.element_at(F.array(F.lit(30), F.lit(-30), F.lit(0), F.lit(90)), c("pass_no") + 1))).select("video_id", "frame_idx", "det_seq", "angle"),
    """, r AS (SELECT *, CASE pass_no WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS o, CASE pass_no WHEN 0 THEN 30 WHEN 1 THEN -30 WHEN 2 THEN 0 END AS angle FROM detections WHERE pass_no < 3)
SELECT video_id, frame_idx, det_seq, angle FROM (SELECT *, min(o) OVER (PARTITION BY video_id, frame_idx) AS m FROM r) WHERE o = m""",
)
R.add(
    "pass_plan",
    "typed",
    lambda v: boxes.pass_plan(v.withColumn("width", F.when(c("video_id") % 5 == 0, 400).otherwise(c("width")))).select("video_id", "pass_no", F.round("scale", 6).alias("scale"), "pass_width", "pass_height"),
    """, v AS (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 400 ELSE width END AS w, height AS h FROM typed),
s AS (SELECT *, greatest(w, h) AS side FROM v),
p AS (SELECT *, unnest(CASE WHEN side > 1080 THEN [0, 1, 2, 3] WHEN side < 480 THEN [0, 1] ELSE [0] END) AS pass_no FROM s),
q AS (SELECT *, CASE WHEN pass_no = 0 THEN 1e0 WHEN side < 480 THEN 640e0 / side WHEN pass_no = 1 THEN 0.7e0 WHEN pass_no = 2 THEN 0.5e0 ELSE 0.35e0 END AS k FROM p)
SELECT video_id, pass_no, round(k, 6) AS scale, CAST(CASE WHEN pass_no = 0 THEN w ELSE floor(trunc(w * k) / 2) * 2 END AS INT) AS pass_width, CAST(CASE WHEN pass_no = 0 THEN h ELSE floor(trunc(h * k) / 2) * 2 END AS INT) AS pass_height FROM q""",
)
R.add(
    "detect_with_fallback",
    "detections typed",
    lambda d, v: boxes.detect_with_fallback(
        d.withColumn("kps", F.array(F.array(c("x1") + 5, c("y1") + 5), F.array(c("x2") - 5, c("y2") - 7))), v.withColumn("width", F.when(c("video_id") % 5 == 0, 400).otherwise(c("width"))).withColumn("height", F.when(c("video_id") % 5 == 0, 300).otherwise(c("height")))
    ).select("video_id", "frame_idx", "det_seq", "pass_no", *[F.round(x, 6).alias(x) for x in ("scale", "x1", "y1", "x2", "y2")], F.round(c("kps")[0][1], 6).alias("first_y"), F.round(c("kps")[1][0], 6).alias("second_x")),
    """, v AS (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 400 ELSE greatest(width, height) END AS side FROM typed),
p AS (SELECT *, unnest(CASE WHEN side > 1080 THEN [0, 1, 2, 3] WHEN side < 480 THEN [0, 1] ELSE [0] END) AS pass_no FROM v),
q AS (SELECT video_id, pass_no, CASE WHEN pass_no = 0 THEN 1e0 WHEN side < 480 THEN 640e0 / side WHEN pass_no = 1 THEN 0.7e0 WHEN pass_no = 2 THEN 0.5e0 ELSE 0.35e0 END AS k FROM p),
r AS (SELECT d.*, k, min(d.pass_no) OVER (PARTITION BY d.video_id, frame_idx) AS m FROM detections d JOIN q ON q.video_id = d.video_id AND q.pass_no = d.pass_no)
SELECT video_id, frame_idx, det_seq, pass_no, round(k, 6) AS scale, round(x1 / k, 6) AS x1, round(y1 / k, 6) AS y1, round(x2 / k, 6) AS x2, round(y2 / k, 6) AS y2, round((y1 + 5) / k, 6) AS first_y, round((x2 - 5) / k, 6) AS second_x FROM r WHERE pass_no = m""",
)


def frames_in_order(e: DataFrame) -> DataFrame:
    """Events as frames, numbered as they are read in each video."""
    rows = catalog.numbered(e.select((c("user_id") % 10).alias("video_id"), "event_id"), "video_id", "event_id")
    return rows.select("video_id", c("place").cast("int").alias("frame_idx"), "event_id")


def detections_in_order(e: DataFrame) -> DataFrame:
    """Three detections to each of a video's first frames."""
    rows = catalog.numbered(e.select(c("label").alias("video_id"), c("vec_id").alias("det_seq")), "video_id", "det_seq")
    return rows.select("video_id", F.floor(c("place") / 3).cast("int").alias("frame_idx"), "det_seq")


R.add(
    "frames_without_detections",
    "events embeddings",
    lambda e, v: boxes.frames_without_detections(frames_in_order(e), detections_in_order(v)).select("video_id", "frame_idx", "event_id"),
    """WITH frames AS (SELECT user_id % 10 AS video_id, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS INT) AS frame_idx, event_id, ts, event_type, value FROM events),
detections AS (SELECT label AS video_id, CAST(floor(rn / 3) AS INT) AS frame_idx, vec_id AS det_seq,
 CAST((vec_id * 37) % 1600 AS DOUBLE) AS x1, CAST((vec_id * 53) % 800 AS DOUBLE) AS y1,
 CAST((vec_id * 37) % 1600 + 40 + (vec_id * 29) % 500 AS DOUBLE) AS x2,
 CAST((vec_id * 53) % 800 + 40 + (vec_id * 31) % 500 AS DOUBLE) AS y2,
 CAST((vec_id * 17) % 100 AS DOUBLE) / 100 AS det_score, CAST(vec_id % 4 AS INT) AS pass_no, embedding
 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings) t)
SELECT video_id, frame_idx, event_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.video_id = f.video_id AND d.frame_idx = f.frame_idx)""",
)
