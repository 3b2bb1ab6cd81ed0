"""Queries over requests, slots, matching, segments, checks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidtables.jobs import video_job
from vidtables.jobs.registry import Registry
from vidtables.operators import matching, requests, segments, stats, verify
from vidtables.sources import checkpoints
from vidtables.sources.fixtures import SKIP_LIST, TIME
from vidtables.sources.shared import shared_path

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
c = F.col
LENGTH = 120  # frames of a segment in these queries
BLOCK = 500  # stored segments that share a folder

RANGES = f""", r0 AS (SELECT r.*, fps, total_frames, greatest(0, least(coalesce(start_frame, CAST(trunc({TIME} * fps) AS INT), 0), total_frames)) AS range_start FROM requests r JOIN typed t USING (video_id)),
ranges AS (SELECT *, greatest(range_start, least(coalesce(end_frame, total_frames), total_frames)) AS range_end FROM r0)"""


def ranges(r: DataFrame, v: DataFrame) -> DataFrame:
    return requests.range_resolve(r, v)


R.add("range_resolve", "requests typed", lambda r, v: ranges(r, v).select("request_id", "video_id", "range_start", "range_end"), f"{RANGES} SELECT request_id, video_id, range_start, range_end FROM ranges")
R.add(
    "reference_frame",
    "requests typed",
    lambda r, v: requests.reference_frame(ranges(r, v)).select("request_id", "track_frame", "specified"),
    f"{RANGES} SELECT request_id, CASE WHEN reference_frame >= 0 THEN greatest(0, least(reference_frame, total_frames - 1)) ELSE range_start END AS track_frame, reference_frame >= 0 AS specified FROM ranges",
)
R.add(
    "range_filter",
    "frames requests typed",
    lambda f, r, v: requests.range_filter(f, ranges(r, v)).groupBy("request_id", "video_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")),
    f"{RANGES} SELECT request_id, f.video_id, count(*) AS n, min(frame_idx) AS first, max(frame_idx) AS last FROM frames f JOIN ranges r ON f.video_id = r.video_id AND frame_idx >= range_start AND frame_idx < range_end GROUP BY 1, 2",
)
R.add(
    "request_validate",
    "requests",
    lambda r: requests.request_validate(r.withColumn("n_sources", (c("request_id") % 3).cast("int"))).select("request_id", F.array_join("reasons", ",").alias("reasons"), "accepted"),
    """, t AS (SELECT request_id, concat_ws(',', CASE WHEN sim_threshold < 0 OR sim_threshold > 1 THEN 'sim_threshold' END, CASE WHEN max_age < -1 THEN 'max_age' END, CASE WHEN reset_interval < 1 THEN 'reset_interval' END,
 CASE WHEN segment_frames < 10 THEN 'segment_frames' END, CASE WHEN skip_spec IS NOT NULL AND request_id % 3 <> 1 THEN 'sources' END) AS reasons FROM requests) SELECT request_id, reasons, reasons = '' AS accepted FROM t""",
)
SKIPS = ", s AS (SELECT *, " + SKIP_LIST + " AS skips FROM requests)"
R.add("skip_parse", "requests", lambda r: requests.skip_parse(r).select("request_id", F.concat_ws(",", F.transform("skip_positions", lambda x: x.cast("string"))).alias("skips")), f"{SKIPS} SELECT request_id, coalesce(array_to_string(skips, ','), '') AS skips FROM s")
R.add(
    "skip_validate",
    "requests detections",
    lambda r, d: requests.skip_validate(requests.skip_parse(r).where("skip_positions is not null"), d.where("frame_idx = 0").groupBy("video_id").agg(F.count("*").alias("n_detections"))).select(
        "request_id", F.concat_ws(",", F.transform("invalid", lambda x: x.cast("string"))).alias("invalid"), "n_applied"
    ),
    f"""{SKIPS}, n AS (SELECT video_id, count(*) AS n FROM detections WHERE frame_idx = 0 GROUP BY 1)
SELECT request_id, array_to_string(list_filter(skips, lambda p: p >= n), ',') AS invalid, n - len(list_distinct(list_filter(skips, lambda p: p < n))) AS n_applied FROM s JOIN n USING (video_id) WHERE skips IS NOT NULL""",
)
R.add("slot_assign", "positions slots", lambda p, s: requests.slot_assign(p, s), "SELECT video_id, p.position, det_seq, CASE WHEN is_skip THEN 'SKIP' ELSE CAST(p.position AS VARCHAR) END AS source FROM positions p JOIN slots s USING (video_id, position) WHERE frame_idx = 0")
R.add(
    "apply_all_assign",
    "positions requests",
    lambda p, r: requests.apply_all_assign(p, requests.skip_parse(r).where("skip_positions is not null")),
    f"{SKIPS} SELECT request_id, video_id, position, det_seq, CASE WHEN list_contains(skips, position) THEN 'SKIP' ELSE 'SWAP' END AS source FROM positions JOIN s USING (video_id) WHERE frame_idx = 0 AND skips IS NOT NULL",
)
R.add("slot_summary", "slots", requests.slot_summary, "SELECT video_id, count(*) AS n_slots, count(*) FILTER (NOT is_skip) AS n_normal, count(*) FILTER (is_skip) AS n_skip FROM slots GROUP BY 1")
R.add("detections_per_frame", "detections", requests.detections_per_frame, "SELECT video_id, frame_idx, count(*) AS n_detections FROM detections GROUP BY 1, 2")
R.add(
    "count_reconcile",
    "detections kept_slots",
    requests.count_reconcile,
    """, d AS (SELECT video_id, count(*) AS n_detections FROM detections WHERE frame_idx = 0 GROUP BY 1),
s AS (SELECT video_id, count(*) AS n_slots, count(*) FILTER (NOT is_skip) AS n_normal, count(*) FILTER (is_skip) AS n_skip FROM kept_slots GROUP BY 1),
j AS (SELECT coalesce(d.video_id, s.video_id) AS video_id, coalesce(n_detections, 0) AS n_detections, coalesce(n_slots, 0) AS n_slots, coalesce(n_normal, 0) AS n_normal, coalesce(n_skip, 0) AS n_skip FROM d FULL JOIN s ON d.video_id = s.video_id)
SELECT *, CASE WHEN n_detections = 0 THEN 'no_detections' WHEN n_detections <> n_slots THEN 'mismatch' ELSE 'ok' END AS status FROM j""",
)
R.add(
    "reference_candidates",
    "detections slots",
    lambda d, s: requests.reference_candidates(d, s, 5),
    """, f AS (SELECT video_id, frame_idx, count(*) AS n, round(avg(det_score), 6) AS quality FROM detections GROUP BY 1, 2), s AS (SELECT video_id, count(*) AS k FROM slots GROUP BY 1)
SELECT video_id, frame_idx, quality, CAST(rank AS INT) AS rank FROM (SELECT f.*, row_number() OVER (PARTITION BY video_id ORDER BY quality DESC, frame_idx) AS rank FROM f JOIN s USING (video_id) WHERE n = k) WHERE rank <= 5""",
)

PAIRS = """, u AS (SELECT video_id, frame_idx, position, det_seq, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM positions),
w AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u), refs AS (SELECT video_id, position AS ref, v AS rv, n AS rn FROM w WHERE frame_idx = 0 AND position <> 1),
allpairs AS (SELECT video_id, frame_idx, position, det_seq, ref, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * rv[i])) / (n * rn) AS similarity FROM w JOIN refs USING (video_id))"""


def pairs(p: DataFrame, s: DataFrame, t: float = 0.16) -> DataFrame:
    return matching.similarity_join(p, s.where("not is_skip"), t)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


R.add("similarity_join", "positions slots", lambda p, s: rounded(pairs(p, s)), f"{PAIRS} SELECT video_id, frame_idx, position, det_seq, ref, round(similarity, 6) AS similarity FROM allpairs WHERE similarity >= 0.16e0")


def greedy_sql(source: str) -> str:
    """One-to-one by levels: a frame has 3 positions and at most 2 references, so two picks are enough."""
    return f""", c1 AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY similarity DESC, position, ref) AS n FROM {source}),
p1 AS (SELECT * FROM c1 WHERE n = 1),
c2 AS (SELECT c.video_id, c.frame_idx, c.position, c.det_seq, c.ref, c.similarity, row_number() OVER (PARTITION BY c.video_id, c.frame_idx ORDER BY c.similarity DESC, c.position, c.ref) AS n
 FROM c1 c JOIN p1 p ON c.video_id = p.video_id AND c.frame_idx = p.frame_idx AND c.position <> p.position AND c.ref <> p.ref)
SELECT video_id, frame_idx, position, det_seq, ref, round(similarity, 6) AS similarity FROM (SELECT * EXCLUDE (n) FROM p1 UNION ALL SELECT * EXCLUDE (n) FROM c2 WHERE n = 1)"""


R.add("greedy_assign", "positions slots", lambda p, s: rounded(matching.greedy_assign(pairs(p, s))), f"{PAIRS}, g AS (SELECT * FROM allpairs WHERE similarity >= 0.16e0)" + greedy_sql("g"))
R.add(
    "best_match",
    "positions slots",
    lambda p, s: rounded(matching.best_match(pairs(p, s, -1.0))),
    f"{PAIRS} SELECT video_id, frame_idx, position, det_seq, ref, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, det_seq ORDER BY similarity DESC, ref) AS n FROM allpairs) WHERE n = 1",
)
R.add("reset_match", "positions slots", lambda p, s: rounded(matching.reset_match(p, s.where("not is_skip"), 0.16, 4)), f"{PAIRS}, g AS (SELECT * FROM allpairs WHERE similarity >= 0.096e0 AND frame_idx > 0 AND frame_idx % 4 = 0)" + greedy_sql("g"))
R.add(
    "post_reset_match",
    "positions slots",
    lambda p, s: rounded(matching.post_reset_match(p, s.where("not is_skip"), 0.1)),
    f"{PAIRS} SELECT video_id, frame_idx, ref, position, det_seq, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, ref ORDER BY position, det_seq) AS n FROM allpairs WHERE similarity > 0.1e0) WHERE n = 1",
)


def lost_tracks(p: DataFrame) -> DataFrame:
    rows = p.select("video_id", (c("frame_idx") * 3 + c("position")).alias("track_id"), c("frame_idx").alias("lost_frame"), (c("position") == 1).alias("is_skip"), "embedding")
    return rows.withColumn("history", F.array(F.reverse("embedding"), F.col("embedding")))


R.add(
    "lost_recover",
    "positions",
    lambda p: rounded(matching.lost_recover(p, lost_tracks(p), 0.16, 1)),
    """, u AS (SELECT video_id, frame_idx, position, det_seq, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM positions), w AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM u),
l AS (SELECT video_id, frame_idx * 3 + position AS track_id, frame_idx AS lost_frame, position = 1 AS is_skip, v AS lv, list_reverse(v) AS rv, n AS ln FROM w),
j AS (SELECT w.video_id, w.frame_idx, det_seq, track_id, is_skip, greatest(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * lv[i])), list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * rv[i]))) / (n * ln) AS similarity
 FROM w JOIN l ON w.video_id = l.video_id AND frame_idx BETWEEN lost_frame AND lost_frame + 8)
SELECT video_id, frame_idx, det_seq, CAST(track_id AS INT) AS track_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, det_seq ORDER BY similarity DESC, track_id) AS k FROM j WHERE similarity > CASE WHEN is_skip THEN 0.12e0 ELSE 0.112e0 END) WHERE k = 1""",
)
R.add(
    "retain_unmatched",
    "positions",
    lambda p: matching.retain_unmatched(
        p.select("video_id", "frame_idx", c("position").alias("track_id"), c("frame_idx").alias("last_seen")),
        p.select("video_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda lag: c("frame_idx") + lag)).alias("frame_idx"), ((c("position") + c("frame_idx")) % 8).alias("track_id"), c("frame_idx").alias("last_seen")).groupBy("video_id", "frame_idx", "track_id").agg(F.max("last_seen").alias("last_seen")),
        4,
    ),
    """, m AS (SELECT video_id, frame_idx, position AS track_id, frame_idx AS last_seen FROM positions),
t AS (SELECT video_id, CAST(frame_idx + lag AS INT) AS frame_idx, (position + frame_idx) % 8 AS track_id, max(frame_idx) AS last_seen FROM positions, range(1, 7) r(lag) GROUP BY 1, 2, 3)
SELECT *, true AS matched FROM m UNION ALL SELECT *, false FROM t WHERE frame_idx - last_seen <= 4 AND NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = t.video_id AND m.frame_idx = t.frame_idx AND m.track_id = t.track_id)""",
)

SEG = f"CAST(frame_idx // {LENGTH} AS INT) AS seg_idx"


def cut(df: DataFrame) -> DataFrame:
    return segments.frame_to_segment(df, 0, LENGTH)


def whole_ranges(v: DataFrame) -> DataFrame:
    return v.select("video_id", F.lit(100).alias("range_start"), F.greatest(c("total_frames"), F.lit(100)).alias("range_end"))


PREFIX = """, pf AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS rn FROM segments_done),
pre AS (SELECT video_id, count(*) FILTER (rn = seg_idx) AS n_prefix, CAST(coalesce(sum(frames) FILTER (rn = seg_idx), 0) AS BIGINT) AS prefix_frames FROM pf GROUP BY 1)"""
RESUME = f"""{PREFIX}, res AS (SELECT video_id, greatest(total_frames, 100) AS range_end, coalesce(n_prefix, 0) AS n_prefix, CAST(least(100 + coalesce(prefix_frames, 0), greatest(total_frames, 100)) AS INT) AS resume FROM typed LEFT JOIN pre USING (video_id))"""
PLAN = f"""{RESUME}, st AS (SELECT *, unnest(range(0, (range_end - resume + 599) // 600)) AS i FROM res WHERE resume < range_end),
plan AS (SELECT video_id, CAST(n_prefix + i AS INT) AS seg_idx, CAST(resume + i * 600 AS INT) AS frame_start, CAST(least(resume + (i + 1) * 600, range_end) AS INT) AS frame_end FROM st)"""


def plan(v: DataFrame, d: DataFrame) -> DataFrame:
    return segments.segment_plan(segments.resume_frame(whole_ranges(v), d), 600)


R.add("frame_to_segment", "frames", lambda f: segments.frame_to_segment(f, 50, LENGTH).select("video_id", "frame_idx", "seg_idx"), f"SELECT video_id, frame_idx, CAST((frame_idx - 50) // {LENGTH} AS INT) AS seg_idx FROM frames WHERE frame_idx >= 50")
R.add("segment_total", "typed", lambda v: segments.segment_total(v, 600).select("video_id", "n_segments"), "SELECT video_id, CAST(CASE WHEN total_frames > 0 THEN ceil(total_frames / 600e0) ELSE 0 END AS INT) AS n_segments FROM typed")
R.add(
    "progress",
    "segments_done typed",
    segments.progress,
    ", s AS (SELECT video_id, sum(frames) AS f FROM segments_done GROUP BY 1) SELECT video_id, CAST(coalesce(f, 0) AS BIGINT) AS frames_done, total_frames, CASE WHEN total_frames > 0 THEN round(100 * coalesce(f, 0) / CAST(total_frames AS DOUBLE), 6) ELSE 0e0 END AS percent FROM typed LEFT JOIN s USING (video_id)",
)
R.add("contiguous_prefix", "segments_done", segments.contiguous_prefix, f"{PREFIX} SELECT * FROM pre")
R.add("next_segment", "segments_done", segments.next_segment, f"{PREFIX} SELECT video_id, CAST(coalesce(min(rn) FILTER (rn <> seg_idx), count(*)) AS INT) AS next_segment FROM pf GROUP BY 1")
R.add("resume_frame", "typed segments_done", lambda v, d: segments.resume_frame(whole_ranges(v), d).select("video_id", "n_prefix", "resume"), f"{RESUME} SELECT video_id, n_prefix, resume FROM res")
R.add("segment_plan", "typed segments_done", plan, f"{PLAN} SELECT * FROM plan")
R.add(
    "segments_missing",
    "typed segments_done",
    lambda v, d: segments.segments_missing(segments.segment_plan(whole_ranges(v).select("*", F.lit(0).alias("n_prefix"), c("range_start").alias("resume")), 600), d),
    """, st AS (SELECT *, unnest(range(0, (greatest(total_frames, 100) - 100 + 599) // 600)) AS i FROM typed), p AS (SELECT video_id, CAST(i AS INT) AS seg_idx, CAST(100 + i * 600 AS INT) AS frame_start, CAST(least(100 + (i + 1) * 600, greatest(total_frames, 100)) AS INT) AS frame_end FROM st)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM segments_done d WHERE d.video_id = p.video_id AND d.seg_idx = p.seg_idx)""",
)
R.add(
    "segments_completed",
    "typed segments_done",
    lambda v, d: segments.segments_completed(segments.segment_plan(whole_ranges(v).select("*", F.lit(0).alias("n_prefix"), c("range_start").alias("resume")), 600), d).select("video_id", "seg_idx"),
    ", st AS (SELECT video_id, unnest(range(0, (greatest(total_frames, 100) - 100 + 599) // 600)) AS i FROM typed) SELECT video_id, CAST(i AS INT) AS seg_idx FROM st JOIN segments_done d USING (video_id) WHERE d.seg_idx = i",
)
R.add(
    "frames_by_runs",
    "frames",
    lambda f: segments.frames_missing_extra_by_runs(cut(f), cut(f.where("not (event_type = 'error' and video_id % 3 = 0)"))),
    f" SELECT video_id, {SEG}, frame_idx, 'missing' AS status FROM frames WHERE event_type = 'error' AND video_id % 3 = 0",
)
R.add(
    "frames_missing_extra",
    "expected results",
    lambda e, r: segments.frames_missing_extra(cut(e), cut(r)),
    f", e AS (SELECT video_id, {SEG}, frame_idx FROM expected), a AS (SELECT video_id, {SEG}, frame_idx FROM results) SELECT *, 'missing' AS status FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)",
)
R.add(
    "frame_set_diff",
    "expected results",
    lambda e, r: segments.frame_set_diff(e, r),
    ", e AS (SELECT video_id, frame_idx FROM expected), a AS (SELECT video_id, frame_idx FROM results) SELECT e.*, 'missing' AS status FROM e ANTI JOIN a USING (video_id, frame_idx) UNION ALL SELECT a.*, 'extra' FROM a ANTI JOIN e USING (video_id, frame_idx)",
)
R.add(
    "fill_from_original",
    "frames results",
    lambda f, r: segments.fill_from_original(f.select("video_id", "frame_idx", "event_id", "value"), r.withColumn("value", -c("value")), ["event_id", "value"]),
    "SELECT video_id, frame_idx, event_id, CASE WHEN event_type = 'error' THEN value ELSE -value END AS value, event_type = 'error' AS recovered FROM frames",
)
R.add(
    "missing_preview",
    "frames results",
    lambda f, r: segments.missing_preview(segments.frame_set_diff(f, r)),
    ", m AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM frames WHERE event_type = 'error') SELECT video_id, count(*) AS n_missing, string_agg(frame_idx, ',' ORDER BY frame_idx) FILTER (n <= 10) AS first FROM m GROUP BY 1",
)
R.add(
    "segment_list_summary",
    "segments_done",
    lambda d: segments.segment_list_summary(d, 8, 3),
    ", m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS u, count(*) OVER (PARTITION BY video_id) AS n FROM segments_done) SELECT video_id, n, string_agg(seg_idx, ',' ORDER BY seg_idx) FILTER (n <= 8 OR u <= 3 OR u > n - 3) AS ids FROM m GROUP BY 1, 2",
)
ORDER = "ordered AS (SELECT *, CAST(row_number() OVER w AS INT) AS place, CAST(coalesce(sum(frames) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM segments_done WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx))"
R.add("segments_ordered", "segments_done", segments.segments_ordered, f', {ORDER} SELECT video_id, seg_idx, frames, place, "offset" FROM ordered')
R.add(
    "segment_sample",
    "segments_done",
    segments.segment_sample,
    ", m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5(video_id || ':' || seg_idx || ':7'), seg_idx) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM segments_done) SELECT video_id, seg_idx, frames FROM m WHERE r <= greatest(1, least(n // 10, 50))",
)


def done_of(r: DataFrame) -> DataFrame:
    return cut(r).where("seg_idx % 3 <> 1").groupBy("video_id", "seg_idx").agg(F.count("*").alias("frames"))


R.add(
    "merge_segments",
    "results",
    lambda r: segments.merge_segments(cut(r).select("video_id", "seg_idx", "frame_idx"), done_of(r)),
    f", m AS (SELECT video_id, {SEG}, frame_idx FROM results) SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS out_idx FROM m WHERE seg_idx % 3 <> 1",
)


def some_ranges(f: DataFrame) -> DataFrame:
    return f.where("frame_idx = 0 and video_id <> 7").select("video_id", (c("video_id") * 10).cast("int").alias("range_start"), (c("video_id") * 30).cast("int").alias("range_end"), F.lit(25.0).alias("fps"))


R.add(
    "splice",
    "frames",
    lambda f: segments.splice(f.select("video_id", "frame_idx", "event_id"), f.select("video_id", "frame_idx", (-c("event_id")).alias("event_id")), some_ranges(f)),
    ", m AS (SELECT video_id, frame_idx, event_id, video_id <> 7 AND frame_idx >= video_id * 10 AND frame_idx < video_id * 30 AS i FROM frames) SELECT video_id, frame_idx, CASE WHEN i THEN -event_id ELSE event_id END AS event_id, CASE WHEN i THEN 'processed' ELSE 'original' END AS origin FROM m",
)
R.add(
    "extract_only",
    "frames",
    lambda f: segments.extract_only(f.select("video_id", "frame_idx", "event_id"), some_ranges(f)),
    "SELECT video_id, CAST(frame_idx - video_id * 10 AS INT) AS frame_idx, event_id, round(video_id * 10 / 25e0, 6) AS offset_seconds FROM frames WHERE video_id <> 7 AND frame_idx >= video_id * 10 AND frame_idx < video_id * 30",
)


def in_order(r: DataFrame) -> DataFrame:
    ordered = segments.frame_order(r.select("video_id", "frame_idx", "event_id"))
    return ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("at"))).select("video_id", "frame_idx", "event_id", "place")


R.add("frame_order", "results", in_order, "SELECT video_id, frame_idx, event_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS INT) AS place FROM results")

REC = f", m AS (SELECT video_id, {SEG}, count(*) AS k FROM results GROUP BY 1, 2), rec AS (SELECT video_id, seg_idx, CASE WHEN seg_idx % 4 = 0 THEN k + 1 ELSE k END AS frames FROM m UNION ALL SELECT video_id, 9000, 5 FROM m GROUP BY 1)"


def recorded(r: DataFrame) -> DataFrame:
    m = cut(r).groupBy("video_id", "seg_idx").agg(F.count("*").alias("k"))
    return m.select("video_id", "seg_idx", F.when(c("seg_idx") % 4 == 0, c("k") + 1).otherwise(c("k")).alias("frames")).union(m.select("video_id").distinct().select("video_id", F.lit(9000), F.lit(5).cast("long")))


R.add(
    "segment_verify",
    "results",
    lambda r: verify.segment_verify(recorded(r), cut(r)),
    f"{REC} SELECT rec.video_id, rec.seg_idx, frames, coalesce(k, 0) AS actual, CASE WHEN k IS NULL THEN 'dropped' WHEN k <> frames THEN 'corrected' ELSE 'ok' END AS status FROM rec LEFT JOIN m ON m.video_id = rec.video_id AND m.seg_idx = rec.seg_idx",
)

def stored_segments(r: DataFrame) -> str:
    """Where a table lies by video and segment, after it was written there."""
    path = shared_path(r.sparkSession, "segments")
    checkpoints.segment_sink(cut(r).select("video_id", "seg_idx", "frame_idx", "event_id", "value"), path, block=BLOCK)
    return path


R.add(
    "segment_verify_stored",
    "results",
    lambda r: verify.segment_verify_stored(recorded(r), stored_segments(r)),
    f"{REC} SELECT rec.video_id, rec.seg_idx, frames, coalesce(k, 0) AS actual, CASE WHEN k IS NULL THEN 'dropped' WHEN k <> frames THEN 'corrected' ELSE 'ok' END AS status FROM rec LEFT JOIN m ON m.video_id = rec.video_id AND m.seg_idx = rec.seg_idx",
)


def spliced(f: DataFrame, r: DataFrame, v: DataFrame) -> DataFrame:
    path = stored_segments(f)
    new = cut(r).select("video_id", "seg_idx", "frame_idx", "event_id", (-c("value")).alias("value"))
    checkpoints.splice_stored(new, v.select("video_id", F.lit(30).alias("range_start"), (c("total_frames") % 700 + 30).alias("range_end")), path, BLOCK)
    return f.sparkSession.read.schema("seg_idx int, frame_idx int, event_id long, value double, video_id long, seg_block int").parquet(path).select("frame_idx", "event_id", "value", "video_id", "seg_idx")


R.add(
    "splice_stored",
    "frames results typed",
    spliced,
    f""" SELECT f.video_id, {SEG.replace("frame_idx", "f.frame_idx")}, f.frame_idx, f.event_id, CASE WHEN f.frame_idx >= 30 AND f.frame_idx < total_frames % 700 + 30 THEN -value ELSE value END AS value
FROM frames f LEFT JOIN typed USING (video_id) WHERE NOT (f.frame_idx >= 30 AND f.frame_idx < coalesce(total_frames % 700 + 30, 0) AND event_type = 'error' AND (f.video_id, f.frame_idx // {LENGTH}) IN (SELECT video_id, frame_idx // {LENGTH} FROM results JOIN typed USING (video_id) WHERE frame_idx >= 30 AND frame_idx < total_frames % 700 + 30))""",
)
R.add(
    "merge_audit",
    "results",
    lambda r: verify.merge_audit(recorded(r), cut(r)),
    f"""{REC}, s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5(video_id || ':' || seg_idx || ':7'), seg_idx) AS r, count(*) OVER (PARTITION BY video_id) AS n,
 CAST(row_number() OVER w AS INT) AS place, CAST(coalesce(sum(frames) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rec WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)),
a AS (SELECT s.*, CASE WHEN r <= greatest(1, least(n // 10, 50)) THEN coalesce(k, 0) END AS actual FROM s LEFT JOIN m ON m.video_id = s.video_id AND m.seg_idx = s.seg_idx)
SELECT video_id, seg_idx, place, "offset", frames, actual, CASE WHEN actual IS NULL THEN 'unchecked' WHEN actual = 0 THEN 'dropped' WHEN actual <> frames THEN 'corrected' ELSE 'ok' END AS status FROM a""",
)
R.add(
    "segment_stats",
    "expected results",
    lambda e, r: verify.segment_stats(cut(e), cut(r)),
    f""", e AS (SELECT video_id, {SEG}, frame_idx FROM expected), a AS (SELECT video_id, {SEG}, frame_idx FROM results),
j AS (SELECT coalesce(e.video_id, a.video_id) AS video_id, coalesce(e.seg_idx, a.seg_idx) AS seg_idx, e.frame_idx AS ef, a.frame_idx AS af FROM e FULL JOIN a ON e.video_id = a.video_id AND e.frame_idx = a.frame_idx)
SELECT video_id, seg_idx, count(ef) AS expected, count(af) AS written, count(*) FILTER (af IS NULL) AS missing, count(*) FILTER (ef IS NULL) AS extra FROM j GROUP BY 1, 2""",
)
R.add(
    "segment_verify_tolerant",
    "results",
    lambda r: verify.segment_verify_tolerant(
        cut(r).groupBy("video_id", "seg_idx").agg(F.count("*").alias("recount")).withColumn("expected", c("recount") + c("seg_idx") % 3).withColumn("reported", c("recount") + c("video_id") % 4)
    ).select("video_id", "seg_idx", "valid"),
    f", m AS (SELECT video_id, {SEG}, count(*) AS k FROM results GROUP BY 1, 2) SELECT video_id, seg_idx, abs(video_id % 4 - seg_idx % 3) <= 1 OR seg_idx % 3 = 0 AS valid FROM m",
)
R.add(
    "count_discrepancy",
    "typed videos",
    lambda t, v: verify.count_discrepancy(t.join(v.select("video_id", "decoder_frames"), "video_id").withColumn("other", (F.coalesce(c("decoder_frames"), F.lit(0)) + c("video_id") % 90).cast("int")), "total_frames", "other").select("video_id", "diff", "percent", "vfr_suspect"),
    ", m AS (SELECT t.video_id, total_frames AS a, CAST(coalesce(decoder_frames, 0) + t.video_id % 90 AS INT) AS b FROM typed t JOIN videos v ON v.video_id = t.video_id) SELECT video_id, abs(a - b) AS diff, CASE WHEN greatest(a, b) > 0 THEN round(100 * abs(a - b) / CAST(greatest(a, b) AS DOUBLE), 6) ELSE 0e0 END AS percent, abs(a - b) > 50 AS vfr_suspect FROM m",
)
R.add(
    "total_reconcile",
    "typed segments_done",
    lambda t, d: verify.total_reconcile(t.select("video_id", F.when(c("video_id") % 5 != 0, c("total_frames") + c("video_id") % 2).cast("int").alias("total_frames")), t.select("video_id", F.when(c("video_id") % 3 == 0, 50).otherwise(c("total_frames")).alias("total_frames")), d),
    f"""{PREFIX}, m AS (SELECT t.video_id, CASE WHEN t.video_id % 5 = 0 THEN 0 ELSE CAST(total_frames + t.video_id % 2 AS INT) END AS old_total, CASE WHEN t.video_id % 3 = 0 THEN 50 ELSE total_frames END AS new_total, coalesce(prefix_frames, 0) AS prefix_frames FROM typed t LEFT JOIN pre ON pre.video_id = t.video_id)
SELECT *, CASE WHEN old_total > 0 AND old_total <> new_total AND prefix_frames > new_total THEN old_total ELSE new_total END AS total_frames FROM m""",
)
R.add("actual_end", "results typed", lambda r, t: verify.actual_end(r, t), ", m AS (SELECT video_id, max(frame_idx) + 1 AS e FROM results GROUP BY 1) SELECT video_id, least(total_frames, e) AS total_frames FROM typed JOIN m USING (video_id)")
R.add(
    "completion_check",
    "segments_done typed",
    lambda d, t: verify.completion_check(segments.progress(d, t).withColumn("merged", c("video_id") % 2 == 0).withColumn("finalised", c("video_id") % 3 == 0).withColumnsRenamed({"frames_done": "written", "total_frames": "expected"})).select("video_id", "done", "remerge"),
    ", s AS (SELECT video_id, sum(frames) AS f FROM segments_done GROUP BY 1) SELECT video_id, video_id % 6 = 0 AS done, video_id % 6 = 0 AND coalesce(f, 0) < total_frames * 0.95e0 AS remerge FROM typed LEFT JOIN s USING (video_id)",
)
R.add(
    "duration_check",
    "typed",
    lambda t: verify.duration_check(t.select("video_id", (c("total_frames") * 1.0 / 2).cast("double").alias("original"), (c("total_frames") * 1.0 / 2 + (c("video_id") % 23) / 10.0).cast("double").alias("final"))).select("video_id", "diff", "percent", "tolerance", "ok"),
    """, m AS (SELECT video_id, total_frames / 2e0 AS o, total_frames / 2e0 + (video_id % 23) / 10e0 AS f FROM typed), k AS (SELECT *, CASE WHEN o < 300 THEN 1e0 WHEN o < 1800 THEN greatest(1e0, o * 0.001e0) ELSE least(2e0, o * 0.001e0) END AS t FROM m)
SELECT video_id, round(abs(f - o), 6) AS diff, CASE WHEN o > 0 THEN round(100 * abs(f - o) / o, 6) ELSE 0e0 END AS percent, round(t, 6) AS tolerance, round(abs(f - o), 9) <= round(t, 9) AS ok FROM k""",
)


def documents(d: DataFrame) -> DataFrame:
    """Checkpoint documents of both generations, and unreadable ones, from segments done."""
    rows = d.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "frames"))).alias("s"))
    pairs_ = F.array_join(F.transform("s", lambda x: F.format_string('"%d": %d', x["seg_idx"], x["frames"])), ", ")
    ids = F.array_join(F.transform("s", lambda x: x["seg_idx"].cast("string")), ", ")
    body = F.when(c("video_id") % 2 == 0, F.concat(F.lit("{"), pairs_, F.lit("}"))).otherwise(F.concat(F.lit("["), ids, F.lit("]")))
    doc = F.when(c("video_id") % 11 == 0, "not json").otherwise(F.concat(F.lit('{"completed_segments": '), body, F.lit(', "total_frames": 3000}')))
    return rows.select("video_id", doc.alias("doc"))


R.add(
    "checkpoint_read",
    "segments_done",
    lambda d: checkpoints.checkpoint_read(documents(d), d.withColumn("frames", F.when(c("seg_idx") == 2, 0).otherwise(c("frames") - 10).cast("int"))),
    "SELECT video_id, seg_idx, CASE WHEN video_id % 2 = 0 THEN frames ELSE frames - 10 END AS frames, 3000 AS total_frames FROM segments_done WHERE video_id % 11 <> 0 AND (video_id % 2 = 0 OR (seg_idx <> 2 AND frames > 10))",
)
R.add(
    "checkpoint_write",
    "segments_done",
    lambda d: checkpoints.checkpoint_write(d.withColumn("total_frames", F.lit(3000))),
    """SELECT video_id, '{"completed_segments":{' || string_agg('"' || seg_idx || '":' || frames, ',' ORDER BY seg_idx) || '},"total_frames":3000}' AS doc FROM segments_done GROUP BY 1""",
)
R.add(
    "checkpoint_repair",
    "results",
    lambda r: checkpoints.checkpoint_repair(recorded(r), cut(r)),
    f"""{REC}, s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5(video_id || ':' || seg_idx || ':7'), seg_idx) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM rec),
v AS (SELECT s.*, coalesce(k, 0) AS k, r <= greatest(1, least(n // 10, 50)) AS checked FROM s LEFT JOIN m ON m.video_id = s.video_id AND m.seg_idx = s.seg_idx)
SELECT video_id, seg_idx, CASE WHEN checked THEN k ELSE frames END AS frames, CASE WHEN NOT checked THEN 'unchecked' WHEN k <> frames THEN 'corrected' ELSE 'ok' END AS status FROM v WHERE NOT checked OR k > 0""",
)


def job(f: DataFrame, r: DataFrame, v: DataFrame, d: DataFrame, stored: DataFrame) -> video_job.Run:
    """The whole run; processing turns the sign of an event's value, as it did in the segments of earlier runs, some of which are damaged."""
    before = v.select("video_id", (c("total_frames") + c("video_id") % 3 * 40 - 40).cast("int").alias("total_frames"))
    return video_job.run(f.select("video_id", "frame_idx", "event_id", "value"), r.select("video_id", "frame_idx", "event_id", (-c("value")).alias("value")), v, whole_ranges(v), d, stored, ["event_id", "value"], 600, before)


JOB_TABLES = "frames results typed segments_done stored"
# from the reference's rules: segments without rows go, the others count what they hold; the prefix without a gap decides the
# frame to go on with; all completed segments are merged, and the clip lies over the whole range
JOB = """, held AS (SELECT d.video_id, d.seg_idx, d.frames AS said, count(s.frame_idx) AS frames FROM segments_done d LEFT JOIN stored s ON s.video_id = d.video_id AND s.seg_idx = d.seg_idx GROUP BY 1, 2, 3),
rep AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS rn FROM held WHERE frames > 0),
pre AS (SELECT video_id, count(*) FILTER (rn = seg_idx) AS n_prefix, coalesce(sum(frames) FILTER (rn = seg_idx), 0) AS prefix_frames, count(*) FILTER (frames <> said) AS corrected FROM rep GROUP BY 1),
res AS (SELECT video_id, total_frames, fps, greatest(total_frames, 100) AS range_end, coalesce(n_prefix, 0) AS n_prefix, coalesce(prefix_frames, 0) AS prefix_frames, coalesce(corrected, 0) AS corrected, CAST(least(100 + coalesce(prefix_frames, 0), greatest(total_frames, 100)) AS INT) AS resume FROM typed LEFT JOIN pre USING (video_id)),
rng AS (SELECT f.*, resume, n_prefix, s.seg_idx AS old, s.recovered AS old_recovered FROM frames f JOIN res ON res.video_id = f.video_id AND f.frame_idx >= 100 AND f.frame_idx < range_end
  LEFT JOIN stored s ON s.video_id = f.video_id AND s.frame_idx = f.frame_idx AND s.seg_idx < n_prefix AND f.frame_idx < resume),
j AS (SELECT video_id, frame_idx, event_id, CASE WHEN frame_idx >= resume THEN CAST(n_prefix + (frame_idx - resume) // 600 AS INT) ELSE old END AS seg_idx, frame_idx >= resume AS is_new,
  CASE WHEN frame_idx >= resume THEN event_type = 'error' ELSE coalesce(old_recovered, true) END AS recovered, value FROM rng)"""
JOB_VALUE = "CASE WHEN j.recovered THEN j.value ELSE -j.value END AS value"
R.add(
    "video_job",
    JOB_TABLES,
    lambda *t: job(*t).report,
    f"""{JOB}, s AS (SELECT video_id, count(*) FILTER (is_new) AS n, count(*) FILTER (is_new AND recovered) AS e, count(*) FILTER (seg_idx IS NULL) AS lost, count(seg_idx) AS written FROM j GROUP BY 1),
p AS (SELECT video_id, count(*) AS k, array_to_string(list(frame_idx ORDER BY frame_idx)[1:20], ',') AS first FROM j WHERE recovered GROUP BY 1),
b AS (SELECT video_id, max(frame_idx) + 1 AS last FROM frames GROUP BY 1),
t AS (SELECT video_id, least(last, CASE WHEN old > 0 AND old <> total_frames AND prefix_frames > total_frames THEN old ELSE total_frames END) AS total FROM (SELECT res.*, total_frames + video_id % 3 * 40 - 40 AS old FROM res) JOIN b USING (video_id)),
o AS (SELECT res.*, coalesce(total, 0) AS total, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(lost, 0) AS lost, coalesce(written, 0) AS written, coalesce(k, 0) AS k, coalesce(first, '') AS first, CAST(greatest(least(range_end, coalesce(total, 0)) - 100, 0) AS BIGINT) AS expected
  FROM res LEFT JOIN s USING (video_id) LEFT JOIN p USING (video_id) LEFT JOIN t USING (video_id)),
q AS (SELECT *, written > 0 AND resume + n >= least(range_end, total) AS done, total / fps AS was, (total - expected + written + lost) / fps AS final FROM o)
SELECT video_id, n_prefix AS segments_before, 100 AS range_start, resume, range_end, CAST((range_end - resume + 599) // 600 AS BIGINT) AS segments_planned, corrected AS segments_corrected, n AS frames_todo, n - e AS processed, e AS recovered, lost AS lost_before, written,
  k AS recovered_in_all, first AS first_recovered, CAST(total AS INT) AS total_frames, expected, done, done AND written < expected * 0.95 AS remerge,
  round(abs(final - was), 9) <= round(CASE WHEN was < 300 THEN 1e0 WHEN was < 1800 THEN greatest(1e0, was * 0.001e0) ELSE least(2e0, was * 0.001e0) END, 9) AS duration_ok FROM q""",
)
R.add(
    "video_job_frames",
    JOB_TABLES,
    lambda *t: job(*t).frames,
    f"""{JOB} SELECT f.video_id, f.frame_idx, f.event_id, CASE WHEN j.frame_idx IS NOT NULL AND NOT j.recovered THEN -f.value ELSE f.value END AS value, CASE WHEN j.frame_idx IS NULL THEN 'original' ELSE 'processed' END AS origin, coalesce(j.recovered, false) AS recovered
FROM frames f LEFT JOIN j ON j.video_id = f.video_id AND j.frame_idx = f.frame_idx""",
)
R.add(
    "video_job_merged",
    JOB_TABLES,
    lambda *t: job(*t).merged,
    f"{JOB} SELECT video_id, seg_idx, frame_idx, event_id, {JOB_VALUE}, recovered, is_new, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, frame_idx) - 1 AS out_idx FROM j WHERE seg_idx IS NOT NULL",
)
R.add(
    "video_job_checkpoint",
    JOB_TABLES,
    lambda *t: job(*t).checkpoint,
    f"{JOB} SELECT video_id, seg_idx, count(*) AS frames FROM j WHERE seg_idx IS NOT NULL GROUP BY 1, 2",
)
R.add(
    "checkpoint_upsert",
    "segments_done",
    lambda d: checkpoints.checkpoint_upsert(d, d.where("seg_idx % 2 = 0").select("video_id", "seg_idx", (c("frames") + 1).cast("int").alias("frames"), F.lit(1).alias("version")).union(d.where("seg_idx % 4 = 0").select("video_id", (c("seg_idx") + 1000).cast("int"), "frames", F.lit(2)))),
    "SELECT video_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN frames + 1 ELSE frames END AS frames FROM segments_done UNION ALL SELECT video_id, seg_idx + 1000, frames FROM segments_done WHERE seg_idx % 4 = 0",
)
R.add("checkpoint_remove", "segments_done", lambda d: checkpoints.checkpoint_remove(d, d.where("frames % 3 = 0")), "SELECT * FROM segments_done WHERE frames % 3 <> 0")
R.add(
    "worker_stats",
    "frame_log",
    stats.worker_stats,
    """SELECT gpu_id, worker_id, count(*) AS frames, count(*) FILTER (NOT failed) AS processed, count(*) FILTER (failed) AS failed, round(sum(elapsed_ms), 4) AS total_ms, round(avg(elapsed_ms), 6) AS avg_ms,
 CAST(grouping(gpu_id, worker_id) AS INT) AS level, round(count(*) / CAST((SELECT count(*) FROM frame_log) AS DOUBLE), 6) AS share FROM frame_log GROUP BY ROLLUP (gpu_id, worker_id)""",
)
R.add(
    "progress_marks",
    "frame_log",
    lambda f: stats.progress_marks(f, f.groupBy("worker_id").agg(F.count("*").alias("total"))),
    ", m AS (SELECT worker_id, row_number() OVER w AS n, avg(elapsed_ms) OVER w AS a, count(*) OVER (PARTITION BY worker_id) AS t FROM frame_log WINDOW w AS (PARTITION BY worker_id ORDER BY frame_idx)) SELECT worker_id, n AS written, round(100 * n / CAST(t AS DOUBLE), 6) AS percent, round(a, 9) AS avg_ms FROM m WHERE n % 100 = 0",
)
