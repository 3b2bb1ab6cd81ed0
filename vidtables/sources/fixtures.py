"""Logical input tables derived from the star-schema tables, in SQL that Spark and DuckDB share.

A template names the tables that it reads in braces. TIME and SKIP_LIST are the rules for the texts
of requests in DuckDB SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = {
    "videos": """SELECT c_custkey AS video_id,
 CASE c_custkey % 9 WHEN 0 THEN '30000/1001' WHEN 1 THEN CAST(c_custkey % 300 AS VARCHAR(20)) || '/1' WHEN 2 THEN CAST(1000 * (c_custkey % 70) AS VARCHAR(20)) || '/1001' WHEN 3 THEN CAST(c_custkey % 50 AS VARCHAR(20)) || '/0' WHEN 4 THEN 'N/A' WHEN 5 THEN CAST(c_custkey % 300 AS VARCHAR(20)) WHEN 6 THEN '1/2/' || CAST(c_custkey % 9 AS VARCHAR(20)) WHEN 7 THEN CAST(c_custkey % 60 AS VARCHAR(20)) || '.5' ELSE '-' || CAST(c_custkey % 30 AS VARCHAR(20)) END AS avg_frame_rate,
 CASE c_custkey % 6 WHEN 0 THEN '1920x1080' WHEN 1 THEN CAST(100 + c_custkey % 1900 AS VARCHAR(20)) || 'x' || CAST(90 + c_custkey % 1100 AS VARCHAR(20)) WHEN 2 THEN '' WHEN 3 THEN CAST(c_custkey % 500 AS VARCHAR(20)) || 'x' WHEN 4 THEN CAST(c_custkey % 500 AS VARCHAR(20)) || 'x2x3' ELSE CAST(c_custkey % 500 AS VARCHAR(20)) || '.5x9' END AS resolution,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(600 + c_custkey % 5000 AS VARCHAR(20)) END AS nb_read_packets,
 CASE WHEN c_custkey % 8 = 0 THEN 'N/A' ELSE CAST(598 + c_custkey % 5000 AS VARCHAR(20)) END AS nb_frames,
 CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE CAST(590 + c_custkey % 5003 AS INT) END AS decoder_frames
 FROM {customer}""",
    "requests": """SELECT o_orderkey AS request_id, o_custkey AS video_id,
 CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_orderkey % 40 AS VARCHAR(20)) || '.5' WHEN 2 THEN CAST(o_orderkey % 3 AS VARCHAR(20)) || ':' || CAST(o_orderkey % 75 AS VARCHAR(20)) WHEN 3 THEN '0:' || CAST(o_orderkey % 2 AS VARCHAR(20)) || ':' || CAST(o_orderkey % 60 AS VARCHAR(20)) || '.25'
 WHEN 4 THEN '1:2:3:' || CAST(o_orderkey % 9 AS VARCHAR(20)) WHEN 5 THEN 'x:' || CAST(o_orderkey % 9 AS VARCHAR(20)) WHEN 6 THEN CAST(o_orderkey % 5 AS VARCHAR(20)) || '.5:10' WHEN 7 THEN '' ELSE CAST(o_orderkey % 100 AS VARCHAR(20)) END AS start_time,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 900 AS INT) ELSE NULL END AS start_frame,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(300 + o_orderkey % 9000 AS INT) ELSE NULL END AS end_frame,
 CAST(o_orderkey % 40 - 2 AS INT) AS reference_frame,
 CAST(o_orderkey % 120 AS DOUBLE) / 100 - 0.1 AS sim_threshold,
 CAST(o_orderkey % 90 - 3 AS INT) AS max_age, CAST(o_orderkey % 70 AS INT) AS reset_interval,
 CAST(o_orderkey % 700 AS INT) AS segment_frames,
 CASE o_orderkey % 6 WHEN 0 THEN '-1' WHEN 1 THEN CAST(o_orderkey % 5 AS VARCHAR(20)) || ',2' WHEN 2 THEN CAST(o_orderkey % 4 AS VARCHAR(20)) || ', ,' || CAST(o_orderkey % 7 AS VARCHAR(20)) WHEN 3 THEN 'a, ' || CAST(o_orderkey % 3 AS VARCHAR(20)) || ',1.5' WHEN 4 THEN CAST(o_orderkey % 3 AS VARCHAR(20)) || ',-1' ELSE NULL END AS skip_spec FROM {orders}""",
    "frames": """SELECT event_id % 10 AS video_id, CAST(floor(event_id / 10) AS INT) AS frame_idx, event_id, ts, event_type, value FROM {events}""",
    "frame_log": """SELECT user_id % 2 AS gpu_id, user_id % 8 AS worker_id, event_id AS frame_idx, ts, value AS elapsed_ms, event_type = 'error' AS failed FROM {events}""",
    "detections": """SELECT CAST(vec_id % 10 AS INT) AS video_id, CAST(floor(floor(vec_id / 10) / 3) AS INT) AS frame_idx, vec_id AS det_seq,
 CAST((vec_id * 37) % 1600 AS DOUBLE) AS x1, CAST((vec_id * 53) % 800 AS DOUBLE) AS y1,
 CAST((vec_id * 37) % 1600 + 40 + (vec_id * 29) % 500 AS DOUBLE) AS x2,
 CAST((vec_id * 53) % 800 + 40 + (vec_id * 31) % 500 AS DOUBLE) AS y2,
 CAST((vec_id * 17) % 100 AS DOUBLE) / 100 AS det_score, CAST(vec_id % 4 AS INT) AS pass_no, embedding
 FROM {embeddings}""",
    "segments_done": """SELECT video_id, seg_idx, frames FROM (SELECT o_custkey AS video_id,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seg_idx,
 CAST(10 + o_orderkey % 591 AS INT) AS frames, o_orderstatus FROM {orders}) t WHERE o_orderstatus <> 'P'""",
    "offsets": """SELECT video_id, seg_idx, frames, CAST(100 + coalesce(sum(frames) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS seg_start FROM {segments_done}""",
    "stored": """SELECT f.video_id, s.seg_idx, f.frame_idx, f.event_id, CASE WHEN f.event_type = 'error' THEN f.value ELSE -f.value END AS value, f.event_type = 'error' AS recovered
 FROM {frames} f JOIN {offsets} s ON f.video_id = s.video_id AND f.frame_idx >= s.seg_start AND f.frame_idx < s.seg_start + s.frames
 WHERE (f.video_id + s.seg_idx) % 7 <> 3 AND NOT ((f.video_id + s.seg_idx) % 3 = 1 AND f.frame_idx < s.seg_start + 2)""",
    "positions": """SELECT *, CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY x1, det_seq) - 1 AS INT) AS position FROM {detections}""",
    "slots": """SELECT video_id, position, CASE WHEN position = 1 THEN NULL ELSE embedding END AS embedding, position = 1 AS is_skip FROM {positions} WHERE frame_idx = 0""",
    "expected": """SELECT video_id, CASE WHEN event_id % 17 = 3 THEN frame_idx + 1000000 ELSE frame_idx END AS frame_idx FROM {frames}""",
    "people": """SELECT video_id, frame_idx, position, det_seq, CAST((position + frame_idx) % 3 AS INT) AS person FROM {positions}""",
    "kept_slots": """SELECT CASE WHEN video_id % 4 = 1 AND position = 2 THEN video_id + 1000 WHEN video_id = 4 THEN 2004 ELSE video_id END AS video_id, position, embedding, is_skip FROM {slots}""",
    "results": """SELECT * FROM {frames} WHERE event_type <> 'error'""",
    "typed": """SELECT video_id, CASE video_id % 6 WHEN 0 THEN CAST(30000 AS DOUBLE) / 1001 WHEN 1 THEN CAST(25 AS DOUBLE) WHEN 2 THEN CAST(24000 AS DOUBLE) / 1001 ELSE CAST(30 AS DOUBLE) END AS fps,
 CASE WHEN video_id % 3 = 1 THEN 640 ELSE 1920 END AS width, CASE WHEN video_id % 3 = 1 THEN 360 ELSE 1080 END AS height,
 CAST(coalesce(CAST(nb_read_packets AS INT), CASE WHEN nb_frames <> 'N/A' THEN CAST(nb_frames AS INT) END, decoder_frames, 0) AS INT) AS total_frames FROM {videos}""",
}


_PART = "split_part(start_time, ':', {})".format
_WHOLE = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN CAST({0} AS INT) END".format
TIME = f"""(CASE len(string_split(start_time, ':')) WHEN 1 THEN TRY_CAST(start_time AS DOUBLE) WHEN 2 THEN ({_WHOLE(_PART(1))}) * 60 + TRY_CAST({_PART(2)} AS DOUBLE)
 WHEN 3 THEN ({_WHOLE(_PART(1))}) * 3600 + ({_WHOLE(_PART(2))}) * 60 + TRY_CAST({_PART(3)} AS DOUBLE) END)"""
_NUMBERS = "list_filter(list_transform(string_split(skip_spec, ','), lambda x: CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN CAST(trim(x) AS INT) END), lambda x: x IS NOT NULL)"
SKIP_LIST = f"CASE WHEN list_contains({_NUMBERS}, -1) THEN CAST([] AS INT[]) ELSE {_NUMBERS} END"


def inputs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", TEMPLATES[name])


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in TEMPLATES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TEMPLATES[name], **{t: fixture(spark, sf_dir, t) for t in inputs(name)})


def common_tables(*names: str) -> str:
    """A WITH clause in DuckDB SQL for some derived tables and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TEMPLATES and name not in done:
            for t in inputs(name):
                add(t)
            done[name] = TEMPLATES[name].format(**{t: t for t in inputs(name)})

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items())
