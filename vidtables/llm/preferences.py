"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The longest common turn prefix of the chosen and the rejected conversation is the prompt; it
is rendered once. What follows in either is its completion. Assistants' turns of completions
are trained on, all others are masked. format_pairs() has a row for each rendered turn with its
place in its part. paired() puts them together: a row for each pair with the prompt, both
completions and the spans that are trained on. A pair with a part of more than `longest`
characters has several rows, numbered by piece: each has the turns of all parts that start in
one stretch of `longest` characters, so that no conversation has to fit in one row or task.

Turns are compared at (turn, place): place counts rows of one conversation and turn, in the
order of role and text, nulls first. Turns are equal if role and text are, nulls included. A
conversation whose partner is missing has an empty prompt; equal conversations are all prompt.
Rows without conversation or turn are left out. Null roles and texts render as empty. Extra
columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64  # turns whose lengths are summed together


def rendered() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))


def paired_by_id(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """turns with pair_id and chosen: conversation 2k is chosen over 2k + 1."""
    return turns.withColumn("pair_id", F.floor(F.col(conv_col) / 2).cast("long")).withColumn("chosen", F.pmod(F.col(conv_col), F.lit(2)) == 0)


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, part, turn, place, role, rendered, start_char, end_char, trained) from turns
    (pair_id, chosen, turn, role, text); part is prompt, chosen or rejected.

    Turns are shuffled by pair and turn, where both conversations meet, and once more to their
    places; the places themselves are found from lengths alone."""
    rows = turns.where("pair_id is not null and chosen is not null and turn is not null").select("pair_id", "chosen", "turn", "role", "text").repartition("pair_id", "turn")
    again = Window.partitionBy("pair_id", "turn", "chosen").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    meet = Window.partitionBy("pair_id", "turn", "place")
    said = F.struct(F.col("role").isNull().alias("no_role"), F.coalesce("role", F.lit("")).alias("role"), F.col("text").isNull().alias("no_text"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(again) - 1).withColumn("said", said)
    rows = rows.withColumn("differs", (F.count("*").over(meet) < 2) | (F.min("said").over(meet) != F.max("said").over(meet)))
    rows = rows.select("pair_id", "chosen", "turn", "place", "role", "differs", rendered().alias("rendered"))
    apart = rows.where("differs").groupBy("pair_id").agg(F.min(F.struct("turn", "place")).alias("first"))
    held = rows.select("pair_id", "chosen", "turn", "place", F.length("rendered").alias("n")).join(apart, "pair_id", "left")
    common = F.col("first").isNull() | (F.struct("turn", "place") < F.col("first"))
    held = held.where(F.col("chosen") | ~common).withColumn("part", F.when(common, "prompt").when(F.col("chosen"), "chosen").otherwise("rejected"))
    held = held.withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["pair_id", "part"]
    sums = held.groupBy(*key, "block").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*key, "block", F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy(*key, "block").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, 0))
    places = held.withColumn("upto", upto).join(sums, [*key, "block"]).select("pair_id", "chosen", "turn", "place", "part", (F.col("before") + F.col("upto")).alias("end_char"))
    out = rows.drop("differs").join(places, ["pair_id", "chosen", "turn", "place"])
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return out.select(*key, "turn", "place", "role", "rendered", (F.col("end_char") - F.length("rendered")).alias("start_char"), "end_char", trained.alias("trained"))


def paired(parts: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """(pair_id, piece, prompt, chosen, rejected, chosen_spans, rejected_spans) of each pair: one row, or one
    for each `longest` characters of its longest part. Spans are [start, end) of trained characters of the whole part."""
    said = F.struct("turn", "place", "rendered", "start_char", "end_char", "trained")
    of = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, said))).alias(p)
    grouped = parts.groupBy("pair_id", F.floor(F.col("start_char") / longest).alias("piece")).agg(*map(of, ("prompt", "chosen", "rejected")))
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "").alias(p)
    spans = lambda p: F.transform(F.filter(p, lambda x: x["trained"]), lambda x: F.array(x["start_char"], x["end_char"])).alias(f"{p}_spans")
    return grouped.select("pair_id", "piece", text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, role, text,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
d AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.turn, r.turn) * 1000000 + coalesce(c.place, r.place)) AS first
  FROM (SELECT * FROM t WHERE chosen) c FULL JOIN (SELECT * FROM t WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.place = r.place
  WHERE c.pair_id IS NULL OR r.pair_id IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
p AS (SELECT t.*, d.first IS NULL OR t.turn * 1000000 + t.place < d.first AS common,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM t LEFT JOIN d USING (pair_id)),
q AS (SELECT *, CASE WHEN common THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part FROM p WHERE chosen OR NOT common),
s AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, place) AS BIGINT) AS end_char FROM q),
e AS (SELECT *, (end_char - length(rendered)) // 1000000 AS piece, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN concat(end_char - length(rendered), '-', end_char) END AS span FROM s)
SELECT pair_id, piece, coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, place) FILTER (part = 'chosen'), '') AS chosen_spans, coalesce(string_agg(span, ',' ORDER BY turn, place) FILTER (part = 'rejected'), '') AS rejected_spans
FROM e GROUP BY 1, 2
"""
