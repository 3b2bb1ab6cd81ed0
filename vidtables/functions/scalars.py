"""Times, frames, rates and sizes as column functions."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"

# Usual rates as fractions, in the order in which they are tried.
RATES = [
    (23.976, "24000/1001"),
    (24.0, "24/1"),
    (25.0, "25/1"),
    (29.97, "30000/1001"),
    (30.0, "30/1"),
    (50.0, "50/1"),
    (59.94, "60000/1001"),
    (60.0, "60/1"),
]


def number(text: Column) -> Column:
    """A decimal number, null for any other text."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def whole(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), F.trim(text).try_cast("bigint")).try_cast("int")


def parse_time(text: Column) -> Column:
    """Seconds of "90", "1:30" or "0:01:30.5"; null for other shapes."""
    part = F.split(text, ":")
    at = lambda i: F.get(part, F.lit(i))
    two = whole(at(0)) * 60 + number(at(1))
    three = whole(at(0)) * 3600 + whole(at(1)) * 60 + number(at(2))
    return F.when(F.size(part) == 1, number(text)).when(F.size(part) == 2, two).when(F.size(part) == 3, three)


def time_to_frame(seconds: Column, fps: Column) -> Column:
    return (seconds * fps).cast("int")


def frame_to_time(frame: Column, fps: Column) -> Column:
    """MM:SS.mmm, with hours only from one hour on; null without a frame or a rate."""
    total = frame / fps
    hours, minutes = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600.0)) / 60)
    tail = F.format_string("%02d:%06.3f", minutes, F.pmod(total, F.lit(60.0)))
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), tail)).when(total.isNotNull(), tail)


def format_duration(seconds: Column) -> Column:
    """MM:SS or HH:MM:SS, cut to seconds; null for null."""
    s = F.floor(seconds)
    tail = F.format_string("%02d:%02d", F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600)), tail)).when(s.isNotNull(), tail)


def fps_parse(text: Column) -> Column:
    """A rate "num/den" or "num"; 30 where it is unusable, not positive or over 240."""
    part = F.split(text, "/")
    num, den = number(F.get(part, F.lit(0))), number(F.get(part, F.lit(1)))
    value = F.when(F.size(part) == 2, F.when(den != 0, num / den)).when(F.size(part) == 1, num)
    return F.when((value > 0) & (value <= 240), value).otherwise(30.0)


@F.pandas_udf(T.StringType())
def _fraction(fps: pd.Series) -> pd.Series:
    def one(x: float) -> str | None:
        if pd.isna(x):
            return None
        f = Fraction(x).limit_denominator(10000)
        return f"{f.numerator}/{f.denominator}"

    return fps.map({x: one(x) for x in fps.unique()})


def fps_snap(fps: Column) -> Column:
    """The usual rate within 0.01, first in order; null if there is none."""
    return F.coalesce(*[F.when(F.abs(fps - rate) < 0.01, text) for rate, text in RATES])


def fps_rational(df, fps_col: str = "fps"):
    """df with fps_rational; rates that aren't usual become fractions, each distinct rate once."""
    rates = df.select(F.col(fps_col).alias("_fps")).distinct()
    odd = rates.where(fps_snap(F.col("_fps")).isNull()).select("_fps", _fraction("_fps").alias("_text"))
    joined = df.join(odd, F.col(fps_col).eqNullSafe(F.col("_fps")), "left")
    return joined.withColumn("fps_rational", F.coalesce(fps_snap(F.col(fps_col)), "_text")).drop("_fps", "_text")


def resolution_parse(text: Column, width: int = 256, height: int = 256) -> Column:
    """(width, height) of "WxH", the given size where there is no x."""
    part = F.split(text, "x")
    ok = F.coalesce(F.size(part) == 2, F.lit(False)) & whole(F.get(part, F.lit(0))).isNotNull() & whole(F.get(part, F.lit(1))).isNotNull()
    return F.struct(F.when(ok, whole(F.get(part, F.lit(0)))).otherwise(width).alias("width"), F.when(ok, whole(F.get(part, F.lit(1)))).otherwise(height).alias("height"))


def resolution_even(width: Column, height: Column) -> Column:
    """The nearest even size, halves to even; (0, 0) unless both are positive."""
    ok = (width > 0) & (height > 0)
    even = lambda x: F.when(ok, F.bround(x / 2) * 2).otherwise(0).cast("int")
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def decision(sim: Column, t: Column, stability: Column) -> Column:
    """act, hold or none for a matched detection."""
    act = (sim > t + 0.03) | ((sim > t) & (stability >= 1)) | ((sim > t - 0.03) & (stability >= 2))
    return F.when(act, "act").when(sim > t - 0.03, "hold").otherwise("none")


def adaptive_threshold(t: Column, history: Column, variance: Column, mean: Column, origin: Column, trend: Column, tolerance: Column) -> Column:
    """The score that a candidate needs, from features of a track.

    history: vectors held; variance and mean: of its positive step similarities; origin: the
    candidate's similarity to the first vector; trend: origin less the mean of the last three
    such similarities; tolerance: near misses in a row.
    """
    base = F.greatest(t, F.lit(0.18))
    by_steps = F.when(variance > 0.02, base * 0.85).when(variance > 0.01, base * 0.90).when(mean < base + 0.03, base * 0.93).otherwise(base)
    steps = F.when((history >= 5) & variance.isNotNull(), by_steps).otherwise(base)
    near = F.when(origin > steps + 0.1, steps * 0.8).when(origin > steps + 0.05, steps * 0.85).otherwise(steps)
    near = F.when(trend > 0.03, near * 0.85).otherwise(near)
    by_origin = F.when((history >= 3) & (origin > 0), near).otherwise(steps)
    easy = F.when(tolerance >= 2, by_origin * (1 - F.least(F.lit(0.15), tolerance * 0.03))).otherwise(by_origin)
    return F.greatest(easy, F.lit(0.15))


def accepts(base: Column, threshold: Column, stability: Column) -> Column:
    """Whether a score is enough for a track of some stability."""
    levels = ((0.03, 0), (0.0, 1), (-0.03, 2), (-0.06, 3))
    out = F.lit(False)
    for margin, least in levels:
        out = out | ((base >= threshold + margin) & (stability >= least))
    return (base >= 0) & out
