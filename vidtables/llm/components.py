"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Links each vertex's larger neighbours to the least vertex around it; and how many vertices have a smaller neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
    # the least are written, so that a hub's edges meet their one row in a plain join, which Spark splits
    out = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    below = least.where("m < u").count()
    scratch.drop(least)
    return out, below


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links each vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = scratch.save(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    scratch.drop(least)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component) for each vertex of edges (u, v) that isn't the least of its component.

    Rounds go on until all are stars, about log(longest path) of them; each is written to
    the shared folder, so a lost executor costs one round. Vertices of one end only, loops and
    repeated edges are allowed.
    """
    u, v = edges.columns
    now = scratch.save(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        then, (large, below) = now, _large_star(now, scratch)
        # stars already: each edge's smaller end has no smaller neighbour, as no edge moved, and its larger end no other one
        stars = _state(large) == state and below == state[0]
        if not stars:
            now = _small_star(large, scratch)
            state = _state(now)
            scratch.drop(then)
        scratch.drop(large)
        if stars:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
