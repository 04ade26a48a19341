"""Connected components of an edge table, by alternating large-star and small-star
steps; every step is joins and aggregates, every round a written table that replaces
the one before. Rows with a null end are no edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """both: (u, v) rows. Links each node's neighbours that are larger than it (or,
    for the small star, that are not, and itself) to its smallest neighbour."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u").where("v > u" if larger else "v < u")
    moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.union(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Columns node, component (its smallest member). Nodes
    without an edge to another are left out. Raises if max_rounds do not suffice."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # The sums tell a round without change: a step that moves an edge lowers its smaller end.
    look = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = look(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        before, now = now, materialize(small, "edges")
        discard(before)
        after = look(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
