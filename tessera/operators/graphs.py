"""Graph utilities on edge relations (image_id, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import joined


def symmetric(edges: DataFrame, *values: str) -> DataFrame:
    """image_id, u, v and the given columns, in both directions."""
    ways = [edges.select("image_id", F.col(a).alias("u"), F.col(b).alias("v"), *values) for a, b in (("lo", "hi"), ("hi", "lo"))]
    return ways[0].union(ways[1])


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """image_id, u, near: sorted neighbours."""
    return symmetric(edges).groupBy("image_id", "u").agg(F.sort_array(F.collect_set("v")).alias("near"))


def two_hop(edges: DataFrame) -> DataFrame:
    """image_id, u, v: vertices at distance exactly two, both directions."""
    s = symmetric(edges).distinct()
    first, second = s.withColumnRenamed("v", "m"), s.withColumnsRenamed({"u": "m"})
    two = joined(first, second, ["image_id", "m"]).where("u <> v").select("image_id", "u", "v")
    return joined(two.distinct(), s, ["image_id", "u", "v"], "left_anti")


def conflicts(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """Edges whose ends share a color (image_id, lo, hi, color)."""
    c = colors.select("image_id", "label", "color")
    one = joined(edges, c.withColumnsRenamed({"label": "lo", "color": "color"}), ["image_id", "lo"])
    two = c.withColumnsRenamed({"label": "hi", "color": "color_hi"})
    return joined(one, two, ["image_id", "hi"]).where("color = color_hi").select("image_id", "lo", "hi", "color")


def triangle_weights(edges: DataFrame) -> DataFrame:
    """image_id, lo, hi, w: one more than the number of common neighbours."""
    s = symmetric(edges).distinct()
    a, b = s.withColumnsRenamed({"u": "lo", "v": "m"}), s.withColumnsRenamed({"u": "hi", "v": "m"})
    common = joined(joined(edges.select("image_id", "lo", "hi"), a, ["image_id", "lo"]), b, ["image_id", "hi", "m"])
    n = common.groupBy("image_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return joined(edges.select("image_id", "lo", "hi"), n, ["image_id", "lo", "hi"], "left").select("image_id", "lo", "hi", (1 + F.coalesce("n", F.lit(0))).cast("long").alias("w"))


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """image_id, v1 < ... < vk: the k-cliques, grown a vertex at a time over edges from smaller to larger."""
    if k < 2:
        raise ValueError("k must be at least 2")
    e = edges.select("image_id", "lo", "hi").distinct()
    now = e.withColumnsRenamed({"lo": "v1", "hi": "v2"})
    for n in range(3, k + 1):
        now = joined(now, e.withColumnsRenamed({"lo": f"v{n - 1}", "hi": f"v{n}"}), ["image_id", f"v{n - 1}"])
        for i in range(1, n - 1):
            now = joined(now, e.withColumnsRenamed({"lo": f"v{i}", "hi": f"v{n}"}), ["image_id", f"v{i}", f"v{n}"], "left_semi")
    return now.select("image_id", *[f"v{i}" for i in range(1, k + 1)])


def soft_penalty(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """image_id, n: edges with equal ends."""
    return conflicts(edges, colors).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
