"""Components and region statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels

from .images import columns_of, joined, map_images, schema_of


def connected_components(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], conn: int = 2, per_label: bool = False) -> DataFrame:
    """Pixels with component, numbered in raster order of first pixels; with
    per_label only equal labels connect, and label is kept."""
    if not 1 <= conn <= len(axes):
        raise ValueError(f"conn must be within 1..{len(axes)}")

    def run(image_id: int, lab: np.ndarray) -> pa.Table:
        comp, _ = kernels.components(lab if per_label else (lab != 0).astype(np.int64), conn)
        return columns_of(image_id, comp, axes, label=lab, component=comp)

    return map_images(pixels, axes, shape, run, schema_of(axes, "label long, component long"))


def component_counts(components: DataFrame) -> DataFrame:
    return components.groupBy("image_id").agg(F.max("component").alias("n"))


def regionprops(pixels: DataFrame, axes: tuple[str, ...], n_labels: int = 0) -> DataFrame:
    """image_id, label, area, and per axis min_, max_ (exclusive), centroid_. All of
    1..n (n_labels, or the image's largest label) are there; absent ones are zero."""
    stats = [F.count(F.lit(1)).alias("area")]
    for a in axes:
        stats += [F.min(a).alias(f"min_{a}"), (F.max(a) + 1).alias(f"max_{a}"), F.avg(a).alias(f"centroid_{a}")]
    own = pixels.where("label > 0").groupBy("image_id", "label").agg(*stats)
    top = F.lit(n_labels).cast("long") if n_labels else F.max("label")
    every = own.groupBy("image_id").agg(top.alias("n")).select("image_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("label"))
    return joined(every, own, ["image_id", "label"], "left").na.fill(0)


def geometry(pixels: DataFrame, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Centroid, area, major axis and eccentricity from second moments (2-D). Fewer
    than three pixels: axis (1, 0), eccentricity 0; eigenvalues are at least 1e-6."""
    y, x = axes
    m = pixels.where("label > 0").groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"),
        F.avg(F.col(y) * F.col(y)).alias("yy"), F.avg(F.col(x) * F.col(x)).alias("xx"), F.avg(F.col(y) * F.col(x)).alias("yx"),
    )
    m = m.withColumns({"a": F.expr("yy - cy * cy"), "b": F.expr("yx - cy * cx"), "c": F.expr("xx - cx * cx")})
    m = m.withColumn("root", F.expr("sqrt((a - c) * (a - c) / 4 + b * b)"))
    m = m.withColumns({"big": F.expr("greatest((a + c) / 2 + root, 1e-6D)"), "small": F.expr("greatest((a + c) / 2 - root, 1e-6D)")})
    turn = F.expr("0.5 * atan2(2 * b, a - c)")
    return m.select(
        "image_id", "label", "area", "cy", "cx",
        F.when(F.col("area") < 3, 1.0).otherwise(F.cos(turn)).alias("axis_y"), F.when(F.col("area") < 3, 0.0).otherwise(F.sin(turn)).alias("axis_x"),
        F.when(F.col("area") < 3, 0.0).otherwise(F.expr("sqrt(1 - small / big)")).alias("eccentricity"),
    )


def color_balance(colors: DataFrame) -> DataFrame:
    """How evenly colors are used: for each image the number of colors, the spread
    (largest less smallest count) and the population deviation of their cell counts."""
    n = colors.groupBy("image_id", "color").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_colors"), (F.max("n") - F.min("n")).alias("spread"), F.stddev_pop("n").alias("deviation")
    )
