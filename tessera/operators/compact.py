"""Label compaction: background shift, ascending and first-seen renumbering, cleaning.

Plans are one aggregate per label and one window over the labels of an image, so
pixels are shuffled once, by (image, label); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .images import joined, per_image


def flat_index(axes: tuple[str, ...], shape: tuple[int, ...]) -> F.Column:
    out = F.lit(0).cast("long")
    for axis, n in zip(axes, shape, strict=True):
        out = out * n + F.col(axis)
    return out


def bounds(pixels: DataFrame) -> DataFrame:
    """image_id, low, high: the label range of each image."""
    return pixels.groupBy("image_id").agg(F.min("label").alias("low"), F.max("label").alias("high"))


def shift_background(pixels: DataFrame) -> DataFrame:
    """Where an image has negative labels its smallest becomes 0; others stay. An
    image whose pixels all are negative and equal is background throughout."""
    low = pixels.groupBy("image_id").agg(F.least(F.min("label"), F.lit(0)).alias("low"))
    return joined(pixels, low, "image_id").withColumn("label", F.col("label") - F.col("low")).drop("low")


def _numbers(pixels: DataFrame, order: F.Column) -> DataFrame:
    labels = pixels.where("label > 0").groupBy("image_id", "label").agg(order.alias("at"))
    return labels.select("image_id", "label", F.row_number().over(Window.partitionBy("image_id").orderBy("at")).cast("long").alias("new"))


def numbers(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], order_first_seen: bool = False) -> DataFrame:
    """image_id, label, new: what ascending() or first_seen() makes of each label."""
    return _numbers(pixels, F.min(flat_index(axes, shape)) if order_first_seen else F.min("label"))


def _renumber(pixels: DataFrame, order: F.Column) -> DataFrame:
    ranked = _numbers(pixels, order)
    return joined(pixels.where("label > 0"), ranked, ["image_id", "label"]).drop("label").withColumnRenamed("new", "label").select(*pixels.columns)


def ascending(pixels: DataFrame) -> DataFrame:
    """Positive labels become their rank, 1..n."""
    return _renumber(pixels, F.min("label"))


def first_seen(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...]) -> DataFrame:
    """Positive labels are numbered by their first pixel in raster order."""
    return _renumber(pixels, F.min(flat_index(axes, shape)))


def format_labels(
    pixels: DataFrame,
    axes: tuple[str, ...],
    shape: tuple[int, ...],
    clean: bool = False,
    min_area: int = 9,
    despur: bool = False,
    background: int | None = None,
    ignore: bool = False,
    order_first_seen: bool = False,
) -> DataFrame:
    """Compact labels. Unless `background` or `ignore` is given, negative labels shift
    the background. `clean`: every component (full connectivity) of at least min_area
    pixels is a label, numbered in raster order; `despur` prunes spurs first."""
    if background is None and not ignore:
        pixels = shift_background(pixels)
    if not clean:
        return first_seen(pixels, axes, shape) if order_first_seen else ascending(pixels)
    return per_image(pixels.where("label > 0"), axes, shape, "clean_labels", min_area=min_area, despur=despur)
