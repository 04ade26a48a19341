"""Spur and bridge removal: fixpoints over an image, run as per-image kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels

from .images import columns_of, joined, map_images, per_image, schema_of


def delete_spurs(
    pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], hole_threshold: int = 5, mode: str = "cardinal",
    threshold: int | None = None, max_iter: int = -1, kind: str = "auto", max_iters: int | None = None, remove_thin: bool = False,
) -> DataFrame:
    """kind="binary": fill holes of at most hole_threshold pixels, prune pixels with 1
    to threshold - 1 neighbours; label 1 where the mask stays. kind="labels": zero
    pixels with at most threshold (1) same-label faces, at most max_iters (20) rounds,
    bridges in the first with remove_thin. kind="auto": binary for an image (or a
    relation of booleans) without a label above 1, else labels."""
    if mode not in ("cardinal", "total"):
        raise ValueError("mode must be cardinal or total")
    if kind not in ("auto", "binary", "labels"):
        raise ValueError("kind must be auto, binary or labels")
    if kind == "binary" and remove_thin:
        raise ValueError("remove_thin is for labels")
    rounds = max_iters if max_iters is not None else 20 if max_iter == -1 else max_iter
    least = 1 if threshold is None else threshold

    def run(image_id: int, lab: np.ndarray) -> pa.Table:
        if kind == "binary" or kind == "auto" and lab.max(initial=0) <= 1:
            if remove_thin:
                raise ValueError("remove_thin is for labels")
            out = kernels.spurs_binary(lab > 0, hole_threshold, mode, threshold, max_iter)
        else:
            out = kernels.spurs_labels(lab, least, rounds, remove_thin)
        return columns_of(image_id, out, axes, label=out.astype(np.int64))

    return map_images(pixels.withColumn("label", F.col("label").cast("long")), axes, shape, run, schema_of(axes))


def core(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], threshold: int = 1) -> DataFrame:
    """The (threshold + 1)-core of each label's face graph."""
    return per_image(pixels, axes, shape, "peel", threshold=threshold)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, n_removed."""
    a = before.groupBy("image_id").agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy("image_id").agg(F.count(F.lit(1)).alias("b"))
    return joined(a, b, "image_id", "left").select("image_id", (F.col("a") - F.coalesce("b", F.lit(0))).alias("n_removed"))
