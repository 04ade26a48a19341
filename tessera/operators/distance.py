"""Exact Voronoi expansion of labels, on flat or toroidal grids.

Separable: one pass an axis. Small images take one shuffle by image and run all
passes in a kernel, some images at a time; above `dense_limit` pixels each axis is its own shuffle, by
blocks of lines, so one huge image is spread too. Either way the last axis goes
first and ties fall the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.offsets import offsets

from .adjacency import COSTS, boundary_of, face_count, pair_rows, reduce_boundary
from .images import CELLS, in_order, map_stacks, rows_of, schema_of, stacks


def _metric(p: int | str) -> int:
    found = {"l1": 1, "l2": 2, 1: 1, 2: 2}.get(p.lower() if isinstance(p, str) else p)
    if found is None:
        raise ValueError("p must be 1 or 2")
    return found


def checked(p: int | str, mode: str) -> tuple[int, str]:
    if mode not in ("standard", "clean"):
        raise ValueError("mode must be standard or clean")
    return _metric(p), mode


def expand_labels(
    pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], p: int | str = 2, wrap: bool = False,
    mode: str = "standard", dense_limit: int = 1 << 24,
) -> DataFrame:
    """Every pixel of each image that has a label: label, d (int: squared for p = 2).
    mode="clean" gives labels alone, without stubs and bridges, and ignores wrap."""
    p, mode = checked(p, mode)
    pixels = pixels.where("label > 0")
    if mode == "clean":

        def clean(ids: np.ndarray, lab: np.ndarray) -> pa.Table:
            out = kernels.expand_clean(lab, p, stack=True)
            return rows_of(ids, out, axes, label=out)

        return map_stacks(pixels, axes, shape, clean, schema_of(axes))
    if math.prod(shape) <= dense_limit:

        def run(ids: np.ndarray, lab: np.ndarray) -> pa.Table:
            out, dist = kernels.expand(lab, p, wrap, stack=True)
            return rows_of(ids, out, axes, label=out, d=dist)

        return map_stacks(pixels, axes, shape, run, schema_of(axes, "label long, d long"))
    now = pixels.withColumn("d", F.lit(0).cast("long"))
    for k in reversed(range(len(axes))):
        now = _pass(now, axes, shape, k, p, wrap)
    return now


def _pass(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], k: int, p: int, wrap: bool, lines: int = 256) -> DataFrame:
    """One axis, by blocks of lines: sparse sources in, whole lines out."""
    others = [a for a in axes if a != axes[k]]

    def swept(ids: np.ndarray, group: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
        key = group
        for a in others:
            key = key * shape[axes.index(a)] + columns[a]
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        lab, dist = np.zeros((shape[k], len(first)), np.int64), np.full((shape[k], len(first)), kernels.FAR)
        spot = columns[axes[k]], at
        lab[spot], dist[spot] = columns["label"], columns["d"]
        (kernels.sweep_l2 if p == 2 else kernels.sweep_l1)(dist, lab, 0, wrap)
        i, j = np.nonzero(lab)
        cols = {axes[k]: i} | {a: columns[a][first][j] for a in others}
        return pa.table({"image_id": ids[group[first]][j]} | {a: cols[a] for a in axes} | {"label": lab[i, j], "d": dist[i, j]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in stacks(batches, 2):
            columns = {c: table.column(c).to_numpy() for c in (*axes, "label", "d")}
            ids, size = table.column("image_id").to_numpy()[begin], np.diff(begin, append=table.num_rows)
            most = max(1, CELLS // (int(size.max()) * shape[k]))  # a line has a pixel at least
            most = max(most, CELLS // math.prod(shape))
            for i in range(0, len(begin), most):
                rows = slice(begin[i], begin[i + most] if i + most < len(begin) else table.num_rows)
                yield from swept(ids[i:], np.repeat(np.arange(len(size[i : i + most])), size[i : i + most]), {c: v[rows] for c, v in columns.items()}).to_batches()

    block = F.pmod(F.xxhash64(*others), F.lit(max(1, math.prod(shape) // shape[k] // lines))) if others else F.lit(0).cast("long")
    keyed = pixels.select("image_id", *axes, "label", "d", block.cast("long").alias("block"))
    return in_order(keyed, ("image_id", "block"), *axes, "label", "d").mapInArrow(run, schema_of(axes, "label long, d long"))


def with_distance(expanded: DataFrame, p: int = 2) -> DataFrame:
    """Adds distance as a double: the root for p = 2."""
    return expanded.withColumn("distance", F.sqrt("d") if p == 2 else F.col("d").cast("double"))


def reduce_expanded(
    pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], conn: int = 1, radius: int = 1, p: int = 2, wrap: bool = False, min_contact: int = 1, dense_limit: int = 1 << 24,
) -> DataFrame:
    """reduce_boundary() of the expanded labels. Images of up to dense_limit pixels are
    expanded and reduced by one kernel, so that their expansion is never exchanged."""
    if math.prod(shape) > dense_limit:
        return reduce_boundary(expand_labels(pixels, axes, shape, p, wrap, dense_limit=dense_limit), axes, conn, radius, wrap, shape, min_contact)
    metric, table = _metric(p), offsets(len(axes), conn, radius)

    def run(ids: np.ndarray, lab: np.ndarray) -> pa.Table:
        names, code = np.unique(lab, return_inverse=True)
        out, dist = kernels.expand(code.reshape(lab.shape) + int(names[0] != 0), metric, wrap, stack=True)
        names = names[names != 0]
        group, a, b, cost = kernels.touching(out, table, wrap, dist)
        return pair_rows(ids, len(names) + 1, names, group, a, b, cost)

    return boundary_of(map_stacks(pixels.where("label > 0"), axes, shape, run, COSTS), min_contact)


def per_class_min(pixels: DataFrame, class_of: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], p: int = 2, wrap: bool = False) -> DataFrame:
    """class_of: label, class (0 leaves a label out). For each image and class that
    has pixels, the distance of every pixel to it (others are infinitely far: absent)."""
    own = pixels.join(class_of.where("class > 0"), "label").select("image_id", *axes, F.col("class").alias("label"))

    def run(ids: np.ndarray, lab: np.ndarray) -> pa.Table:
        parts = []
        for c in np.unique(lab[lab > 0]).tolist():
            out, dist = kernels.expand(np.where(lab == c, c, 0), p, wrap, stack=True)
            root = np.sqrt(dist.astype(float)) if p == 2 else dist.astype(float)
            parts.append(rows_of(ids, out, axes, **{"class": out, "distance": root}))
        return pa.concat_tables(parts)

    return map_stacks(own, axes, shape, run, schema_of(axes, "class long, distance double"))


def nearest_pairs(pixels: DataFrame, axes: tuple[str, ...], p: int = 2, wrap: bool = False, shape=None) -> DataFrame:
    """image_id, lo, hi, distance: the least pixel distance of any two labels of an
    image. Only border pixels (with a face neighbour of another label or none) can be
    nearest, so only they meet: those of some labels at a time with all of larger ones."""
    count = face_count(pixels, axes, shape, wrap)
    rim = count.where(F.col("n") < 2 * len(axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in stacks(batches, 1):
            ids, label = table.column("image_id").to_numpy(), table.column("label").to_numpy()
            pos = np.stack([table.column(a).to_numpy() for a in axes])
            for i, j in zip(begin, [*begin[1:], table.num_rows], strict=True):
                order = np.argsort(label[i:j], kind="stable") + i
                for lo, hi, d in kernels.nearest(label[order], pos[:, order], p, shape if wrap else None):
                    yield pa.RecordBatch.from_pydict({"image_id": np.full(len(lo), ids[i]), "lo": lo, "hi": hi, "d": d})

    least = in_order(rim, ("image_id",), *axes, "label").mapInArrow(run, "image_id long, lo long, hi long, d long")
    return least.select("image_id", "lo", "hi", (F.sqrt("d") if p == 2 else F.col("d").cast("double")).alias("distance"))
