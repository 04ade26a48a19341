"""Runs dense kernels on the images of a pixel relation.

Rows are dealt by image, unless they lie so already, and stream through a worker as
Arrow batches; a kernel gets a stack of several small images (or one large one) at a
time. Memory is that of one stack; images are independent, so a batch scales with
executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import kernels

#: Cells of one stack, rows that are gathered for stacks.
CELLS, ROWS = 1 << 17, 1 << 15


def dense(table: pa.Table, axes: tuple[str, ...], shape: tuple[int, ...], column: str = "label") -> np.ndarray:
    out = np.zeros(shape, np.int64)
    out[tuple(table.column(a).to_numpy() for a in axes)] = table.column(column).to_numpy()
    return out


def columns_of(image_id: int, mask: np.ndarray, axes: tuple[str, ...], **values: np.ndarray) -> pa.Table:
    at = np.nonzero(mask)
    cols = {"image_id": np.full(len(at[0]), image_id)} | {a: p.astype(np.int64) for a, p in zip(axes, at, strict=True)}
    return pa.table(cols | {k: v[at] for k, v in values.items()})


@lru_cache(maxsize=4)
def _grid(shape: tuple[int, ...], n: int) -> tuple[np.ndarray, ...]:
    """Coordinates of every pixel of a stack."""
    return tuple(np.ascontiguousarray(np.broadcast_to(g, (n, *shape))).reshape(-1) for g in np.indices(shape))


def rows_of(ids: np.ndarray, mask: np.ndarray, axes: tuple[str, ...], **values: np.ndarray) -> pa.Table:
    """columns_of() for a stack: ids has one id an image."""
    shape, area = mask.shape[1:], math.prod(mask.shape[1:])
    grid, flat = _grid(shape, max(1, CELLS // area)), np.flatnonzero(mask)
    full = len(flat) == mask.size
    pick = (lambda a: a.reshape(-1)[: mask.size]) if full else (lambda a: a.reshape(-1)[flat])
    image = np.repeat(ids, area) if full else ids[flat // area]
    return pa.table({"image_id": image} | {a: pick(g) for a, g in zip(axes, grid, strict=True)} | {k: pick(v) for k, v in values.items()})


def in_order(rows: DataFrame, keys: tuple[str, ...], *columns: str, first: str | None = None) -> DataFrame:
    """The rows of a key in one partition and behind one another (by the column first, if
    given). Rows that lie by some of the keys already are not exchanged, as
    repartition() would."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(first or keys[0]))
    return rows.select(*keys, *columns, nth.alias("__nth"))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by an exchange of both sides. The plan's sizes know neither of explode() nor
    of kernels that give more rows than they take, so that it would send whole tables of
    pixels, labels or edges through the driver as small ones."""
    return left.join(right.hint("merge"), on, how)


def stacks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal values in the leading columns) with about ROWS rows,
    or of one larger group, and where their groups begin."""

    def starts(parts: list[pa.RecordBatch], last: tuple | None = None) -> np.ndarray:
        new = None
        for k in range(keys):
            v = np.concatenate([p.column(k).to_numpy() for p in parts])
            change = np.concatenate([[last is None or v[0] != last[k]], v[1:] != v[:-1]])
            new = change if new is None else new | change
        return np.flatnonzero(new)

    parts: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = starts([batch], last)
        last = tuple(batch.column(k)[-1].as_py() for k in range(keys))
        if rows >= ROWS and len(begin):
            table = pa.Table.from_batches([*parts, batch.slice(0, begin[0])])
            if table.num_rows:
                yield table, starts(table.to_batches())
            batch = batch.slice(begin[0])
            parts, rows = [], 0
        parts.append(batch)
        rows += batch.num_rows
    if parts:
        yield pa.Table.from_batches(parts), starts(parts)


def map_stacks(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], f: Callable, schema: str, marks: bool = False, more: DataFrame | None = None) -> DataFrame:
    """f(ids, stack of dense labels) gives an Arrow table in the schema's order. With marks,
    f gets two further arguments: which pixels are there, and the rows of more (image_id,
    a, b, hard; those of images with pixels) with the image's number as n."""
    area = math.prod(shape)
    most, linked = max(1, CELLS // area), more is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in stacks(batches, 1):
            ids = table.column("image_id").to_numpy()[begin]
            of = np.repeat(np.arange(len(begin)), np.diff(begin, append=table.num_rows))
            flat = np.zeros(table.num_rows, np.int64)
            for a, n in zip(axes, shape, strict=True):
                v = table.column(a).to_numpy()
                if len(v) and (v.min() < 0 or v.max() >= n):
                    raise IndexError(f"{a} is beyond the shape {shape}")
                flat = flat * n + v
            label = table.column("label").to_numpy()
            for i in range(0, len(begin), most):
                rows = slice(begin[i], begin[i + most] if i + most < len(begin) else table.num_rows)
                own, at = ids[i : i + most], flat[rows] + (of[rows] - i) * area
                lab = np.zeros((len(own), *shape), np.int64)
                lab.reshape(-1)[at] = label[rows]
                rest = ()
                if marks:
                    mask = np.zeros(lab.shape, bool)
                    mask.reshape(-1)[at] = True
                    lists = table.column("more").take(pa.array(begin[i : i + most])).to_pylist() if linked else []
                    rest = mask, [{"n": k} | r for k, found in enumerate(lists) for r in found or []]
                yield from f(own, lab, *rest).to_batches()

    rows = in_order(pixels, ("image_id",), *axes, "label")
    if linked:  # with the first pixel of its image
        lists = more.groupBy("image_id").agg(F.collect_list(F.struct("a", "b", "hard")).alias("more"))
        rows = joined(rows, lists, "image_id", "left").withColumn("more", F.when(F.col("__nth") == 1, F.col("more")))
        rows = in_order(rows.drop("__nth").withColumn("own", F.col("more").isNull()), ("image_id",), *axes, "label", "more", first="own")
    return rows.mapInArrow(run, schema)


def map_images(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], f: Callable, schema: str) -> DataFrame:
    """f(image_id, dense labels) gives an Arrow table in the schema's order."""

    def run(table: pa.Table) -> pa.Table:
        return f(table.column("image_id")[0].as_py(), dense(table, axes, shape))

    return pixels.select("image_id", *axes, "label").groupBy("image_id").applyInArrow(run, schema)


def whole(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...]) -> DataFrame:
    """Every pixel of each image, with label 0 on the background."""
    return map_stacks(pixels, axes, shape, lambda ids, lab: rows_of(ids, np.ones(lab.shape, bool), axes, label=lab), schema_of(axes))


def schema_of(axes: tuple[str, ...], rest: str = "label long") -> str:
    return ", ".join(["image_id long", *[f"{a} long" for a in axes], rest])


def per_image(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], kernel: str, **parameters) -> DataFrame:
    """A kernel from labels to labels; background is dropped."""

    def run(image_id: int, lab: np.ndarray) -> pa.Table:
        out = getattr(kernels, kernel)(lab, **parameters)
        out = out[0] if isinstance(out, tuple) else out
        return columns_of(image_id, out, axes, label=out.astype(np.int64))

    return map_images(pixels, axes, shape, run, schema_of(axes))
