"""Region adjacency: which labels touch, how often and how near.

Pixels are dealt by image and tile, each tile with a border of the width the offsets
reach, and a kernel looks around its own pixels in a dense window. So no pixel is
copied for an offset, tables of pixels are never joined, and the memory of a tile is
bounded whatever the image's size. Pairs leave a tile reduced; the tiles' parts are
added up by hash aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.offsets import offsets

from .images import in_order, schema_of, stacks

#: How a boundary statistic becomes a weight.
MODES = ("min", "max", "mean", "count", "harmonic", "mean_inv")


def mode_of(mode: str | int) -> str:
    """A mode by its name, another spelling of it, or its number (from 1; 0 is "off");
    unknown ones mean min."""
    if not isinstance(mode, str):
        mode = ("off", *MODES)[mode] if 0 <= mode <= len(MODES) else "min"
    name = mode.lower()
    name = "mean_inv" if name == "meaninv" else name
    return name if name == "off" or name in MODES else "min"


#: Cells of a tile (a power of two), and of the windows that are held at a time.
TILE_BITS, WINDOW = 18, 1 << 20


def _tiles(pixels: DataFrame, axes: tuple[str, ...], reach: int, shape: tuple[int, ...] | None, wrap: bool, columns: tuple[str, ...]) -> DataFrame:
    """image_id, t0..., axes, own, columns: the pixels of each tile (own) and those within
    reach of it; on a torus also as seen across the border."""
    if wrap and shape is None:
        raise ValueError("a torus needs the shape")
    bits = TILE_BITS // len(axes)
    px = pixels.select("image_id", *axes, *columns, F.lit(True).alias("own"))
    if wrap:
        for a, n in zip(axes, shape, strict=True):
            px = px.withColumn("far", F.explode(F.expr(f"sequence(CAST(ceil((-{reach} - {a}) / {n}) AS INT), CAST(floor(({n + reach - 1} - {a}) / {n}) AS INT))")))
            px = px.withColumns({a: F.col(a) + F.col("far") * n, "own": F.col("own") & (F.col("far") == 0)}).drop("far")
    for k, a in enumerate(axes):
        px = px.withColumn(f"t{k}", F.explode(F.expr(f"sequence(shiftright({a} - {reach}, {bits}), shiftright({a} + {reach}, {bits}))")))
        px = px.withColumn("own", F.col("own") & (F.col(f"t{k}") == F.shiftright(a, bits)))
    return in_order(px, ("image_id", *[f"t{k}" for k in range(len(axes))]), *axes, "own", *columns)


class Window:
    """Dense windows of some tiles: own pixels look around in them. Labels are small
    numbers from 1 (0 is none), names[k - 1] is the label."""

    def __init__(self, table: pa.Table, groups: np.ndarray, at: np.ndarray, extent: tuple[int, ...], code: np.ndarray, names: np.ndarray):
        own = table.column("own").to_numpy()
        self.names, self.width = names, len(names) + 1
        self.step = [math.prod(extent[k + 1 :]) for k in range(len(extent))]
        flat = groups * math.prod(extent) + sum(a * s for a, s in zip(at, self.step, strict=True))
        self.label = np.zeros((groups[-1] + 1) * math.prod(extent), np.int32)
        self.label[flat] = code
        self.d = None
        if "d" in table.column_names:
            self.d = np.zeros(len(self.label), np.int64)
            self.d[flat] = table.column("d").to_numpy()
        self.flat, self.group, self.code, self.own = flat[own], groups[own], code[own], own

    def near(self, off: tuple[int, ...]) -> np.ndarray:
        return self.flat + sum(o * s for o, s in zip(off, self.step, strict=True))


def _windows(table: pa.Table, begin: np.ndarray, axes: tuple[str, ...], reach: int) -> Iterator[tuple[pa.Table, np.ndarray, Window]]:
    """Some tiles at a time: their rows, their image ids, their windows."""
    size = np.diff(begin, append=table.num_rows)
    of = np.repeat(np.arange(len(begin)), size)
    pos = np.stack([table.column(a).to_numpy() for a in axes]).astype(np.int64)
    pos -= np.minimum.reduceat(pos, begin, axis=1)[:, of] - reach
    extent = tuple(int(n) + 1 + reach for n in pos.max(axis=1))
    label = table.column("label").to_numpy()
    low, high = int(label.min()), int(label.max())
    names = np.arange(low, high + 1) if high - low < 1 << 16 else np.unique(label)
    code = (label - low if high - low < 1 << 16 else np.searchsorted(names, label)) + 1
    ids, most = table.column("image_id").to_numpy()[begin], max(1, WINDOW // math.prod(extent))
    for i in range(0, len(begin), most):
        j = min(i + most, len(begin))
        rows = slice(begin[i], begin[j - 1] + size[j - 1])
        part = table.slice(rows.start, rows.stop - rows.start)
        yield part, ids[i:j], Window(part, of[rows] - i, pos[:, rows], extent, code[rows], names)


def _by_tile(pixels: DataFrame, axes: tuple[str, ...], reach: int, f: Callable, schema: str, shape: tuple[int, ...] | None = None, wrap: bool = False, columns: tuple[str, ...] = ("label",)) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in stacks(batches, 1 + len(axes)):
            for part in _windows(table, begin, axes, reach):
                yield from f(*part).to_batches()

    return _tiles(pixels, axes, reach, shape, wrap, columns).mapInArrow(run, schema)


def pair_rows(ids: np.ndarray, width: int, names: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray | None = None, flag: np.ndarray | None = None) -> pa.Table:
    """One row for each image and pair of labels: contact; with costs their low, high,
    total and harmonic; with flags whether one is true and one is false. a and b are
    numbers from 1, below width, of names."""
    code = (group.astype(np.int64) * width + np.minimum(a, b)) * width + np.maximum(a, b)
    order = None
    if cost is None and flag is None:
        found, count = np.unique(code, return_counts=True)
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
        found, count = code[first], np.diff(first, append=len(code))
    cols = {"image_id": ids[found // (width * width)], "lo": names[found // width % width - 1], "hi": names[found % width - 1], "contact": count}
    if cost is not None:
        cost, some = cost[order], len(first) > 0
        fold = lambda f, v: f.reduceat(v, first) if some else v[:0]
        cols |= {"low": fold(np.minimum, cost), "high": fold(np.maximum, cost), "total": fold(np.add, cost), "harmonic": fold(np.add, 1.0 / (1 + cost))}
    if flag is not None:
        some = np.add.reduceat(flag[order].astype(np.int64), first) if len(first) else count
        cols |= {"is_hard": some > 0, "is_soft": some < count}
    return pa.table(cols)


PAIR = "image_id long, lo long, hi long, contact long"
COSTS = PAIR + ", low long, high long, total long, harmonic double"


def _touching(window: Window, table: list[tuple], n: int) -> tuple[np.ndarray, ...]:
    """Group, both labels, the cost (sum of both ends' d) and the number of the offset, for
    every pair of pixels of two labels."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    for k, o in enumerate(table):
        to = window.near(o[:n])
        other = window.label[to]
        at = np.flatnonzero((other > 0) & (other != window.code))
        cost = window.d[window.flat[at]] + window.d[to[at]] if window.d is not None else at[:0]
        for have, more in zip(out, (window.group[at], window.code[at], other[at].astype(np.int64), cost, np.full(len(at), k)), strict=True):
            have.append(more)
    return tuple(np.concatenate(x) for x in out)


def _pairs(pixels: DataFrame, axes: tuple[str, ...], table: list[tuple], wrap: bool, shape, kind: str) -> DataFrame:
    """Parts of pairs by tile: PAIR, COSTS for "cost", PAIR and is_hard, is_soft for "flag"
    (the offsets' last field)."""
    n = len(axes)
    hard = np.array([bool(o[-1]) for o in table])

    def run(part: pa.Table, ids: np.ndarray, window: Window) -> pa.Table:
        group, a, b, cost, k = _touching(window, table, n)
        return pair_rows(ids, window.width, window.names, group, a, b, cost if kind == "cost" else None, hard[k] if kind == "flag" else None)

    reach = max(abs(v) for o in table for v in o[:n])
    schema = COSTS if kind == "cost" else PAIR + (", is_hard boolean, is_soft boolean" if kind == "flag" else "")
    return _by_tile(pixels.where("label > 0"), axes, reach, run, schema, shape, wrap, ("label", "d") if kind == "cost" else ("label",))


def connect(
    pixels: DataFrame, axes: tuple[str, ...], conn: int = 1, radius: int = 1, wrap: bool = False,
    shape: tuple[int, ...] | None = None, min_contact: int = 1, extra_edges: DataFrame | None = None,
) -> DataFrame:
    """image_id, lo, hi, contact: label pairs within reach and their number of pixel
    pairs, at least min_contact; extra_edges (image_id, a, b) join with contact 0."""
    parts = _pairs(pixels, axes, offsets(len(axes), conn, radius), wrap, shape, "plain")
    edges = parts.groupBy("image_id", "lo", "hi").agg(F.sum("contact").alias("contact")).where(F.col("contact") >= min_contact)
    if extra_edges is None:
        return edges
    more = extra_edges.where("a > 0 AND b > 0 AND a <> b").select("image_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(0).cast("long").alias("contact"))
    return edges.union(more).groupBy("image_id", "lo", "hi").agg(F.max("contact").alias("contact"))


def hard_and_soft(pixels: DataFrame, axes: tuple[str, ...], hard: tuple[int, int] = (1, 1), soft: tuple[int, int] = (2, 2), wrap: bool = False, shape=None) -> DataFrame:
    """image_id, lo, hi, is_hard, is_soft, from one scan of both neighbourhoods: hard
    ones, and those of the soft window outside it. A pair may be both. Connectivities
    beyond the number of axes mean all of them."""
    n = len(axes)
    base = set(offsets(n, min(hard[0], n), hard[1]))
    wide = set(offsets(n, min(soft[0], n), soft[1])) - base
    table = [(*o, True) for o in sorted(base)] + [(*o, False) for o in sorted(wide)]
    parts = _pairs(pixels, axes, table, wrap, shape, "flag")
    return parts.groupBy("image_id", "lo", "hi").agg(F.max("is_hard").alias("is_hard"), F.max("is_soft").alias("is_soft"))


def boundary_of(parts: DataFrame, min_contact: int = 1) -> DataFrame:
    """COSTS of parts, added up: contact, low, high, mean, harmonic, mean_inv of each pair."""
    total = parts.groupBy("image_id", "lo", "hi").agg(
        F.sum("contact").alias("contact"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("harmonic").alias("harmonic")
    )
    return total.where(F.col("contact") >= min_contact).select(
        "image_id", "lo", "hi", "contact", "low", "high", (F.col("total") / F.col("contact")).alias("mean"), "harmonic", (F.col("harmonic") / F.col("contact")).alias("mean_inv")
    )


def reduce_boundary(pixels: DataFrame, axes: tuple[str, ...], conn: int = 1, radius: int = 1, wrap: bool = False, shape=None, min_contact: int = 1) -> DataFrame:
    """pixels with d (distance to their cell, 0 on it). For each pair, over boundary
    pixel pairs of cost d_a + d_b: contact, low, high, mean, harmonic, mean_inv."""
    return boundary_of(_pairs(pixels, axes, offsets(len(axes), conn, radius), wrap, shape, "cost"), min_contact)


def weights(reduced: DataFrame, mode: str | int = "min") -> DataFrame:
    """image_id, lo, hi, w; mode as in mode_of."""
    by = {
        "max": 1 / (1.0 + F.col("high")), "mean": 1 / (1.0 + F.col("mean")), "count": F.col("contact").cast("double"),
        "harmonic": F.col("harmonic"), "mean_inv": F.col("mean_inv"),
    }
    return reduced.select("image_id", "lo", "hi", by.get(mode_of(mode), 1 / (1.0 + F.col("low"))).alias("w"))


def _own_rows(part: pa.Table, axes: tuple[str, ...], at: np.ndarray, **more: np.ndarray) -> pa.Table:
    """Those of a tile's own pixels, with further columns."""
    rows = part.select(["image_id", *axes, "label"]).take(pa.array(at))
    for name, v in more.items():
        rows = rows.append_column(name, pa.array(v))
    return rows


def face_count(pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...] | None = None, wrap: bool = False) -> DataFrame:
    """Pixels and n: their face neighbours of the same label."""
    table = offsets(len(axes), 1, both=True)

    def run(part: pa.Table, ids: np.ndarray, window: Window) -> pa.Table:
        n = sum((window.label[window.near(o)] == window.code).astype(np.int64) for o in table)
        return _own_rows(part, axes, np.flatnonzero(window.own), n=n)

    return _by_tile(pixels, axes, 1, run, schema_of(axes, "label long, n long"), shape, wrap)


def pairs_with_faces(pixels: DataFrame, axes: tuple[str, ...], conn: int = 2) -> tuple[DataFrame, DataFrame]:
    """Label pairs, and face counts of pixels."""
    return connect(pixels, axes, conn), face_count(pixels, axes)


def bridges_and_stubs(pixels: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Labeled pixels with at most one same-label face, or with exactly two same-label
    neighbours in the full window, both faces, opposite each other."""
    n = len(axes)
    table = offsets(n, n, both=True)

    def run(part: pa.Table, ids: np.ndarray, window: Window) -> pa.Table:
        same = [window.label[window.near(o)] == window.code for o in table]
        total = sum(s.astype(np.int64) for s in same)
        face = sum(s.astype(np.int64) for s, o in zip(same, table, strict=True) if sum(map(abs, o)) == 1)
        opposite = np.ones(len(total), bool)
        for k in range(n):
            opposite &= sum(s * o[k] for s, o in zip(same, table, strict=True)) == 0
        bad = (face <= 1) | ((face == 2) & (total == 2) & opposite)
        return _own_rows(part, axes, np.flatnonzero(window.own)[bad])

    return _by_tile(pixels, axes, 1, run, schema_of(axes))
