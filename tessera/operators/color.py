"""Coloring of label images: adjacency by joins, the search per image on its edge
list alone, colors back by a join on (image, label)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import coloring, kernels
from tessera.functions.offsets import offsets

from . import adjacency, compact, distance, graphs
from .images import joined, map_stacks

COLORS = "image_id long, label long, color int"

# Perceptual distances of the default four-color palette.
PALETTE = {(1, 2): 52.0, (1, 3): 104.74, (1, 4): 133.36, (2, 3): 56.28, (2, 4): 100.98, (3, 4): 62.58}


@dataclass
class Colored:
    """pixels: image_id, axes, color (none where the input has none). colors: the
    look-up from label to color. edges: hard ones. conflicts: per image, the number of
    hard edges with equal ends. soft: per image, soft edges with equal ends. They share
    cached tables until free() is called."""

    pixels: DataFrame
    colors: DataFrame
    edges: DataFrame
    conflicts: DataFrame
    soft: DataFrame
    n_used: DataFrame
    cached: tuple[DataFrame, ...] = ()

    def free(self) -> None:
        for table in self.cached:
            table.unpersist()

    def check(self) -> Colored:
        """Itself; raises where two neighbours share a color."""
        if self.conflicts.where("n > 0").limit(1).count():
            raise ValueError("labels that touch have equal colors")
        return self


def _search(vertices: DataFrame, edges: DataFrame, f) -> DataFrame:
    """vertices: image_id, label. f(labels, rows of edges) gives a color for each."""

    def run(own: pa.Table, linked: pa.Table) -> pa.Table:
        labels = np.sort(own.column("label").to_numpy())
        rows = linked.sort_by([("lo", "ascending"), ("hi", "ascending")]).to_pylist() if linked.num_rows else []
        at = {v: i for i, v in enumerate(labels.tolist())}
        color = f(len(labels), [(at[r["lo"]], at[r["hi"]], r) for r in rows if r["lo"] in at and r["hi"] in at])
        image = own.column("image_id")[0].as_py() if own.num_rows else 0
        return pa.table({"image_id": pa.array([image] * len(labels), pa.int64()), "label": pa.array(labels, pa.int64()), "color": pa.array(color, pa.int32())})

    # Fresh names, so that both sides may come from one relation.
    vertices = vertices.select(F.col("image_id").alias("image_id"), F.col("label").alias("label"))
    edges = edges.select(*[F.col(c).alias(c) for c in edges.columns])
    return vertices.groupBy("image_id").cogroup(edges.groupBy("image_id")).applyInArrow(run, COLORS)


def greedy_colors(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """First free color in order of falling degree, then label."""
    return _search(vertices, edges, lambda n, rows: coloring.greedy(coloring.graph_of(n, [r[:2] for r in rows])))


def _choose(n: int, hard: list, weight: dict, soft: dict, n_colors: int, max_depth: int, ndim: int, wrap: bool, palette: dict | None) -> list[int]:
    g = coloring.graph_of(n, hard)
    color = coloring.solve(g, n_colors, max_depth, ndim, wrap)
    if palette is not None:
        k = max(n_colors, max(color, default=1))
        tried = coloring.weighted(g, weight, palette, k)
        return color if coloring.conflicts(g, tried) else tried
    return coloring.soften(g, soft, color) if soft else color


def _triangles(soft: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """graphs.triangle_weights() of one image's edges."""
    near: dict[int, set] = {}
    for u, v in soft:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return {(u, v): 1.0 + len(near[u] & near[v]) for u, v in soft}


def color_graph(
    vertices: DataFrame, edges: DataFrame, n_colors: int = 4, max_depth: int = 30, ndim: int = 2, wrap: bool = False,
    palette: dict[tuple[int, int], float] | None = None,
) -> DataFrame:
    """edges: image_id, lo, hi, is_hard, is_soft, w (soft weight, by triangles if there is
    no w; with a palette, the hard edges' weight). A proper coloring of the hard edges,
    soft ones lowered."""
    given = "w" in edges.columns

    def search(n: int, rows: list) -> list[int]:
        near = {} if given else _triangles([(a, b) for a, b, r in rows if r["is_soft"]])
        hard = {(a, b): r["w"] if given else 1.0 for a, b, r in rows if r["is_hard"]}
        soft = {(a, b): float(r["w"]) if given else near[a, b] for a, b, r in rows if r["is_soft"] and not r["is_hard"]}
        return _choose(n, list(hard), hard, soft, n_colors, max_depth, ndim, wrap, palette)

    return _search(vertices, edges, search)


# Names of the objectives.
OBJECTIVES = {"max": 1, "max_contrast": 1, "sharp": 1, "min": -1, "min_contrast": -1, "soft": -1, "off": 0, "none": 0}


def objective(name: str | int) -> int:
    """1 for high contrast between neighbours, -1 for low, 0 for none; unknown names mean none."""
    return OBJECTIVES.get(name.lower(), 0) if isinstance(name, str) else (name > 0) - (name < 0)


#: What the kernel gives for each image: colors of labels (kind 0), edges (1), colored pixels
#: (2), by lists of at most LISTED of them, so that a cached table has few rows and a reader
#: of edges passes over no pixel.
_KINDS = "image_id long, kind int, lo array<long>, hi array<long>, is_hard array<boolean>, is_soft array<boolean>, color array<int>"
LISTED = 4096


def _lists(ids: np.ndarray, kind: int, image: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Columns of items, whose images (numbers) rise, as lists."""
    first = np.searchsorted(image, np.arange(len(ids) + 1))
    begin = np.flatnonzero((np.arange(len(image)) - first[image]) % LISTED == 0)
    ends = pa.array(np.append(begin, len(image)).astype(np.int32))
    return pa.table({"image_id": ids[image[begin]], "kind": np.full(len(begin), kind, np.int32)} | {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in columns.items()})


def _items(every: DataFrame, kind: int, *columns: str) -> DataFrame:
    return every.where(F.col("kind") == kind).select("image_id", F.inline(F.arrays_zip(*columns)))


def _by_image(pixels: DataFrame, more: DataFrame | None, axes: tuple[str, ...], shape: tuple[int, ...], o: dict) -> DataFrame:
    """The whole of label() for images that fit in a worker, from one exchange of pixels;
    all but the search is done for a stack of images at once."""
    n = len(axes)
    base = offsets(n, min(o["conn"], n), o["connect_radius"])
    wide = [x for x in offsets(n, min(o["soft_conn"], n), o["soft_radius"]) if x not in set(base)]

    def cells_of(lab: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Stack with the cells of each image numbered from 1, and for all cells their image
        and their name."""
        at = np.flatnonzero(mask)
        of, v = at // lab[0].size, lab.reshape(-1)[at]
        if o["format_input"]:
            low = np.zeros(len(lab), np.int64)
            np.minimum.at(low, of, v)
            v = v - low[of]
        at, of, v = at[v > 0], of[v > 0], v[v > 0]
        value, rank = np.unique(v, return_inverse=True)
        found, seen, back = np.unique(of * (len(value) + 1) + rank, return_index=True, return_inverse=True)
        image, name = found // (len(value) + 1), value[found % (len(value) + 1)]
        start = np.searchsorted(image, image)
        number = np.arange(len(found)) - start + 1
        name = number if o["format_input"] else name
        if o["format_input"] and o["first_seen"]:
            number = np.argsort(np.lexsort((seen, image))) - start + 1
        small = np.zeros(lab.shape, np.int64)
        small.reshape(-1)[at] = number[back]
        return small, image, name

    def pairs(lab: np.ndarray, table: list, width: int, least: int = 1) -> np.ndarray:
        image, lo, hi, _ = kernels.touching(lab, table, o["wrap"])
        found, count = np.unique((image * width + lo) * width + hi, return_counts=True)
        return found[count >= least]

    def weigh(small: np.ndarray, width: int) -> dict:
        """The weight of a pair, by the pair's number."""
        far = kernels.expand(small, o["p"], o["wrap"], stack=True) if o["expand"] else (small, np.zeros(small.shape, np.int64))
        image, lo, hi, cost = kernels.touching(far[0], base, o["wrap"], far[1])
        key, back, count = np.unique((image * width + lo) * width + hi, return_inverse=True, return_counts=True)
        mode = adjacency.mode_of(o["weight_mode"])
        if mode in ("min", "max"):
            w = np.full(len(key), np.inf if mode == "min" else -np.inf)
            (np.minimum if mode == "min" else np.maximum).at(w, back, cost)
            w = 1 / (1 + w)
        elif mode == "count":
            w = count.astype(float)
        else:
            w = np.bincount(back, cost if mode == "mean" else 1 / (1 + cost), len(key))
            w = 1 / (1 + w / count) if mode == "mean" else w / count if mode == "mean_inv" else w
        return {k: x for k, x, c in zip(key.tolist(), w.tolist(), count.tolist(), strict=True) if c >= o["min_contact"]}

    def run(ids: np.ndarray, lab: np.ndarray, mask: np.ndarray, extra: list) -> pa.Table:
        small, image, name = cells_of(lab, mask)
        grown, begin = small, np.searchsorted(image, np.arange(len(ids) + 1))
        if o["expand"]:
            grown = kernels.expand_clean(small, o["p"], stack=True) if o["expand_mode"] == "clean" else kernels.expand(small, o["p"], o["wrap"], stack=True)[0]
        width = int(np.diff(begin).max(initial=0)) + 1
        hard = pairs(grown, base, width, o["min_contact"])
        soft = pairs(grown, wide, width) if wide else hard[:0]
        added: dict[bool, list] = {True: [], False: []}
        for r in extra:
            own = name[begin[r["n"]] : begin[r["n"] + 1]]
            a, b = (int(np.searchsorted(own, v)) for v in sorted((r["a"], r["b"])))
            if a < b < len(own) and own[a] == min(r["a"], r["b"]) and own[b] == max(r["a"], r["b"]):
                added[r["hard"]].append((r["n"] * width + a + 1) * width + b + 1)
        hard, soft = (np.union1d(e, np.array(added[k], np.int64)) for e, k in ((hard, True), (soft, False)))
        edges = np.union1d(hard, soft)
        of, a, b = edges // (width * width), edges // width % width - 1, edges % width - 1
        is_hard, is_soft = np.isin(edges, hard), np.isin(edges, soft)
        weight = weigh(small, width) if o["palette"] is not None else {}
        color = np.zeros(len(name), np.int32)
        ends = np.searchsorted(of, np.arange(len(ids) + 1))
        for i in range(len(ids)):
            at = slice(ends[i], ends[i + 1])
            rows = list(zip(zip(a[at].tolist(), b[at].tolist(), strict=True), is_hard[at].tolist(), is_soft[at].tolist(), edges[at].tolist(), strict=True))
            mine, loose = [e for e, h, _, _ in rows if h], {}
            if o["palette"] is None:
                near = _triangles([e for e, _, s, _ in rows if s])
                loose = {e: near[e] for e, h, s, _ in rows if s and not h}
            far = {e: weight.get(k, 0.0) for e, h, _, k in rows if h} if weight else {}
            color[begin[i] : begin[i + 1]] = _choose(int(begin[i + 1] - begin[i]), mine, far, loose, o["n"], o["max_depth"], n, o["wrap"], o["palette"])
        target = np.where(small > 0, grown, 0) if o["clean_mask"] and o["expand"] else small
        at = np.flatnonzero(target)
        place, area = np.unravel_index(at, target.shape), target[0].size
        lo, hi = (name[begin[of] + x] if len(edges) else edges for x in (a, b))
        parts = [
            _lists(ids, 0, image, lo=name, color=color), _lists(ids, 1, of, lo=lo, hi=hi, is_hard=is_hard, is_soft=is_soft),
            _lists(ids, 2, at // area, color=color[begin[at // area] + target.reshape(-1)[at] - 1], **dict(zip(axes, place[1:], strict=True))),
        ]
        return pa.concat_tables(parts, promote_options="default").select(names)

    schema = ", ".join([_KINDS, *[f"{a} array<long>" for a in axes]])
    names = ["image_id", "kind", "lo", "hi", "is_hard", "is_soft", "color", *axes]
    return map_stacks(pixels, axes, shape, run, schema, True, more)


def label(
    pixels: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], n: int = 4, conn: int = 1, max_depth: int = 30, expand: bool = True,
    format_input: bool = True, p: int = 2, wrap: bool = False, first_seen: bool = False, weight_objective: int | str = 0,
    de_table: dict[tuple[int, int], float] | None = None, weight_mode: str | int = "min", extra_edges: DataFrame | None = None,
    connect_radius: int = 1, min_contact: int = 1, expand_mode: str = "clean", soft_extra_edges: DataFrame | None = None,
    soft_conn: int = 2, soft_radius: int = 2, clean_mask: bool = False, check_conflicts: bool = False, dense_limit: int = 1 << 24,
) -> Colored:
    """Colors labels so that neighbours differ. The graph is that of the expanded
    labels (unless expand is false); the colors go to the input's pixels, with
    clean_mask to those that the clean expansion left. extra_edges and
    soft_extra_edges hold image_id, a, b in numbers of the formatted labels.
    check_conflicts raises where neighbours share a color. Images of up to dense_limit
    pixels are done whole by one task each, larger ones by joins of pixels."""
    weight_objective = objective(weight_objective) if adjacency.mode_of(weight_mode) != "off" else 0
    palette = {pair: weight_objective * x for pair, x in (de_table or PALETTE).items()} if weight_objective else None
    if math.prod(shape) <= dense_limit:
        parts = [e.where("a > 0 AND b > 0 AND a <> b").select("image_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(hard).alias("hard")) for e, hard in ((extra_edges, True), (soft_extra_edges, False)) if e is not None]
        more = parts[0].union(parts[1]) if len(parts) > 1 else parts[0] if parts else None
        metric, mode = distance.checked(p, expand_mode)
        own = {
            "n": n, "conn": conn, "max_depth": max_depth, "expand": expand, "format_input": format_input, "p": metric, "wrap": wrap, "first_seen": first_seen, "weight_mode": weight_mode,
            "connect_radius": connect_radius, "min_contact": min_contact, "expand_mode": mode, "soft_conn": soft_conn, "soft_radius": soft_radius, "clean_mask": clean_mask,
            "palette": palette,
        }
        every = _by_image(pixels, more, axes, shape, own).persist()
        colors = _items(every, 0, "lo", "color").withColumnRenamed("lo", "label")
        edges = _items(every, 1, "lo", "hi", "is_hard", "is_soft")
        out = _colored(_items(every, 2, *axes, "color"), colors, edges, (every,))
        return out.check() if check_conflicts else out
    # Pixels keep their labels, so that they need no exchange by label before the last join;
    # the small tables of labels, edges and weights are renumbered instead.
    cells = (compact.shift_background(pixels) if format_input else pixels).where("label > 0")
    names = compact.numbers(cells, axes, shape, first_seen) if format_input else cells.select("image_id", "label").distinct().withColumn("new", F.col("label"))

    def renumbered(pairs: DataFrame) -> DataFrame:
        if not format_input:
            return pairs
        for end in ("lo", "hi"):
            pairs = joined(pairs, names.withColumnRenamed("label", end), ["image_id", end]).drop(end).withColumnRenamed("new", end)
        return pairs.withColumns({"lo": F.least("lo", "hi"), "hi": F.greatest("lo", "hi")})

    grown = distance.expand_labels(cells, axes, shape, p, wrap, expand_mode) if expand else cells
    edges = adjacency.hard_and_soft(grown, axes, (conn, connect_radius), (soft_conn, soft_radius), wrap, shape)
    if min_contact > 1:
        enough = adjacency.connect(grown, axes, conn, connect_radius, wrap, shape, min_contact).select("image_id", "lo", "hi", F.lit(True).alias("enough"))
        edges = joined(edges, enough, ["image_id", "lo", "hi"], "left").withColumn("is_hard", F.col("is_hard") & F.col("enough").isNotNull()).drop("enough")
    edges = renumbered(edges).select("image_id", "lo", "hi", "is_hard", "is_soft")
    for more, hard in ((extra_edges, True), (soft_extra_edges, False)):
        if more is not None:
            own = more.where("a > 0 AND b > 0 AND a <> b").select(
                "image_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(hard).alias("is_hard"), F.lit(not hard).alias("is_soft")
            )
            edges = edges.union(own)
    # Edges and colors are small against pixels and used several times; a lost part is computed again.
    edges = edges.groupBy("image_id", "lo", "hi").agg(F.max("is_hard").alias("is_hard"), F.max("is_soft").alias("is_soft")).persist()
    if weight_objective:
        # Distances of a clean or unexpanded graph count as 0 on the cells themselves.
        far = distance.expand_labels(cells, axes, shape, p, wrap) if expand else cells.withColumn("d", F.lit(0).cast("long"))
        w = renumbered(adjacency.weights(adjacency.reduce_boundary(far, axes, conn, connect_radius, wrap, shape, min_contact), weight_mode))
        weighted = joined(edges, w, ["image_id", "lo", "hi"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    else:
        weighted = edges
    vertices = names.select("image_id", F.col("new").alias("label"))
    colors = color_graph(vertices, weighted, n, max_depth, len(axes), wrap, palette).persist()
    target = grown if clean_mask and expand else cells
    if clean_mask and expand:
        target = joined(cells.drop("label"), grown.select("image_id", *axes, "label"), ["image_id", *axes])
    named = joined(names, colors.withColumnRenamed("label", "new"), ["image_id", "new"]) if format_input else colors
    painted = joined(target, named, ["image_id", "label"]).select("image_id", *axes, "color")
    out = _colored(painted, colors, edges, (edges, colors))
    return out.check() if check_conflicts else out


def _colored(painted: DataFrame, colors: DataFrame, edges: DataFrame, cached: tuple[DataFrame, ...]) -> Colored:
    hard = edges.where("is_hard").select("image_id", "lo", "hi")
    images = colors.groupBy("image_id").agg(F.max("color").alias("n_used"))
    tally = lambda e: joined(images, graphs.soft_penalty(e, colors), "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return Colored(painted, colors, hard, tally(hard), tally(edges.where("is_soft AND NOT is_hard")), images, cached)


def anneal(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, n_colors: int = 4, **parameters) -> DataFrame:
    """Kempe-chain annealing from a greedy start; pairs: image_id, lo, hi, w. Gives
    image_id, label, color."""
    both = edges.select("image_id", "lo", "hi", F.lit(True).alias("hard"), F.lit(0.0).alias("w")).union(
        pairs.select("image_id", "lo", "hi", F.lit(False).alias("hard"), F.col("w").cast("double").alias("w"))
    )

    def search(n: int, rows: list) -> list[int]:
        g = coloring.graph_of(n, [r[:2] for r in rows if r[2]["hard"]])
        hops = [sorted({w for v in g[u] for w in g[v] if w != u} - set(g[u])) for u in range(n)]
        start = coloring.solve(g, n_colors)
        return coloring.anneal(g, hops, {(a, b): r["w"] for a, b, r in rows if not r["hard"]}, start, max(n_colors, max(start, default=1)), **parameters)[0]

    return _search(vertices, both, search)
