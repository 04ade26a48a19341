"""Dense kernels on one image: what joins and windows cannot say in one pass
(fixpoints, propagation that barriers stop). All take and give numpy arrays of any
number of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .offsets import offsets

FAR = np.int64(1) << 40


def moved(a: np.ndarray, off: tuple[int, ...], fill, wrap: bool = False) -> np.ndarray:
    """b with b[p] = a[p + off]; fill beyond the border."""
    if wrap:
        return np.roll(a, [-o for o in off], tuple(range(a.ndim)))
    b = np.full_like(a, fill)
    if any(abs(o) >= n for o, n in zip(off, a.shape, strict=True)):
        return b
    src = tuple(slice(max(o, 0), n + min(o, 0)) for o, n in zip(off, a.shape, strict=True))
    dst = tuple(slice(max(-o, 0), n + min(-o, 0)) for o, n in zip(off, a.shape, strict=True))
    b[dst] = a[src]
    return b


def components(values: np.ndarray, conn: int) -> tuple[np.ndarray, int]:
    """Components of equal nonzero values, numbered by their first pixel in raster order."""
    n = values.size
    fg = values != 0
    root = np.arange(n + 1)
    idx = np.arange(n).reshape(values.shape)
    links = []
    for o in offsets(values.ndim, conn):
        same = fg & (moved(values, o, 0) == values)
        a = idx[same]
        links.append((a, moved(idx, o, 0)[same]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.zeros(n, np.int64)
    first, out[fg.ravel()] = np.unique(root[:-1][fg.ravel()], return_inverse=True)
    out[fg.ravel()] += 1
    return out.reshape(values.shape), len(first)


def _line(a: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(a, axis, 0)


#: Lines up to this length compare all their sources, longer ones build an envelope.
SHORT = 64


def _short_l2(f: np.ndarray, who: np.ndarray, wrap: bool, lines: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """sweep_l2() of short lines: distance and source's rank are one number, whose least
    over the sources is taken from near to far, for some lines at a time, until none
    farther can be as near."""
    n, bits = len(f), (3 * len(f) if wrap else len(f)).bit_length()
    dist, own = np.full(f.shape, FAR), np.zeros(who.shape, who.dtype)
    some = np.flatnonzero((f < FAR).any(axis=0))
    if len(some) < f.shape[1]:
        f, who = f[:, some], who[:, some]
    reach = n // 2 if wrap else n - 1
    most = int(f[f < FAR].max(initial=0)) + reach * reach
    kind = np.int32 if (most + 2 + reach * reach) << bits < 1 << 31 else np.int64
    key = np.minimum(f, most + 1).astype(kind) << kind(bits)
    key = (np.concatenate([key] * 3) if wrap else key) + np.arange((3 if wrap else 1) * n - 1, -1, -1, dtype=kind)[:, None]
    best, buffer = np.empty(f.shape, kind), np.empty((n, min(lines, f.shape[1])), kind)
    for i in range(0, f.shape[1], lines):
        near, out = key[:, i : i + lines], best[:, i : i + lines]
        one = buffer[:, : out.shape[1]]
        out[...] = near[n : 2 * n] if wrap else near
        for r in range(1, reach + 1):
            if r % 4 == 0 and r * r > int(out.max()) >> bits:
                break
            more = kind(r * r << bits)
            for step in (r, -r):
                to = slice(0, n) if wrap else slice(max(0, -step), n - max(0, step))
                at = slice(to.start + step + n * wrap, to.stop + step + n * wrap)
                np.add(near[at], more, out=one[to])
                np.minimum(out[to], one[to], out=out[to])
    source = ((3 if wrap else 1) * n - 1 - (best & kind((1 << bits) - 1))) % n
    dist[:, some] = best >> kind(bits)
    own[:, some] = np.take_along_axis(who, source.astype(np.intp), 0)
    return dist, own


def sweep_l2(dist: np.ndarray, lab: np.ndarray, axis: int, wrap: bool = False, barrier: np.ndarray | None = None) -> None:
    """One axis of the squared Euclidean transform, in place; of equally near sources the
    last wins. The lower envelope of the sources' parabolas, for all lines at once:
    each source joins behind those it does not cover, and the places where one takes
    over from the one before are whole numbers, so ties are exact."""
    d, v = _line(dist, axis), _line(lab, axis)
    n = len(d)
    shape = d.shape
    f, who = d.reshape(n, -1).copy(), v.reshape(n, -1).copy()
    stop = None if barrier is None else _line(barrier, axis).reshape(n, -1)
    if stop is not None:
        f[stop] = FAR
    if n <= SHORT:
        near, own = _short_l2(f, v.reshape(n, -1), wrap)
        if stop is not None:
            near[stop], own[stop] = FAR, 0
        d[...], v[...] = near.reshape(shape), own.reshape(shape)
        return
    m = f.shape[1]
    rows = 3 * n if wrap else n
    held, begin = np.zeros((rows, m), np.int64), np.zeros((rows, m), np.int64)  # by place on the envelope
    top = np.full(m, -1)
    for q in range(rows):
        at = q - n if wrap else q
        lines = np.flatnonzero(f[at % n] < FAR)
        own = f[at % n, lines] + at * at
        while len(lines):
            k = top[lines]
            first = k < 0
            last = held[k, lines]
            over = own - f[last % n, lines] - last * last
            # The first place where the new one is at least as near.
            s = np.where(first, 0, np.maximum(-((-over) // np.maximum(2 * (at - last), 1)), 0))
            pop = ~first & (s <= begin[k, lines])
            put = lines[~pop & (s < n)]
            top[put] += 1
            held[top[put], put], begin[top[put], put] = at, s[~pop & (s < n)]
            lines, own = lines[pop], own[pop]
            top[lines] -= 1
    # Sources stand in rising order, so the largest that has begun is the nearest.
    best = np.full((n, m), -rows)
    place, line = np.nonzero(np.arange(rows)[:, None] <= top)
    best[begin[place, line], line] = held[place, line]  # no two of a line begin at one place
    best = np.maximum.accumulate(best, axis=0)
    some = best > -rows
    source = np.where(some, best, 0)
    near = f[source % n, np.arange(m)] + (np.arange(n)[:, None] - source) ** 2
    if stop is not None:
        some &= ~stop
    d[...] = np.where(some, near, FAR).reshape(shape)
    v[...] = np.where(some, who[source % n, np.arange(m)], 0).reshape(shape)


def sweep_l1(dist: np.ndarray, lab: np.ndarray, axis: int, wrap: bool = False, barrier: np.ndarray | None = None) -> None:
    """One axis of the city-block transform, in place: forward, then backward, only nearer sources relax."""
    d, v = _line(dist, axis), _line(lab, axis)
    stop = None if barrier is None else _line(barrier, axis)
    n = len(d)

    def relax(i: int, j: int) -> None:
        take = (d[j] + 1 < d[i]) & (d[j] < FAR)
        if stop is not None:
            take &= ~stop[i] & ~stop[j]
        d[i], v[i] = np.where(take, d[j] + 1, d[i]), np.where(take, v[j], v[i])

    for again in range(1 + wrap):
        for i in range(0 if again else 1, n):
            relax(i, i - 1)
        for i in range(n - 1 if again else n - 2, -1, -1):
            relax(i, (i + 1) % n)


def expand(labels: np.ndarray, p: int = 2, wrap: bool = False, stack: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Nearest label everywhere, and its distance (squared for p = 2; FAR where there is no
    label). Of a stack the first axis counts images."""
    lab, dist = labels.copy(), np.where(labels > 0, 0, FAR)
    for axis in reversed(range(int(stack), labels.ndim)):
        (sweep_l2 if p == 2 else sweep_l1)(dist, lab, axis, wrap)
    return lab, dist


def _framed(lab: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return np.pad(lab, [(int(k in axes),) * 2 for k in range(lab.ndim)])


def same_faces(lab: np.ndarray, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Face neighbours of the same nonzero label, along the given axes."""
    n = np.zeros(lab.shape, np.int8)
    for axis in axes or range(lab.ndim):
        v, out = _line(lab, axis), _line(n, axis)
        same = (v[1:] == v[:-1]) & (v[1:] != 0)
        out[1:] += same
        out[:-1] += same
    return n


def thin(lab: np.ndarray, axes: tuple[int, ...] | None = None, where: np.ndarray | None = None) -> np.ndarray:
    """Pixels (of those in the mask where, if given) with exactly two same-label neighbours
    in the full window over the axes, opposite each other."""
    axes = axes or tuple(range(lab.ndim))
    frame = _framed(lab, axes)
    step = [s // frame.itemsize for s in frame.strides]
    at = np.nonzero(lab if where is None else (lab != 0) & where)
    flat = sum((p + int(k in axes)) * step[k] for k, p in enumerate(at))
    frame = frame.reshape(-1)
    own = frame[flat]
    total, opposite = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    for o in offsets(len(axes), len(axes)):
        to = sum(v * step[a] for a, v in zip(axes, o, strict=True))
        one, two = frame[flat + to] == own, frame[flat - to] == own
        total += one
        total += two
        opposite |= one & two
    out = np.zeros(lab.shape, bool)
    out[at] = (total == 2) & opposite
    return out


def stubs(lab: np.ndarray, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Labeled pixels that hang by at most one face, or are an antipodal bridge."""
    face = same_faces(lab, axes)
    return (lab != 0) & ((face <= 1) | thin(lab, axes, face == 2))


def peel(lab: np.ndarray, threshold: int = 1, axes: tuple[int, ...] | None = None, rounds: int = -1) -> np.ndarray:
    """Removes pixels with at most threshold same-label faces, to the fixpoint (or for so
    many rounds). After the first round only those near removed ones are looked at."""
    axes = tuple(axes or range(lab.ndim))
    frame = _framed(lab, axes)
    step = [frame.strides[a] // frame.itemsize for a in axes]
    n, own = _framed(same_faces(lab, axes), axes).reshape(-1), frame.reshape(-1)
    gone = np.flatnonzero((own != 0) & (n <= threshold))
    while rounds and len(gone):
        near = np.concatenate([gone + v for s in step for v in (s, -s)])
        near = near[own[near] == np.tile(own[gone], 2 * len(step))]
        own[gone] = 0
        np.subtract.at(n, near, 1)
        near = np.unique(near)
        gone = near[(own[near] != 0) & (n[near] <= threshold)]
        rounds -= 1
    return np.ascontiguousarray(frame[tuple(slice(1, -1) if k in axes else slice(None) for k in range(lab.ndim))])


def expand_clean(labels: np.ndarray, p: int = 2, stack: bool = False) -> np.ndarray:
    """Expansion whose cells have no stubs or bridges: after each axis from the
    second on, stubs of the swept axes go and cells are peeled to their 2-core;
    what went stays a barrier for later axes. Of a stack the first axis counts images."""
    kind = np.int16 if labels.min(initial=0) >= 0 and labels.max(initial=0) < 1 << 15 else labels.dtype.type
    lab, dist = labels.astype(kind), np.where(labels > 0, 0, FAR)
    barrier = np.zeros(labels.shape, bool)
    swept: tuple[int, ...] = ()
    for axis in reversed(range(int(stack), labels.ndim)):
        (sweep_l2 if p == 2 else sweep_l1)(dist, lab, axis, False, barrier)
        swept = (axis, *swept)
        if len(swept) >= 2:
            kept = np.where(stubs(lab, swept), kind(0), lab)
            kept = peel(kept, 1, swept)
            barrier |= (lab != 0) & (kept == 0)
            dist[barrier] = FAR
            lab = kept
    return lab.astype(labels.dtype)


def spurs_binary(mask: np.ndarray, hole_threshold: int = 5, mode: str = "cardinal", threshold: int | None = None, max_iter: int = -1) -> np.ndarray:
    """Fills small holes (background that touches the border is none), then prunes
    in synchronous rounds pixels with 1 to threshold - 1 neighbours."""
    mask = mask.astype(bool)
    if hole_threshold > 0:
        comp, n = components(np.pad(~mask, 1, constant_values=True).astype(np.int64), 1)
        area = np.bincount(comp.ravel(), minlength=n + 1)
        small = (area <= hole_threshold) & (np.arange(n + 1) > 0)
        small[comp[(0,) * mask.ndim]] = False
        mask = mask | small[comp][tuple(slice(1, -1) for _ in mask.shape)]
    around = offsets(mask.ndim, 1 if mode == "cardinal" else mask.ndim, both=True)
    least = mask.ndim if threshold is None or threshold < 1 else threshold
    while max_iter:
        n = sum(moved(mask, o, False).astype(int) for o in around)
        gone = mask & (n >= 1) & (n < least)
        if not gone.any():
            break
        mask = mask & ~gone
        max_iter -= 1
    return mask


def spurs_labels(lab: np.ndarray, threshold: int = 1, max_iters: int = 20, remove_thin: bool = False) -> np.ndarray:
    """Synchronous rounds that zero pixels with at most threshold same-label faces;
    bridges go in the first round, which always runs."""
    lab = lab.copy()
    for k in range(max(1, max_iters)):
        gone = (lab != 0) & (same_faces(lab) <= threshold)
        if k == 0 and remove_thin:
            gone |= thin(lab)
        if not gone.any():
            break
        lab[gone] = 0
    return lab


def renumber_first_seen(lab: np.ndarray) -> np.ndarray:
    flat = lab.ravel()
    value, first, back = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.zeros(len(value), np.int64)
    order = np.argsort(np.where(value > 0, first, lab.size))
    rank[order] = np.arange(1, len(value) + 1)
    rank[value <= 0] = 0
    return rank[back].reshape(lab.shape)


def clean_labels(lab: np.ndarray, min_area: int = 9, despur: bool = False) -> np.ndarray:
    """Every component of at least min_area pixels is a cell, numbered in raster order."""
    if despur:
        lab = spurs_labels(lab, 1, 20, True)
    comp, n = components(lab, lab.ndim)
    big = np.bincount(comp.ravel(), minlength=n + 1) >= min_area
    big[0] = False
    return renumber_first_seen(np.where(big[comp], comp, 0))


def compact(values: np.ndarray, mask: np.ndarray, first_seen: bool = False) -> np.ndarray:
    """Labels of the marked pixels as 1..n: negative ones shift so that the least is
    background, ranks follow the labels, or the first pixels in raster order."""
    low = min(int(values[mask].min()), 0) if mask.any() else 0
    lab = np.where(mask, values - low, 0)
    lab[lab < 0] = 0
    if first_seen:
        return renumber_first_seen(lab)
    out = np.zeros(lab.shape, np.int64)
    out[lab > 0] = np.unique(lab[lab > 0], return_inverse=True)[1] + 1
    return out


def touching(lab: np.ndarray, table: list[tuple[int, ...]], wrap: bool = False, dist: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For a stack: the image's number, lo, hi and the cost (sum of both ends' dist) of
    every pixel pair of two labels at these offsets."""
    area, own = lab[0].size, lab.reshape(-1)
    images, los, his, costs = [], [], [], []
    for o in table:
        other = moved(lab, (0, *o), 0, wrap).reshape(-1)
        at = np.flatnonzero((own > 0) & (other > 0) & (own != other))
        a, b = own[at], other[at]
        images.append(at // area)
        los.append(np.minimum(a, b))
        his.append(np.maximum(a, b))
        costs.append(np.zeros(len(a), np.int64) if dist is None else dist.reshape(-1)[at] + moved(dist, (0, *o), 0, wrap).reshape(-1)[at])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + x) for x in (images, los, his, costs))


def nearest(label: np.ndarray, pos: np.ndarray, p: int = 2, torus: tuple[int, ...] | None = None, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """lo, hi and the least distance (squared for p = 2) of all pairs of labels, of pixels
    sorted by label with coordinates pos; so many distances are held at a time."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(label)), bool), label[1:] != label[:-1]]))
    names, end = label[first], np.append(first[1:], len(label))
    kind = np.int32 if len(label) and (int(np.abs(pos).max()) * 2 + 1) ** 2 * len(pos) < 1 << 31 else np.int64
    pos = pos.astype(kind)

    def gaps(a: slice, b: slice) -> np.ndarray:
        out = 0
        for k, x in enumerate(pos):
            gap = x[a, None] - x[None, b]
            if torus is not None:
                gap = np.minimum(np.abs(gap), torus[k] - np.abs(gap))
            out = out + (gap * gap if p == 2 else np.abs(gap))
        return out

    k = 0
    while k < len(names) - 1:
        rest = len(label) - first[k]
        last = max(k + 1, min(len(names) - 1, int(np.searchsorted(end, first[k] + cells // rest, "right"))))
        right, starts = slice(end[k], None), first[k + 1 :] - end[k]
        step, parts = max(1, cells // rest), []
        for i in range(first[k], end[last - 1], step if last == k + 1 else end[last - 1]):
            j = min(i + step, end[k]) if last == k + 1 else end[last - 1]
            best = np.minimum.reduceat(gaps(slice(i, j), right), starts, axis=1)
            parts.append(best.min(axis=0)[None] if last == k + 1 else np.minimum.reduceat(best, first[k:last] - i, axis=0))
        best = np.minimum.reduce(parts)
        a, b = np.nonzero(np.arange(len(starts)) >= np.arange(last - k)[:, None])
        yield names[k + a], names[k + 1 + b], best[a, b].astype(np.int64)
        k = last
