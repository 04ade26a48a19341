"""Neighbour offsets of an N-dimensional grid."""

from __future__ import annotations

from itertools import product


def offsets(ndim: int, conn: int, radius: int = 1, both: bool = False) -> list[tuple[int, ...]]:
    """Offsets with coordinates within +-radius, of which 1 to conn are not zero.
    Only those whose first nonzero coordinate is positive, so that each pair of
    pixels is met once, unless `both`."""
    if ndim < 1 or not 1 <= conn <= ndim or radius < 1:
        raise ValueError(f"no neighbourhood: ndim {ndim}, conn {conn}, radius {radius}")
    span = range(-radius, radius + 1)
    every = (o for o in product(span, repeat=ndim) if 1 <= sum(map(bool, o)) <= conn)
    return [o for o in every if both or next(v for v in o if v) > 0]
