"""Kernels and the coloring search against hand-made cases and brute force."""

import numpy as np
import pytest

from tessera.functions import coloring as C
from tessera.functions import kernels as K
from tessera.functions.offsets import offsets


def random_labels(seed, shape=(20, 23), n=12):
    rng = np.random.default_rng(seed)
    lab = np.zeros(shape, np.int64)
    for i in range(1, n + 1):
        at = [rng.integers(0, s - 3) for s in shape]
        lab[tuple(slice(a, a + rng.integers(1, 5)) for a in at)] = i
    return lab


def test_offset_counts():
    assert [len(offsets(2, 1)), len(offsets(2, 2)), len(offsets(3, 3)), len(offsets(2, 2, 2)), len(offsets(2, 1, 2))] == [2, 4, 13, 12, 4]
    for bad in ((2, 3), (2, 0), (0, 1)):
        with pytest.raises(ValueError):
            offsets(*bad)


@pytest.mark.parametrize("shape", [(20, 23), (8, 9, 7)])
@pytest.mark.parametrize("wrap", [False, True])
@pytest.mark.parametrize("p", [1, 2])
def test_expand_is_nearest(shape, wrap, p):
    lab = random_labels(3, shape)
    out, dist = K.expand(lab, p, wrap)
    seeds = np.argwhere(lab > 0)
    for at in np.ndindex(*shape):
        gap = np.abs(seeds - at)
        gap = np.minimum(gap, np.array(shape) - gap) if wrap else gap
        d = (gap**2).sum(1) if p == 2 else gap.sum(1)
        assert dist[at] == d.min()
        assert out[at] in lab[tuple(seeds[d == d.min()].T)]
        if p == 2 and not wrap:
            assert out[at] == lab[tuple(seeds[d == d.min()][-1])]


def test_components_number_in_raster_order():
    m = np.array([[0, 1, 0, 1], [1, 0, 0, 1], [0, 0, 1, 0]])
    assert K.components(m, 1)[0].tolist() == [[0, 1, 0, 2], [3, 0, 0, 2], [0, 0, 4, 0]]
    assert K.components(m, 2)[0].tolist() == [[0, 1, 0, 2], [1, 0, 0, 2], [0, 0, 2, 0]]
    assert K.components(np.zeros((3, 3), int), 1)[1] == 0


def spurs_slowly(mask, rounds):
    mask = mask.copy()
    while rounds:
        near = lambda y, x: sum(mask[v, u] for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1])
        gone = [at for at in np.ndindex(*mask.shape) if mask[at] and near(*at) == 1]
        if not gone:
            break
        for at in gone:
            mask[at] = False
        rounds -= 1
    return mask


@pytest.mark.parametrize("rounds", [-1, 1, 3])
def test_spurs_are_pruned_as_slowly(rounds):
    mask = np.random.default_rng(5).random((17, 23)) < 0.5
    assert (K.spurs_binary(mask, 0, max_iter=rounds) == spurs_slowly(mask, rounds)).all()


def test_holes_fill_up_to_their_threshold():
    plate = np.ones((12, 31), bool)
    for k, n in enumerate((1, 2, 3, 6)):
        plate[4, 2 + 7 * k : 2 + 7 * k + n] = False
    assert [int((~K.spurs_binary(plate, t, max_iter=0)).sum()) for t in (0, 1, 2, 5, 6)] == [12, 11, 9, 6, 0]


def test_thin_diagonals_go_and_squares_stay():
    line = np.zeros((8, 8), int)
    for k in range(1, 7):
        line[k, 7 - k] = 4
    assert K.spurs_labels(line, remove_thin=True).sum() == 0
    square = np.zeros((8, 8), int)
    square[2:5, 3:6] = 7
    assert (K.spurs_labels(square, remove_thin=True) == square).all()


def test_expand_clean_leaves_a_two_core():
    for seed in range(5):
        lab = K.expand_clean(random_labels(seed))
        assert ((lab == 0) | (K.same_faces(lab) >= 2)).all()


def test_clean_labels():
    a = np.zeros((6, 8), int)
    a[0, :5], a[2:4, 1:3], a[5, 7], a[2:6, 5] = 3, 9, 9, 3
    want = np.zeros((6, 8), int)
    want[0, :5], want[2:4, 1:3], want[2:6, 5] = 1, 2, 3
    assert (K.clean_labels(a, 4) == want).all()


def test_coloring_search():
    k5 = C.graph_of(5, [(a, b) for a in range(5) for b in range(a)])
    assert C.dsatur(k5, 4, 10_000) is None and max(C.solve(k5)) == 5 and C.clique(k5, 5) == 5
    grid = C.graph_of(36, [(r * 6 + c, r * 6 + c + 1) for r in range(6) for c in range(5)] + [(r * 6 + c, r * 6 + c + 6) for r in range(5) for c in range(6)])
    color = C.dsatur(grid, 2, 10_000)
    assert C.conflicts(grid, color) == 0
    for color in (C.solve(grid), C.greedy(grid), C.tabu(grid, [1] * 36, 4, 2000), C.crossover(grid, 4)):
        assert C.conflicts(grid, color) == 0
    soft = {(0, 7): 1.0, (1, 8): 1.0}
    color = C.soften(grid, soft, C.solve(grid))
    assert C.conflicts(grid, color) == 0
    start = C.solve(grid)
    hops = [sorted({w for v in grid[u] for w in grid[v] if w != u} - set(grid[u])) for u in range(36)]
    best, loss = C.anneal(grid, hops, {(0, 7): 1.0}, start, steps=300)
    assert C.conflicts(grid, best) == 0 and loss <= sum(start[u] == start[v] for u in range(36) for v in hops[u] if u < v) + 50
    assert C.soften(C.graph_of(2, []), {(0, 1): 1.0}, [1, 1]) == [1, 1]
