"""What keeps queries on pixels from growing faster than their pixels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from tessera.functions import coloring, kernels
from tessera.operators import adjacency, color, distance, images
from tessera.plans.rasters import QUERIES

from tessera.sources import rasters

from test_rasters import SF, image, pixels

AXES = ("y", "x")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "adjacency_lists", "bridge_stub_mask", "clique_k4", "color_greedy_wp", "conflicts", "connect_3d_c3", "connect_c1", "connect_c2", "connect_wrap", "connect_r2", "edge_extra",
    "edge_hard_soft_dual", "edge_min_contact", "edge_weight_count", "edge_weight_harmonic", "edge_weight_max", "edge_weight_mean", "edge_weight_meaninv", "edge_weight_min", "kempe_anneal",
    "pairs_with_face_count", "soft_penalty", "pairwise_nearest", "face_count", "two_hop", "soft_triangle_weights", "regionprops", "format_ascending", "spurs_removed", "label_by_joins",
])
def test_no_table_goes_through_the_driver(spark, name):
    assert "Broadcast" not in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["face_count", "bridge_stub_mask", "raster_cast_bg", "expand_l2", "expand_with_dist", "expand_clean_l2", "expand_3d_l2"])
def test_boxes_are_exchanged_once_and_pixels_never(spark, name):
    assert plan_of(QUERIES[name](spark, SF)).count("Exchange hashpartitioning") == 1


def brute_pairs(im, table, wrap):
    out = {}
    for at in np.ndindex(*im.shape):
        for o in table:
            to = tuple(a + b for a, b in zip(at, o))
            to = tuple(a % n for a, n in zip(to, im.shape)) if wrap else to
            if all(0 <= a < n for a, n in zip(to, im.shape)) and im[at] and im[to] and im[at] != im[to]:
                key = tuple(sorted((int(im[at]), int(im[to]))))
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("wrap", [False, True])
def test_tiles_meet_at_their_borders(spark, monkeypatch, wrap):
    monkeypatch.setattr(adjacency, "TILE_BITS", 4)
    ims = [np.where(image(1, (9, 11)) > 2, image(2, (9, 11), 5), 0), image(3, (9, 11), 3) * 10**12]
    px = pixels(spark, *ims)
    got = {}
    for r in adjacency.connect(px, AXES, 2, 2, wrap, (9, 11)).collect():
        got.setdefault(r.image_id, {})[r.lo, r.hi] = r.contact
    assert got == {i: brute_pairs(im, kernels.offsets(2, 2, 2), wrap) for i, im in enumerate(ims)}
    faces = {(r.image_id, r.y, r.x): r.n for r in adjacency.face_count(px, AXES).collect()}
    for i, im in enumerate(ims):
        assert {(i, y, x): n for (y, x), n in np.ndenumerate(kernels.same_faces(im)) if im[y, x]} == {k: n for k, n in faces.items() if k[0] == i}
    stubs = {(r.image_id, r.y, r.x) for r in adjacency.bridges_and_stubs(px, AXES).collect()}
    assert stubs == {(i, int(y), int(x)) for i, im in enumerate(ims) for y, x in np.argwhere(kernels.stubs(im))}


@pytest.mark.parametrize("torus", [None, (9, 11)])
@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_nearest_pairs_by_blocks(torus, cells):
    im = np.where(image(5) > 2, image(6), 0)
    at = np.argwhere(im)
    order = np.argsort(im[im > 0], kind="stable")
    label, pos = im[im > 0][order], at[order].T
    got = {(int(a), int(b)): int(d) for part in kernels.nearest(label, pos, 2, torus, cells) for a, b, d in zip(*part)}
    want = {}
    for i, j in np.ndindex(len(label), len(label)):
        if label[i] < label[j]:
            gap = np.abs(pos[:, i] - pos[:, j])
            gap = np.minimum(gap, np.array(torus) - gap) if torus else gap
            key = int(label[i]), int(label[j])
            want[key] = min(want.get(key, 10**9), int((gap**2).sum()))
    assert got == want


def batches_of(keys, size):
    table = pa.table({f"k{i}": np.array(k, np.int64) for i, k in enumerate(keys)} | {"v": np.arange(len(keys[0]))})
    return table, iter(table.to_batches(max_chunksize=size))


@pytest.mark.parametrize("rows", [1, 20, 1 << 15])
@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_stacks_keep_groups_whole(monkeypatch, rows, size):
    monkeypatch.setattr(images, "ROWS", rows)
    keys = [0] * 5 + [1] * 1 + [2] * 30 + [3] * 7, [0] * 3 + [1] * 2 + [1] + [0] * 29 + [1] + [1] * 7
    table, batches = batches_of(keys, size)
    whole, groups = [], []
    for part, begin in images.stacks(batches, 2):
        whole.append(part)
        groups += [set(zip(*(part.column(k).to_pylist()[i:j] for k in ("k0", "k1")))) for i, j in zip(begin, [*begin[1:], part.num_rows])]
    assert pa.concat_tables(whole).to_pydict() == table.to_pydict()
    assert groups == [{g} for g in dict.fromkeys(zip(*keys))]
    assert rows > 40 or size > 40 or len(whole) > 1


def test_some_windows_at_a_time(monkeypatch):
    ims = [np.where(image(s) > 2, image(s + 9), 0) for s in range(5)]
    rows = [(i, *map(int, at), int(im[at])) for i, im in enumerate(ims) for at in np.ndindex(*im.shape) if im[at]]
    table = pa.table(dict(zip(("image_id", "y", "x", "label"), map(np.array, zip(*rows))))).append_column("own", pa.array([True] * len(rows)))
    begin = np.flatnonzero(np.diff([-1] + [r[0] for r in rows]))
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(adjacency, "WINDOW", most)
        got = {}
        for _, ids, window in adjacency._windows(table, begin, AXES, 1):
            group, a, b, _, _ = adjacency._touching(window, kernels.offsets(2, 2), 2)
            for r in adjacency.pair_rows(ids, window.width, window.names, group, a, b).to_pylist():
                got.setdefault(r["image_id"], {})[r["lo"], r["hi"]] = r["contact"]
        assert got == {i: brute_pairs(im, kernels.offsets(2, 2), False) for i, im in enumerate(ims)}


def test_an_image_larger_than_a_stack(spark, monkeypatch):
    monkeypatch.setattr(images, "CELLS", 50)
    ims = [np.where(image(s) > 3, image(s + 9), 0) for s in range(3)]
    got = {(r.image_id, r.y, r.x): (r.label, r.d) for r in distance.expand_labels(pixels(spark, *ims), AXES, (9, 11)).collect()}
    for i, im in enumerate(ims):
        lab, d = kernels.expand(im)
        assert {(y, x): (int(lab[y, x]), int(d[y, x])) for y, x in np.ndindex(9, 11)} == {k[1:]: v for k, v in got.items() if k[0] == i}


@pytest.mark.parametrize("wrap", [False, True])
def test_short_and_long_lines_agree(monkeypatch, wrap):
    for seed in range(20):
        lab = np.where(image(seed) > 3, image(seed + 50), 0)
        barrier = image(seed + 99) == 0
        out = []
        for short in (0, 64):
            monkeypatch.setattr(kernels, "SHORT", short, raising=False)
            own, d = lab.copy(), np.where(lab > 0, 0, kernels.FAR)
            for axis in (1, 0):
                kernels.sweep_l2(d, own, axis, wrap, barrier)
            out.append((own.tolist(), d.tolist()))
        assert out[0] == out[1]


def test_colors_beyond_a_proof_are_those_of_the_whole_search(monkeypatch):
    graphs = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(5, 40))
        graphs.append(coloring.graph_of(n, rng.integers(0, n, (int(rng.integers(1, 5)) * n, 2)).tolist()))
    found = [coloring.solve(g, 4, ndim=3) for g in graphs]
    for g, own in zip(graphs, found):
        assert not coloring.uncolorable(g, max(own), 20_000) and not coloring.conflicts(g, own)
    monkeypatch.setattr(coloring, "PROOF", 0, raising=False)
    assert [coloring.solve(g, 4, ndim=3) for g in graphs] == found


def test_what_cannot_be_colored_is_proven_quickly():
    k6 = [(a, b) for a in range(6) for b in range(a)]
    tail = [(i, i + 1) for i in range(5, 60)]
    g = coloring.graph_of(61, k6 + tail)
    assert coloring.uncolorable(g, 5, 200) and not coloring.uncolorable(g, 6, 200) and not coloring.uncolorable(g, 5, 3)


def plain_loss(g, hops, pairs, color):
    return sum(color[u] == color[v] for u in range(len(g)) for v in hops[u] if u < v) + 50 * sum(w for (a, b), w in pairs.items() if color[a] == color[b])


def test_the_loss_of_annealing_is_kept_exactly():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        n = 30
        g = coloring.graph_of(n, rng.integers(0, n, (45, 2)).tolist())
        hops = [sorted({w for v in g[u] for w in g[v] if w != u} - set(g[u])) for u in range(n)]
        pairs = {(int(a), int(b)): float(w) for a, b, w in zip(*rng.integers(0, n, (2, 20)), rng.random(20)) if a < b and b not in g[a]}
        start = coloring.solve(g)
        own, loss = coloring.anneal(g, hops, pairs, start, max(4, max(start)))
        assert not coloring.conflicts(g, own) and abs(loss - plain_loss(g, hops, pairs, own)) < 1e-9
        assert loss <= plain_loss(g, hops, pairs, start)


def test_annealing_takes_its_whole_course(spark, monkeypatch):
    took = []
    monkeypatch.setattr(color, "anneal", lambda *a, **b: took.append(b) or real(*a, **b))
    QUERIES["kempe_anneal"](spark, SF)
    assert took == [{}]


real = color.anneal


def test_peeling_by_rounds():
    for seed in range(6):
        lab = np.where(image(seed, (2, 13, 15)) > 1, image(seed + 9, (2, 13, 15), 3), 0)
        for rounds in (0, 1, 2, -1):
            slow, left = lab.copy(), rounds
            while left:
                same = sum((kernels.moved(slow, o, 0) == slow).astype(int) for o in ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0)))
                gone = (slow != 0) & (same <= 1)
                if not gone.any():
                    break
                slow[gone] = 0
                left -= 1
            assert (kernels.peel(lab, 1, (1, 2), rounds) == slow).all()


@pytest.mark.parametrize("shape", [(3, 12, 13), (2, 6, 9, 8)])
def test_a_stack_expands_as_its_images(shape):
    lab = np.where(image(4, shape) > 4, image(5, shape, 9), 0)
    for p in (1, 2):
        assert (kernels.expand_clean(lab, p, stack=True) == np.stack([kernels.expand_clean(one, p) for one in lab])).all()
        for wrap in (False, True):
            both = kernels.expand(lab, p, wrap, stack=True)
            for k in range(2):
                assert (both[k] == np.stack([kernels.expand(one, p, wrap)[k] for one in lab])).all()


def test_lists_of_items_are_cut_within_an_image(monkeypatch):
    monkeypatch.setattr(color, "LISTED", 3)
    out = color._lists(np.array([7, 8, 9]), 1, np.array([0] * 7 + [2] * 3), lo=np.arange(10)).to_pylist()
    assert [(r["image_id"], r["lo"]) for r in out] == [(7, [0, 1, 2]), (7, [3, 4, 5]), (7, [6]), (9, [7, 8, 9])]


@pytest.mark.parametrize("more", [{"first_seen": True}, {"first_seen": True, "weight_objective": "max", "weight_mode": "harmonic"}, {"format_input": False}])
def test_names_agree_by_image_and_by_joins(spark, more):
    ims = [np.where(image(s, (14, 14)) > 3, image(s + 9, (14, 14), 9), 0) * 3 for s in range(3)]
    a, b = (color.label(pixels(spark, *ims), AXES, (14, 14), dense_limit=limit, **more) for limit in (1 << 24, 0))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a.edges) == rows(b.edges) and rows(a.colors) == rows(b.colors) and rows(a.pixels) == rows(b.pixels)
    assert a.check() is a and b.check() is b
    a.free(), b.free()


def test_labels_by_joins_exchange_pixels_once(spark):
    out = color.label(rasters.order_boxes(spark, SF), AXES, (48, 48), expand=False, conn=2, dense_limit=0)
    plan = plan_of(out.edges)
    assert "__nth" in plan and "hashpartitioning(image_id" in plan and "label#" not in "".join(x for x in plan.split("Exchange hashpartitioning(")[1:] if ", y" in x.split(")")[0])
    assert not [x for x in plan.split("Exchange hashpartitioning(")[1:] if "t0" in x.split(")")[0]]
    out.free()


@pytest.mark.parametrize("wrap", [False, True])
def test_lines_by_blocks_are_the_whole_images(spark, wrap):
    ims = [np.where(image(s) > 3, image(s + 9), 0) for s in range(4)]
    px = pixels(spark, *ims)
    a, b = (sorted(map(tuple, distance.expand_labels(px, AXES, (9, 11), 2, wrap, dense_limit=limit).collect())) for limit in (1 << 24, 0))
    assert a == b
    now = px.withColumn("d", functions.lit(0).cast("long"))
    one = {r.image_id * 1000 + r.y * 11 + r.x: (r.label, r.d) for r in distance._pass(now, AXES, (9, 11), 1, 2, wrap, lines=2).collect()}
    for i, im in enumerate(ims):
        lab, d = im.copy(), np.where(im > 0, 0, kernels.FAR)
        kernels.sweep_l2(d, lab, 1, wrap)
        assert {i * 1000 + y * 11 + x: (int(lab[y, x]), int(d[y, x])) for y, x in np.argwhere(lab)} == {k: v for k, v in one.items() if k // 1000 == i}
