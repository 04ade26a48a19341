"""Operators on small pixel relations."""

import glob
import os

import numpy as np
import pytest

from tessera.operators import adjacency, color, compact, distance, graphs, regions, spurs
from tessera.sources import rasters

SF = "/root/testdata/sf0.001"


def pixels(spark, *images, axes=("y", "x")):
    rows = [(i, *map(int, at), int(im[at])) for i, im in enumerate(map(np.array, images)) for at in np.ndindex(*im.shape) if im[at]]
    return spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} long" for a in axes) + ", label long")


def image(seed, shape=(9, 11), n=6, low=0):
    return np.random.default_rng(seed).integers(low, n, shape)


def pairs_of(im, conn):
    out = set()
    for y, x in np.ndindex(*im.shape):
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            v, u = y + dy, x + dx
            if abs(dy) + abs(dx) <= conn and 0 <= v < im.shape[0] and 0 <= u < im.shape[1] and im[y, x] and im[v, u] and im[y, x] != im[v, u]:
                out.add((int(min(im[y, x], im[v, u])), int(max(im[y, x], im[v, u]))))
    return out


@pytest.mark.parametrize("conn", [1, 2])
def test_connect_is_brute_force(spark, conn):
    im = np.where(image(1) > 3, image(2, n=5), 0)
    assert {(r.lo, r.hi) for r in adjacency.connect(pixels(spark, im), ("y", "x"), conn).collect()} == pairs_of(im, conn)


def test_format_negative_background(spark):
    im = image(3, low=-2)
    rows = [(0, *map(int, at), int(im[at])) for at in np.ndindex(*im.shape)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, label long")
    rank = {v: i for i, v in enumerate(sorted(set(im.ravel().tolist())))}  # the least is background
    out = {(r.y, r.x): r.label for r in compact.format_labels(px, ("y", "x"), im.shape).collect()}
    assert out == {at: rank[int(im[at])] for at in np.ndindex(*im.shape) if rank[int(im[at])]}


def test_names_of_weights_and_objectives():
    assert [adjacency.mode_of(m) for m in ("meaninv", "Mean_Inv", "MAX", 1, 2, 6, 0, "odd", 99)] == ["mean_inv", "mean_inv", "max", "min", "max", "mean_inv", "off", "min", "min"]
    assert [color.objective(o) for o in ("max", "SHARP", "min", "off", "none", "odd", 1, 0, -1)] == [1, 1, -1, 0, 0, 0, 1, 0, -1]


@pytest.mark.parametrize("more", [{}, {"expand": False, "conn": 2}, {"min_contact": 3}, {"wrap": True}, {"weight_objective": "min", "weight_mode": "mean"}, {"clean_mask": True}])
def test_label_by_image_and_by_joins_agree(spark, more):
    ims = [np.where(image(s, (14, 14)) > 3, image(s + 9, (14, 14), 9), 0) for s in range(3)]
    px = pixels(spark, *ims)
    a, b = (color.label(px, ("y", "x"), (14, 14), dense_limit=limit, **more) for limit in (1 << 24, 0))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a.edges) == rows(b.edges)
    assert {r[:3] for r in rows(a.pixels)} == {r[:3] for r in rows(b.pixels)}
    assert rows(a.colors) == rows(b.colors)
    assert a.check() is a
    a.free()


def test_check_raises_on_conflicts(spark):
    out = color.label(pixels(spark, [[1, 2, 3]]), ("y", "x"), (1, 3), expand=False)
    out.conflicts = spark.createDataFrame([(0, 2)], "image_id long, n long")
    with pytest.raises(ValueError):
        out.check()


def test_spurs_choose_their_kind(spark):
    mask = np.zeros((7, 9), int)
    mask[3, 1:8] = 1
    two = mask * 2
    own = lambda px, **k: sorted(map(tuple, spurs.delete_spurs(px, ("y", "x"), (7, 9), **k).collect()))
    px = pixels(spark, mask, two)
    both = own(px)
    assert [r for r in both if r[0] == 0] == own(px.where("image_id = 0"), kind="binary")
    assert [r for r in both if r[0] == 1] == own(px.where("image_id = 1"), kind="labels")
    flags = px.where("image_id = 0").selectExpr("image_id", "y", "x", "label = 1 AS label")
    assert own(flags) == own(px.where("image_id = 0"), kind="binary")


def test_constant_image_is_one_cell(spark):
    px = pixels(spark, np.full((4, 4), 5))
    out = color.label(px, ("y", "x"), (4, 4))
    assert {r.color for r in out.pixels.collect()} == {1}


def test_source_checks(spark):
    with pytest.raises(ValueError):
        rasters.check(spark.createDataFrame([(0, 1.5)], "image_id long, label double"))
    dense = spark.createDataFrame([(7, [[0, 2], [3, 0]])], "image_id long, pixels array<array<int>>")
    assert {(r.y, r.x, r.label) for r in rasters.from_arrays(dense).collect()} == {(0, 1, 2), (1, 0, 3)}


def test_arguments(spark):
    px = pixels(spark, [[1, 1], [0, 2]])
    for call in (
        lambda: distance.expand_labels(px, ("y", "x"), (2, 2), p=3),
        lambda: distance.expand_labels(px, ("y", "x"), (2, 2), mode="odd"),
        lambda: spurs.delete_spurs(px, ("y", "x"), (2, 2), mode="odd"),
        lambda: spurs.delete_spurs(px, ("y", "x"), (2, 2), kind="binary", remove_thin=True),
        lambda: regions.connected_components(px, ("y", "x"), (2, 2), 3),
        lambda: graphs.cliques(px, 1),
    ):
        with pytest.raises(ValueError):
            call()


def test_fill_holes(spark):
    ring = np.ones((5, 5), int)
    ring[2, 2] = 0
    px = pixels(spark, ring)
    assert spurs.delete_spurs(px, ("y", "x"), (5, 5), max_iter=0, kind="binary").count() == 25


def test_label_no_conflict_and_extra_edge(spark):
    a = np.zeros((12, 14), int)
    a[1:11, 1:5], a[1:11, 5:9], a[1:11, 9:13] = 1, 2, 3
    b = np.zeros((12, 14), int)
    b[1:3, 1:3], b[8:10, 10:12] = 1, 2
    px = pixels(spark, a, b)
    extra = spark.createDataFrame([(1, 1, 2)], "image_id long, a long, b long")
    out = color.label(px, ("y", "x"), (12, 14), extra_edges=extra)
    assert [r.n for r in out.conflicts.collect()] == [0, 0]
    lut = {(r.image_id, r.label): r.color for r in out.colors.collect()}
    assert lut[1, 1] != lut[1, 2] and len({lut[0, 1], lut[0, 2]}) == 2


@pytest.mark.parametrize("name", ["raster_pixels", "connect_wrap", "format_first_seen", "components_per_label", "expand_l1_wrap", "expand_clean_l2", "two_hop", "label_full", "fill_holes", "face_count"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans.rasters import ORACLE, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: sorted(str([None if v is None or v != v else int(v) for v in r]) for r in df[cols].values.tolist())
    assert plain(got) == plain(want)
