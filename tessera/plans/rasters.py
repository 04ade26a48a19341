"""Queries over rasters derived from the parquet tables, and their SQL.

QUERIES: name -> (spark, sf_dir) -> DataFrame. ORACLE: name -> DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import adjacency, color, compact, distance, graphs, regions, spurs
from tessera.operators.images import joined, whole
from tessera.sources.rasters import AXES, AXES_3D, SHAPE, SHAPE_3D, order_boxes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H, W = SHAPE

# ---- SQL pieces -------------------------------------------------------------

_CELLS = """cells AS (
  SELECT o_orderkey // 64 AS image_id, o_orderkey % 64 + 1 AS label, (o_orderkey * 7919 + o_custkey * 31) % 44 AS y0,
    (o_orderkey * 104729 + o_custkey * 17) % 44 AS x0, 2 + o_custkey % 3 AS h, 2 + o_orderkey % 4 AS w,
    o_custkey % 12 AS z0, 1 + o_orderkey % 2 AS t FROM orders)"""
_PIXELS = _CELLS + """, pixels AS (
  SELECT image_id, y0 + dy AS y, x0 + dx AS x, max(label) AS label FROM cells, unnest(range(h)) a(dy), unnest(range(w)) b(dx) GROUP BY ALL)"""
_SOLID = _CELLS + """, pixels AS (
  SELECT image_id, z0 + dz AS z, y0 + dy AS y, x0 + dx AS x, max(label) AS label
  FROM cells, unnest(range(h)) a(dy), unnest(range(w)) b(dx), unnest(range(t)) c(dz) GROUP BY ALL)"""


def _values(table: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(str, o)) + ')' for o in table)}) o({names})"


def _offsets(conn: int, radius: int = 1, both: bool = False, ndim: int = 2) -> list[tuple]:
    from itertools import product

    every = [o for o in product(range(-radius, radius + 1), repeat=ndim) if 1 <= sum(map(bool, o)) <= conn]
    return every if both else [o for o in every if o > (0,) * ndim]


def _touching(source: str, table: list[tuple], names: str = "dy, dx", wrap: bool = False, extra: str = "") -> str:
    y, x = ("(a.y + dy + 48) % 48", "(a.x + dx + 48) % 48") if wrap else ("a.y + dy", "a.x + dx")
    return f"""SELECT a.image_id, least(a.label, b.label) AS lo, greatest(a.label, b.label) AS hi{extra}
      FROM {source} a, {_values(table, names)}, {source} b
      WHERE b.image_id = a.image_id AND b.y = {y} AND b.x = {x} AND a.label <> b.label AND a.label > 0 AND b.label > 0"""


def _edges(source: str, table: list[tuple], **more) -> str:
    return f"SELECT image_id, lo, hi, count(*) AS contact FROM ({_touching(source, table, **more)}) GROUP BY ALL"


def _expanded(p: int, wrap: bool = False, source: str = "pixels") -> str:
    def one(axis: str, table: str, d: str, label: str, keep: str, name: str) -> str:
        ghost = ", (VALUES (-1), (0), (1)) g(k)" if wrap else ""
        v = f"({axis} + 48 * k)" if wrap else axis
        if p == 2:
            key = f"d := {d} + (i - {v}) * (i - {v}), t := -{v}, c := 0"
        else:
            side = f"CASE WHEN k = 0 THEN CAST({axis} > i AS INT) WHEN k = -1 THEN 2 ELSE 3 END" if wrap else f"CAST({axis} > i AS INT)"
            key = f"d := {d} + abs(i - {v}), t := {side}, c := abs(i - {v})"
        return f"""{name} AS (SELECT image_id, {keep}, i AS {axis}_, min(struct_pack({key}, label := {label})) AS s
          FROM {table}, range(48) r(i){ghost} GROUP BY image_id, {keep}, i)"""

    ex = one("x", source, "0", "label", "y", "ex")
    ey = one("y", "(SELECT image_id, y, x_ AS x, s FROM ex)", "s.d", "s.label", "x", "ey")
    return f"{ex}, {ey}, expanded AS (SELECT image_id, y_ AS y, x, CAST(s.label AS BIGINT) AS label, CAST(s.d AS BIGINT) AS d FROM ey)"


_FACES = _offsets(1, both=True)
_WINDOW = _offsets(2, both=True)


def _same(source: str, table: list[tuple], select: str) -> str:
    return f"""SELECT a.image_id, a.y, a.x, {select} FROM {source} a, {_values(table, 'dy, dx')}, {source} b
      WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label GROUP BY ALL"""


def _stubs(source: str) -> str:
    own = "count(*) AS total, sum(CAST(abs(dy) + abs(dx) = 1 AS INT)) AS face, sum(dy) AS sy, sum(dx) AS sx"
    return f"""SELECT p.image_id, p.y, p.x, p.label FROM {source} p LEFT JOIN ({_same(source, _WINDOW, own)}) n USING (image_id, y, x)
      WHERE coalesce(face, 0) <= 1 OR face = 2 AND total = 2 AND sy = 0 AND sx = 0"""


def _peel(first: str, rounds: int, name: str, threshold: int = 1, thin_first: bool = False) -> str:
    """CTEs name0 ... of so many rounds that zero pixels with at most threshold faces."""
    out, now = [], first
    for k in range(rounds):
        thin = ""
        if thin_first and k == 0:
            own = "count(*) AS total, sum(dy) AS sy, sum(dx) AS sx"
            out.append(f"{name}_thin AS MATERIALIZED (SELECT image_id, y, x FROM ({_same(now, _WINDOW, own)}) WHERE total = 2 AND sy = 0 AND sx = 0)")
            thin = f" AND NOT EXISTS (SELECT 1 FROM {name}_thin t WHERE t.image_id = p.image_id AND t.y = p.y AND t.x = p.x)"
        out.append(f"{name}{k} AS MATERIALIZED (SELECT p.* FROM {now} p JOIN ({_same(now, _FACES, 'count(*) AS n')}) n USING (image_id, y, x) WHERE n > {threshold}{thin})")
        now = f"{name}{k}"
    return ", ".join(out)


def _components(source: str, table: list[tuple], per_label: bool = False) -> str:
    """A keyed recursion that lowers each pixel's root to the least around it."""
    same = " AND n.label = p.label" if per_label else ""
    return f"""near AS MATERIALIZED (SELECT p.image_id, p.y, p.x, n.y AS ny, n.x AS nx FROM {source} p, {_values(table, 'dy, dx')}, {source} n
        WHERE n.image_id = p.image_id AND n.y = p.y + dy AND n.x = p.x + dx{same}),
      cc(image_id, y, x, root) USING KEY (image_id, y, x) AS (
        SELECT image_id, y, x, y * 48 + x FROM {source}
        UNION
        SELECT n.image_id, n.ny, n.nx, min(c.root) FROM cc c JOIN near n ON n.image_id = c.image_id AND n.y = c.y AND n.x = c.x
          JOIN recurring.cc o ON o.image_id = n.image_id AND o.y = n.ny AND o.x = n.nx WHERE c.root < o.root GROUP BY ALL),
      comps AS (SELECT cc.image_id, cc.y, cc.x, label, root FROM cc JOIN {source} USING (image_id, y, x)),
      ranked AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS BIGINT) AS component FROM comps)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- sources, casts ---------------------------------------------------------


@query(f"WITH {_PIXELS} SELECT * FROM pixels")
def raster_pixels(spark, sf_dir):
    return order_boxes(spark, sf_dir)


@query(f"""WITH {_PIXELS}, dense AS (SELECT image_id, i // 48 AS y, i % 48 AS x FROM (SELECT DISTINCT image_id FROM pixels), range(2304) r(i))
  SELECT image_id, y, x, CAST(coalesce(label, 0) AS INT) AS label, label IS NULL AS is_background FROM dense LEFT JOIN pixels USING (image_id, y, x)""")
def raster_cast_bg(spark, sf_dir):
    every = whole(order_boxes(spark, sf_dir), AXES, SHAPE).withColumn("label", F.col("label").cast("int"))
    return every.withColumn("is_background", F.col("label") == 0)


# ---- compaction -------------------------------------------------------------


@query(f"WITH {_PIXELS} SELECT image_id, min(label) AS low, max(label) AS high FROM pixels GROUP BY ALL")
def label_bounds(spark, sf_dir):
    return compact.bounds(order_boxes(spark, sf_dir))


@query(f"WITH {_PIXELS} SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS BIGINT) AS label FROM pixels")
def format_ascending(spark, sf_dir):
    return compact.format_labels(order_boxes(spark, sf_dir), AXES, SHAPE)


_FIRST = "SELECT image_id, label, min(y * 48 + x) AS pos FROM {0} GROUP BY ALL"


@query(f"""WITH {_PIXELS}, f AS ({_FIRST.format('pixels')}), r AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos) AS BIGINT) AS n FROM f)
  SELECT image_id, y, x, n AS label FROM pixels JOIN r USING (image_id, label)""")
def format_first_seen(spark, sf_dir):
    return compact.format_labels(order_boxes(spark, sf_dir), AXES, SHAPE, order_first_seen=True)


@query(f"""WITH {_PIXELS}, s AS (SELECT image_id, y, x, label - 5 AS label FROM pixels),
  m AS (SELECT image_id, least(min(label), 0) AS low FROM s GROUP BY ALL), t AS (SELECT image_id, y, x, label - low AS label FROM s JOIN m USING (image_id) WHERE label - low > 0)
  SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS BIGINT) AS label FROM t""")
def format_negative_bg(spark, sf_dir):
    return compact.format_labels(order_boxes(spark, sf_dir).withColumn("label", F.col("label") - 5), AXES, SHAPE)


def _clean_sql(source: str, before: str = "") -> str:
    return f"""WITH RECURSIVE {_PIXELS}{before}, {_components(source, _WINDOW, True)},
      big AS (SELECT image_id, root FROM comps GROUP BY ALL HAVING count(*) >= 9),
      n AS (SELECT image_id, root, CAST(row_number() OVER (PARTITION BY image_id ORDER BY root) AS BIGINT) AS label FROM big)
      SELECT image_id, y, x, n.label FROM comps JOIN n USING (image_id, root)"""


@query(_clean_sql("pixels"))
def format_clean_min_area(spark, sf_dir):
    return compact.format_labels(order_boxes(spark, sf_dir), AXES, SHAPE, clean=True)


@query(_clean_sql("s11", ", " + _peel("pixels", 12, "s", thin_first=True)))
def format_clean_despur(spark, sf_dir):
    return compact.format_labels(order_boxes(spark, sf_dir), AXES, SHAPE, clean=True, despur=True)


# ---- adjacency --------------------------------------------------------------


@query(f"WITH {_PIXELS} {_edges('pixels', _offsets(1))}")
def connect_c1(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 1)


@query(f"WITH {_PIXELS} {_edges('pixels', _offsets(2))}")
def connect_c2(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 2)


@query(f"WITH {_PIXELS} {_edges('pixels', _offsets(2, 2))}")
def connect_r2(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 2, radius=2)


@query(f"WITH {_PIXELS} {_edges('pixels', _offsets(2), wrap=True)}")
def connect_wrap(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 2, wrap=True, shape=SHAPE)


@query(f"""WITH {_SOLID}, t AS (SELECT a.image_id, least(a.label, b.label) AS lo, greatest(a.label, b.label) AS hi
  FROM pixels a, {_values(_offsets(3, ndim=3), 'dz, dy, dx')}, pixels b
  WHERE b.image_id = a.image_id AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a.label <> b.label)
  SELECT image_id, lo, hi, count(*) AS contact FROM t GROUP BY ALL""")
def connect_3d_c3(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir, solid=True), AXES_3D, 3)


def _weight_sql(value: str) -> str:
    cost = ", a.d + b.d AS c"
    return f"""WITH {_PIXELS}, {_expanded(2)}, t AS ({_touching('expanded', _offsets(1), extra=cost)})
      SELECT image_id, lo, hi, round({value}, 9) AS w FROM t GROUP BY image_id, lo, hi"""


def _weight_query(mode: str, value: str) -> None:
    def run(spark, sf_dir):
        reduced = distance.reduce_expanded(order_boxes(spark, sf_dir), AXES, SHAPE)
        return adjacency.weights(reduced, mode).withColumn("w", F.round("w", 9))

    run.__name__ = f"edge_weight_{mode.replace('_', '')}"
    query(_weight_sql(value))(run)


for _mode, _value in (
    ("min", "1 / (1.0::DOUBLE + min(c))"), ("max", "1 / (1.0::DOUBLE + max(c))"), ("mean", "1 / (1.0::DOUBLE + avg(c))"),
    ("count", "count(*)::DOUBLE"), ("harmonic", "sum(1.0::DOUBLE / (1 + c))"), ("mean_inv", "avg(1.0::DOUBLE / (1 + c))"),
):
    _weight_query(_mode, _value)


@query(f"WITH {_PIXELS} SELECT * FROM ({_edges('pixels', _offsets(2, 2))}) WHERE contact >= 4")
def edge_min_contact(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 2, radius=2, min_contact=4)


_DUAL = [(*o, int(sum(map(abs, o)) == 1)) for o in _offsets(2, 2)]


@query(f"""WITH {_PIXELS}, t AS ({_touching('pixels', _DUAL, 'dy, dx, base', extra=', base = 1 AS base')})
  SELECT image_id, lo, hi, bool_or(base) AS is_hard, bool_or(NOT base) AS is_soft FROM t GROUP BY ALL""")
def edge_hard_soft_dual(spark, sf_dir):
    return adjacency.hard_and_soft(order_boxes(spark, sf_dir), AXES)


def _extra(spark, sf_dir):
    """For the queries with extra edges: the smallest label of an image must differ from its largest."""
    return order_boxes(spark, sf_dir).groupBy("image_id").agg(F.min("label").alias("a"), F.max("label").alias("b"))


@query(f"""WITH {_PIXELS}, e AS ({_edges('pixels', _offsets(1))} UNION ALL
  SELECT image_id, min(label), max(label), 0 FROM pixels GROUP BY image_id HAVING min(label) <> max(label))
  SELECT image_id, lo, hi, CAST(max(contact) AS BIGINT) AS contact FROM e GROUP BY ALL""")
def edge_extra(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 1, extra_edges=_extra(spark, sf_dir))


@query(f"""WITH {_PIXELS}, px AS MATERIALIZED (SELECT * FROM pixels), s AS (SELECT image_id, y + dy AS y, x + dx AS x, label, 1 AS one FROM px, {_values(_FACES, 'dy, dx')} UNION ALL SELECT image_id, y, x, label, 0 FROM px),
  f AS (SELECT image_id, y, x, label, sum(one) AS n, min(one) AS own FROM s GROUP BY ALL) SELECT image_id, y, x, label, CAST(n AS BIGINT) AS n FROM f WHERE own = 0""")
def face_count(spark, sf_dir):
    return adjacency.face_count(order_boxes(spark, sf_dir), AXES)


@query(f"""WITH {_PIXELS}, e AS ({_edges('pixels', _offsets(2))}), f AS ({_same('pixels', _FACES, 'count(*) AS n')}),
  s AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS faces FROM f GROUP BY ALL)
  SELECT image_id, lo, hi, contact, faces FROM e JOIN s USING (image_id)""")
def pairs_with_face_count(spark, sf_dir):
    pairs, faces = adjacency.pairs_with_faces(order_boxes(spark, sf_dir), AXES)
    return joined(pairs, faces.groupBy("image_id").agg(F.sum("n").alias("faces")), "image_id")


# ---- regions ----------------------------------------------------------------


@query(f"""WITH {_PIXELS}, own AS (SELECT image_id, label, count(*) AS area, min(y) AS min_y, max(y) + 1 AS max_y, avg(y) AS centroid_y,
    min(x) AS min_x, max(x) + 1 AS max_x, avg(x) AS centroid_x FROM pixels GROUP BY ALL),
  every AS (SELECT image_id, unnest(range(1, max(label) + 1)) AS label FROM own GROUP BY image_id)
  SELECT e.image_id, e.label, coalesce(area, 0) AS area, coalesce(min_y, 0) AS min_y, coalesce(max_y, 0) AS max_y, coalesce(round(centroid_y, 9), 0) AS centroid_y,
    coalesce(min_x, 0) AS min_x, coalesce(max_x, 0) AS max_x, coalesce(round(centroid_x, 9), 0) AS centroid_x FROM every e LEFT JOIN own USING (image_id, label)""")
def regionprops(spark, sf_dir):
    out = regions.regionprops(order_boxes(spark, sf_dir), AXES)
    return out.withColumns({f"centroid_{a}": F.round(f"centroid_{a}", 9) for a in AXES})


@query(f"""WITH {_PIXELS}, m AS (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, avg(y * y) AS yy, avg(x * x) AS xx, avg(y * x) AS yx FROM pixels GROUP BY ALL),
  c AS (SELECT *, yy - cy * cy AS a, yx - cy * cx AS b, xx - cx * cx AS c FROM m), r AS (SELECT *, sqrt((a - c) * (a - c) / 4 + b * b) AS root FROM c),
  e AS (SELECT *, greatest((a + c) / 2 + root, 1e-6) AS big, greatest((a + c) / 2 - root, 1e-6) AS small FROM r)
  SELECT image_id, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, CASE WHEN area < 3 THEN 0 ELSE round(sqrt(1 - small / big), 6) END AS eccentricity FROM e""")
def region_geometry(spark, sf_dir):
    g = regions.geometry(order_boxes(spark, sf_dir))
    return g.select("image_id", "label", "area", *[F.round(c, 6).alias(c) for c in ("cy", "cx", "eccentricity")])


@query(f"""WITH {_PIXELS}, n AS (SELECT image_id, label % 4 AS color, count(DISTINCT label) AS n FROM pixels GROUP BY ALL)
  SELECT image_id, count(*) AS n_colors, max(n) - min(n) AS spread, round(stddev_pop(n), 9) AS deviation FROM n GROUP BY ALL""")
def color_balance(spark, sf_dir):
    cells = order_boxes(spark, sf_dir).select("image_id", "label").distinct().withColumn("color", F.col("label") % 4)
    return regions.color_balance(cells).withColumn("deviation", F.round("deviation", 9))


@query(f"WITH RECURSIVE {_PIXELS}, {_components('pixels', _FACES)} SELECT image_id, y, x, component FROM ranked")
def components_c1(spark, sf_dir):
    return regions.connected_components(order_boxes(spark, sf_dir), AXES, SHAPE, 1).drop("label")


@query(f"WITH RECURSIVE {_PIXELS}, {_components('pixels', _WINDOW)} SELECT image_id, y, x, component FROM ranked")
def components_c2(spark, sf_dir):
    return regions.connected_components(order_boxes(spark, sf_dir), AXES, SHAPE, 2).drop("label")


@query(f"WITH RECURSIVE {_PIXELS}, {_components('pixels', _WINDOW, True)} SELECT image_id, y, x, label, component FROM ranked")
def components_per_label(spark, sf_dir):
    return regions.connected_components(order_boxes(spark, sf_dir), AXES, SHAPE, 2, per_label=True)


# ---- expansion --------------------------------------------------------------


def _expand_query(name: str, p: int, wrap: bool) -> None:
    def run(spark, sf_dir):
        return distance.expand_labels(order_boxes(spark, sf_dir), AXES, SHAPE, p, wrap)

    run.__name__ = name
    query(f"WITH {_PIXELS}, {_expanded(p, wrap)} SELECT * FROM expanded")(run)


for _name, _p, _wrap in (("expand_l1", 1, False), ("expand_l2", 2, False), ("expand_l1_wrap", 1, True), ("expand_l2_wrap", 2, True)):
    _expand_query(_name, _p, _wrap)


@query(f"WITH {_PIXELS}, {_expanded(2)} SELECT * FROM expanded")
def expand_l2_by_lines(spark, sf_dir):
    return distance.expand_labels(order_boxes(spark, sf_dir), AXES, SHAPE, dense_limit=0)


@query(f"WITH {_PIXELS}, {_expanded(2)} SELECT image_id, y, x, label, round(sqrt(d), 9) AS distance FROM expanded")
def expand_with_dist(spark, sf_dir):
    grown = distance.with_distance(distance.expand_labels(order_boxes(spark, sf_dir), AXES, SHAPE))
    return grown.drop("d").withColumn("distance", F.round("distance", 9))


@query()
def expand_3d_l2(spark, sf_dir):
    return distance.expand_labels(order_boxes(spark, sf_dir, solid=True), AXES_3D, SHAPE_3D)


_CLASSES = "SELECT image_id, y, x, label % 3 AS label FROM pixels WHERE label % 3 > 0"


def _class_sql(c: int) -> str:
    own = _expanded(2, source=f"(SELECT * FROM classes WHERE label = {c})")
    return f"SELECT image_id, y, x, label AS class, round(sqrt(d), 9) AS distance FROM (WITH {own} SELECT * FROM expanded)"


@query(f"WITH {_PIXELS}, classes AS ({_CLASSES}) {_class_sql(1)} UNION ALL {_class_sql(2)}")
def class_min_edt(spark, sf_dir):
    px = order_boxes(spark, sf_dir)
    classes = spark.range(1, 65).selectExpr("id AS label", "id % 3 AS class")
    return distance.per_class_min(px, classes, AXES, SHAPE).withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_PIXELS}, full_px AS (SELECT image_id, y, x FROM ({_same('pixels', _FACES, 'count(*) AS n')}) WHERE n = 4),
  rim AS (SELECT * FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM full_px f WHERE f.image_id = p.image_id AND f.y = p.y AND f.x = p.x))
  SELECT a.image_id, a.label AS lo, b.label AS hi, round(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 9) AS distance
  FROM rim a JOIN rim b ON a.image_id = b.image_id AND a.label < b.label GROUP BY ALL""")
def pairwise_nearest(spark, sf_dir):
    return distance.nearest_pairs(order_boxes(spark, sf_dir), AXES).withColumn("distance", F.round("distance", 9))


# ---- clean expansion, spurs -------------------------------------------------


@query(f"WITH {_PIXELS} {_stubs('pixels')}")
def bridge_stub_mask(spark, sf_dir):
    return adjacency.bridges_and_stubs(order_boxes(spark, sf_dir), AXES)


def _clean_expand(name: str, p: int) -> None:
    def run(spark, sf_dir):
        return distance.expand_labels(order_boxes(spark, sf_dir), AXES, SHAPE, p, mode="clean")

    run.__name__ = name
    sql = f"""WITH {_PIXELS}, {_expanded(p)}, grown AS MATERIALIZED (SELECT image_id, y, x, label FROM expanded), bad AS MATERIALIZED ({_stubs('grown')}),
      k AS MATERIALIZED (SELECT * FROM grown g WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.image_id = g.image_id AND b.y = g.y AND b.x = g.x)),
      {_peel('k', 16, 'c')} SELECT image_id, y, x, label FROM c15"""
    query(sql)(run)


_clean_expand("expand_clean_l1", 1)
_clean_expand("expand_clean_l2", 2)


def _prune(first: str, rounds: int, table: list[tuple], least: int) -> str:
    out, now = [], first
    for k in range(rounds):
        out.append(f"""q{k} AS MATERIALIZED (SELECT p.* FROM {now} p LEFT JOIN ({_same(now, table, 'count(*) AS n')}) n USING (image_id, y, x)
          WHERE coalesce(n, 0) = 0 OR n >= {least})""")
        now = f"q{k}"
    return ", ".join(out)


_MASK = "mask AS MATERIALIZED (SELECT image_id, y, x, CAST(1 AS BIGINT) AS label FROM pixels)"


@query(f"WITH {_PIXELS}, {_MASK}, {_prune('mask', 4, _FACES, 2)} SELECT image_id, y, x, label FROM q3")
def spurs_binary_cardinal(spark, sf_dir):
    return spurs.delete_spurs(order_boxes(spark, sf_dir), AXES, SHAPE, hole_threshold=0, max_iter=4, kind="binary")


@query(f"WITH {_PIXELS}, {_MASK}, {_prune('mask', 3, _WINDOW, 4)} SELECT image_id, y, x, label FROM q2")
def spurs_binary_total(spark, sf_dir):
    return spurs.delete_spurs(order_boxes(spark, sf_dir), AXES, SHAPE, hole_threshold=0, mode="total", threshold=4, max_iter=3, kind="binary")


@query(f"""WITH RECURSIVE {_PIXELS}, px AS MATERIALIZED (SELECT * FROM pixels),
  bg AS MATERIALIZED (SELECT g.image_id, g.y, g.x FROM (SELECT image_id, i // 48 AS y, i % 48 AS x FROM (SELECT DISTINCT image_id FROM px), range(2304) r(i)) g
    ANTI JOIN px USING (image_id, y, x)),
  runs AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS h, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS v FROM bg),
  sized AS (SELECT image_id, y, x, count(*) OVER (PARTITION BY image_id, y, h) AS w, count(*) OVER (PARTITION BY image_id, x, v) AS t FROM runs),
  narrow AS MATERIALIZED (SELECT image_id, y, x, CAST(1 AS BIGINT) AS label FROM sized WHERE w <= 5 AND t <= 5), {_components('narrow', _FACES)},
  leak AS (SELECT DISTINCT c.image_id, c.root FROM comps c, {_values(_FACES, 'dy, dx')}, bg b WHERE b.image_id = c.image_id AND b.y = c.y + dy AND b.x = c.x + dx
    AND NOT EXISTS (SELECT 1 FROM narrow n WHERE n.image_id = b.image_id AND n.y = b.y AND n.x = b.x)),
  hole AS (SELECT image_id, root FROM comps GROUP BY ALL HAVING count(*) <= 5 AND min(y) > 0 AND max(y) < 47 AND min(x) > 0 AND max(x) < 47)
  SELECT image_id, y, x, CAST(1 AS BIGINT) AS label FROM px UNION ALL
  SELECT c.image_id, c.y, c.x, 1 FROM comps c JOIN hole h ON h.image_id = c.image_id AND h.root = c.root ANTI JOIN leak l ON l.image_id = c.image_id AND l.root = c.root""")
def fill_holes(spark, sf_dir):
    return spurs.delete_spurs(order_boxes(spark, sf_dir), AXES, SHAPE, max_iter=0, kind="binary")


@query(f"WITH {_PIXELS}, {_peel('pixels', 12, 's')} SELECT * FROM s11")
def spurs_labels(spark, sf_dir):
    return spurs.delete_spurs(order_boxes(spark, sf_dir), AXES, SHAPE)


@query(f"WITH {_PIXELS}, {_peel('pixels', 12, 's', thin_first=True)} SELECT * FROM s11")
def spurs_thin(spark, sf_dir):
    return spurs.delete_spurs(order_boxes(spark, sf_dir), AXES, SHAPE, remove_thin=True)


@query(f"WITH {_PIXELS}, {_peel('pixels', 14, 's', 2)} SELECT * FROM s13")
def despur_core(spark, sf_dir):
    return spurs.core(order_boxes(spark, sf_dir), AXES, SHAPE, 2)


@query(f"""WITH {_PIXELS}, {_peel('pixels', 12, 's')}, a AS (SELECT image_id, count(*) AS a FROM pixels GROUP BY ALL), b AS (SELECT image_id, count(*) AS b FROM s11 GROUP BY ALL)
  SELECT image_id, a - coalesce(b, 0) AS n_removed FROM a LEFT JOIN b USING (image_id)""")
def spurs_removed(spark, sf_dir):
    px = order_boxes(spark, sf_dir)
    return spurs.removed(px, spurs.delete_spurs(px, AXES, SHAPE))


# ---- graphs -----------------------------------------------------------------

_E1 = f"e AS MATERIALIZED (SELECT image_id, lo, hi FROM ({_edges('pixels', _offsets(2))}))"
_BOTH = "s AS MATERIALIZED (SELECT image_id, lo AS u, hi AS v FROM e UNION ALL SELECT image_id, hi, lo FROM e)"


def _c2(spark, sf_dir):
    return adjacency.connect(order_boxes(spark, sf_dir), AXES, 2)


@query(f"WITH {_PIXELS}, {_E1}, {_BOTH} SELECT image_id, u, v FROM s")
def symmetric_pairs(spark, sf_dir):
    return graphs.symmetric(_c2(spark, sf_dir))


@query(f"WITH {_PIXELS}, {_E1}, {_BOTH} SELECT image_id, u, array_to_string(list_sort(list(v)), ',') AS near FROM s GROUP BY ALL")
def adjacency_lists(spark, sf_dir):
    return graphs.adjacency_lists(_c2(spark, sf_dir)).withColumn("near", F.concat_ws(",", F.col("near").cast("array<string>")))


@query(f"""WITH {_PIXELS}, {_E1}, {_BOTH} SELECT DISTINCT a.image_id, a.u, b.v FROM s a JOIN s b ON a.image_id = b.image_id AND a.v = b.u AND a.u <> b.v
  WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.image_id = a.image_id AND c.u = a.u AND c.v = b.v)""")
def two_hop(spark, sf_dir):
    return graphs.two_hop(_c2(spark, sf_dir))


@query(f"""WITH {_PIXELS}, {_E1}, {_BOTH}, n AS (SELECT e.image_id, lo, hi, count(*) AS n FROM e JOIN s a ON a.image_id = e.image_id AND a.u = e.lo
  JOIN s b ON b.image_id = e.image_id AND b.u = e.hi AND b.v = a.v GROUP BY ALL) SELECT image_id, lo, hi, 1 + coalesce(n, 0) AS w FROM e LEFT JOIN n USING (image_id, lo, hi)""")
def soft_triangle_weights(spark, sf_dir):
    return graphs.triangle_weights(_c2(spark, sf_dir))


@query(f"""WITH {_PIXELS}, {_E1} SELECT a.image_id, a.lo AS v1, a.hi AS v2, b.hi AS v3, c.hi AS v4 FROM e a
  JOIN e b ON b.image_id = a.image_id AND b.lo = a.hi JOIN e c ON c.image_id = a.image_id AND c.lo = b.hi
  WHERE EXISTS (SELECT 1 FROM e x WHERE x.image_id = a.image_id AND x.lo = a.lo AND x.hi = b.hi)
    AND EXISTS (SELECT 1 FROM e x WHERE x.image_id = a.image_id AND x.lo = a.lo AND x.hi = c.hi)
    AND EXISTS (SELECT 1 FROM e x WHERE x.image_id = a.image_id AND x.lo = a.hi AND x.hi = c.hi)""")
def clique_k4(spark, sf_dir):
    return graphs.cliques(_c2(spark, sf_dir), 4)


_COLOR = "c AS MATERIALIZED (SELECT DISTINCT image_id, label, label % 4 + 1 AS color FROM pixels)"


def _fixed_colors(spark, sf_dir):
    return order_boxes(spark, sf_dir).select("image_id", "label").distinct().withColumn("color", F.col("label") % 4 + 1)


@query(f"WITH {_PIXELS}, {_E1}, {_COLOR} SELECT e.image_id, lo, hi, a.color FROM e JOIN c a ON a.image_id = e.image_id AND a.label = lo JOIN c b ON b.image_id = e.image_id AND b.label = hi AND b.color = a.color")
def conflicts(spark, sf_dir):
    return graphs.conflicts(_c2(spark, sf_dir), _fixed_colors(spark, sf_dir))


@query(f"WITH {_PIXELS}, {_E1}, {_COLOR} SELECT e.image_id, count(*) AS n FROM e JOIN c a ON a.image_id = e.image_id AND a.label = lo JOIN c b ON b.image_id = e.image_id AND b.label = hi AND b.color = a.color GROUP BY ALL")
def soft_penalty(spark, sf_dir):
    return graphs.soft_penalty(_c2(spark, sf_dir), _fixed_colors(spark, sf_dir))


# ---- coloring ---------------------------------------------------------------


@query(f"""WITH RECURSIVE {_PIXELS}, {_E1}, {_BOTH}, v AS (SELECT DISTINCT image_id, label FROM pixels),
  o AS MATERIALIZED (SELECT v.image_id, v.label, row_number() OVER (PARTITION BY v.image_id ORDER BY coalesce(d, 0) DESC, v.label) AS k FROM v
    LEFT JOIN (SELECT image_id, u AS label, count(*) AS d FROM s GROUP BY ALL) USING (image_id, label)),
  near AS MATERIALIZED (SELECT o.image_id, o.label, o.k, n.label AS other FROM o JOIN s ON s.image_id = o.image_id AND s.u = o.label JOIN o n ON n.image_id = o.image_id AND n.label = s.v AND n.k < o.k),
  g(image_id, label, k, color) USING KEY (image_id, label) AS (
    SELECT image_id, label, k, CAST(1 AS BIGINT) FROM o WHERE k = 1
    UNION
    SELECT o.image_id, o.label, o.k, (SELECT min(i) FROM range(1, 66) r(i) WHERE NOT list_contains(coalesce(u.used, []), i)) FROM o
      JOIN (SELECT DISTINCT image_id, k FROM g) l ON l.image_id = o.image_id AND o.k = l.k + 1
      LEFT JOIN (SELECT n.image_id, n.label, list(c.color) AS used FROM near n JOIN recurring.g c ON c.image_id = n.image_id AND c.label = n.other GROUP BY ALL) u
        ON u.image_id = o.image_id AND u.label = o.label)
  SELECT image_id, label, CAST(color AS INT) AS color FROM g""")
def color_greedy_wp(spark, sf_dir):
    cells = order_boxes(spark, sf_dir).select("image_id", "label").distinct()
    return color.greedy_colors(cells, _c2(spark, sf_dir))


def _report(out: color.Colored, most: int) -> DataFrame:
    """Each hard edge and whether its ends differ (an image without edges has one row
    without ends), with what any right answer has in common for the image."""
    px = out.pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), (F.min("color") >= 1).alias("all_colored"))
    labels = out.colors.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_labels"))
    few = out.n_used.select("image_id", (F.col("n_used") <= most).alias("few_colors"))
    images = joined(joined(px, labels, "image_id"), few, "image_id")
    same = graphs.conflicts(out.edges, out.colors).select("image_id", "lo", "hi", F.lit(False).alias("differ"))
    edges = joined(out.edges, same, ["image_id", "lo", "hi"], "left").withColumn("differ", F.coalesce("differ", F.lit(True)))
    return joined(images, edges, "image_id", "left")


_FMT = f"{_PIXELS}, fmt AS MATERIALIZED (SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS BIGINT) AS label FROM pixels)"
_GROWN = f"""{_FMT}, {_expanded(2, source='fmt')}, grown AS MATERIALIZED (SELECT image_id, y, x, label FROM expanded), bad AS MATERIALIZED ({_stubs('grown')}),
  k AS MATERIALIZED (SELECT * FROM grown g WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.image_id = g.image_id AND b.y = g.y AND b.x = g.x)), {_peel('k', 16, 'c')}"""


def _colored_sql(source: str, edges: str) -> str:
    return f"""WITH {source}, every AS MATERIALIZED ({edges}), e AS (SELECT image_id, lo, hi FROM every GROUP BY ALL),
      i AS (SELECT image_id, count(*) AS n_pixels, true AS all_colored, count(DISTINCT label) AS n_labels, true AS few_colors FROM pixels GROUP BY ALL)
      SELECT i.*, lo, hi, CASE WHEN lo IS NOT NULL THEN true END AS differ FROM i LEFT JOIN e USING (image_id)"""


@query(_colored_sql(_GROWN, _touching("c15", _offsets(1))))
def label_full(spark, sf_dir):
    return _report(color.label(order_boxes(spark, sf_dir), AXES, SHAPE), 4)


@query(_colored_sql(_GROWN, _touching("c15", _offsets(1), wrap=True)))
def label_wrap(spark, sf_dir):
    return _report(color.label(order_boxes(spark, sf_dir), AXES, SHAPE, wrap=True), 7)


@query(_colored_sql(_FMT, _touching("fmt", _offsets(2))))
def label_unexpanded(spark, sf_dir):
    return _report(color.label(order_boxes(spark, sf_dir), AXES, SHAPE, expand=False, conn=2), 6)


@query(_colored_sql(_FMT, _touching("fmt", _offsets(2))))
def label_by_joins(spark, sf_dir):
    return _report(color.label(order_boxes(spark, sf_dir), AXES, SHAPE, expand=False, conn=2, dense_limit=0), 6)


@query(_colored_sql(_GROWN, _touching("c15", _offsets(1))))
def label_weighted(spark, sf_dir):
    return _report(color.label(order_boxes(spark, sf_dir), AXES, SHAPE, weight_objective="max", weight_mode="harmonic"), 5)


@query(f"""WITH {_SOLID} SELECT image_id, count(*) AS n_pixels, true AS all_colored, count(DISTINCT label) AS n_labels, true AS few_colors, CAST(0 AS BIGINT) AS n_conflicts
  FROM pixels GROUP BY ALL""")
def label_3d(spark, sf_dir):
    out = color.label(order_boxes(spark, sf_dir, solid=True), AXES_3D, SHAPE_3D, soft_conn=1, soft_radius=1)
    images = _report(out, 12).select("image_id", "n_pixels", "all_colored", "n_labels", "few_colors").distinct()
    return joined(images, out.conflicts.withColumnRenamed("n", "n_conflicts"), "image_id")


@query(_colored_sql(_GROWN, f"{_touching('c15', _offsets(1))} UNION ALL SELECT image_id, CAST(1 AS BIGINT), count(DISTINCT label) FROM pixels GROUP BY image_id HAVING count(DISTINCT label) > 1"))
def label_extra_edges(spark, sf_dir):
    px = order_boxes(spark, sf_dir)
    n = px.groupBy("image_id").agg(F.lit(1).cast("long").alias("a"), F.countDistinct("label").alias("b"))
    return _report(color.label(px, AXES, SHAPE, extra_edges=n), 5)


@query(f"WITH {_GROWN} SELECT f.image_id, f.y, f.x, true AS colored FROM fmt f JOIN c15 USING (image_id, y, x)")
def label_clean_mask(spark, sf_dir):
    out = color.label(order_boxes(spark, sf_dir), AXES, SHAPE, clean_mask=True)
    return out.pixels.select("image_id", "y", "x", F.col("color").between(1, 4).alias("colored"))


@query(f"WITH {_PIXELS} SELECT image_id, count(DISTINCT label) AS n_labels, true AS proper FROM pixels GROUP BY ALL")
def kempe_anneal(spark, sf_dir):
    px = order_boxes(spark, sf_dir)
    cells, edges = px.select("image_id", "label").distinct(), adjacency.connect(px, AXES, 1)
    pairs = adjacency.hard_and_soft(px, AXES).where("is_soft AND NOT is_hard").withColumn("w", F.lit(0.1))
    colors = color.anneal(cells, edges, pairs).persist()  # the search is long and its result used three times
    bad = graphs.conflicts(edges, colors).groupBy("image_id").agg(F.count(F.lit(1)).alias("bad"))
    n = colors.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_labels"))
    return joined(n, bad, "image_id", "left").select("image_id", "n_labels", F.col("bad").isNull().alias("proper"))
