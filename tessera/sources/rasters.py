"""Pixel relations: image_id, one column an axis, label. Background (0) is absent.

Sources: boxes derived from `orders` (deterministic integer arithmetic), dense
array columns, parquet. Integer label types only; values are kept as long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE, SHAPE_3D = (48, 48), (14, 48, 48)
AXES = ("y", "x")
AXES_3D = ("z", "y", "x")
INTEGER = {"tinyint", "smallint", "int", "bigint"}


def order_boxes(spark: SparkSession, sf_dir: str, solid: bool = False) -> DataFrame:
    """Each order is a box of its image; where boxes overlap, the largest label wins.
    Boxes are dealt by image before they become pixels, which then lie by image without
    an exchange of their own. The number of partitions is given, as the plan sees only
    the bytes of boxes and would merge them into few."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    o = o.withColumn("image_id", F.expr("o_orderkey DIV 64")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    cells = o.selectExpr(
        "image_id", "o_orderkey % 64 + 1 AS label",
        "(o_orderkey * 7919 + o_custkey * 31) % 44 AS y0", "(o_orderkey * 104729 + o_custkey * 17) % 44 AS x0",
        "2 + o_custkey % 3 AS h", "2 + o_orderkey % 4 AS w", "o_custkey % 12 AS z0", "1 + o_orderkey % 2 AS t",
    )
    px = cells.withColumn("y", F.explode(F.expr("sequence(y0, y0 + h - 1)"))).withColumn("x", F.explode(F.expr("sequence(x0, x0 + w - 1)")))
    axes = list(AXES)
    if solid:
        px, axes = px.withColumn("z", F.explode(F.expr("sequence(z0, z0 + t - 1)"))), list(AXES_3D)
    return px.groupBy("image_id", *axes).agg(F.max("label").alias("label"))


def from_arrays(images: DataFrame, column: str = "pixels", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Dense nested arrays, one level an axis, to pixels; background is dropped."""
    out = images.select("image_id", F.col(column).alias("__rest"))
    for axis in axes:
        kept = [c for c in out.columns if c != "__rest"]
        out = out.select(*kept, F.posexplode("__rest").alias(axis, "__rest"))
    return check(out.withColumnRenamed("__rest", "label")).where("label <> 0")


def check(pixels: DataFrame) -> DataFrame:
    """Only integer labels; kept as long, so none is cut off."""
    kind = dict(pixels.dtypes)["label"]
    if kind not in INTEGER:
        raise ValueError(f"labels must be integers, not {kind}")
    return pixels.withColumn("label", F.col("label").cast("long"))


def write(pixels: DataFrame, path: str) -> None:
    """Parquet, files sorted by image so that readers can skip."""
    pixels.repartition("image_id").sortWithinPartitions("image_id").write.mode("overwrite").parquet(path)
