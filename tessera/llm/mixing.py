"""Mixing sources to target weights, by Sainte-Lague apportionment, in DataFrame
operations alone.

1. A source's target is its weighted share of the wanted words; what exceeds
   `cap` times the source's size is reshared by weight until none exceeds it
   (the water level of a capped proportional division, found in one pass over
   the sources ordered by cap/weight).
2. Equal-token blocks are allotted to the sources by highest quotients
   target/1, target/3, target/5, ... : the seats of the divisor rounding, then
   the few seats missing or in excess settled by ranking the next quotients.
3. Each source is cut by hash into shards of some hundred documents, so a source
   with a third of all rows is many groups. A shard's quota is its divisor
   rounding of the source's blocks, an integer.
4. In a shard, documents lie in seeded order on a line of words cut into blocks.
   Whole rounds take every block; the rest of the quota is a run of blocks from
   a seeded start on the circle. A document's taken words are those of its
   interval in the chosen blocks.

Nulls: a null source is a source of its own, last in order; a null text has no
words. Ties in the seeded order fall back on doc_id, then on the text's hash, so
reruns agree; repeated rows are documents of their own. Sources without words
get target 0. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, unused


def _hash(*parts) -> F.Column:
    """A seeded 32-bit number that other SQL engines can reproduce."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _tie() -> F.Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """sources: source, source_size, n_docs (one row a source). Adds weight and target."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("i", F.row_number().over(every) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("i", F.lit(len(weights))) + 1).cast("int")).cast("double")
    )
    room = (F.col("source_size") * cap / F.col("weight")).alias("room")
    by_room = Window.orderBy("room", "i")
    all_rows = Window.orderBy("room", "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        ranked.withColumn("room", room)
        .withColumn("want", F.sum("source_size").over(all_rows) * share)
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("level", (F.col("want") - F.col("full")) / F.col("open"))
    )
    # Sources fill in order of room; the first that its level does not fill sets the level of all after it.
    stop = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "i", "level"))).over(all_rows)
    return level.withColumn("stop", stop["level"]).select(
        "source", "source_size", "n_docs", "i", "weight",
        F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(F.col("stop"), F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def apportion(table: DataFrame, block: int) -> DataFrame:
    """Adds blocks: Sainte-Lague seats of each source, the total target / block rounded."""
    all_rows = Window.partitionBy()
    quota = F.col("target") / block
    seats = table.withColumn("seats", F.floor(quota + 0.5)).withColumn(
        "miss", F.round(F.sum(quota).over(all_rows)) - F.sum("seats").over(all_rows)
    )
    # Sources short of or over the house: rank the next quotients up, or the last ones given.
    steps = F.explode(F.sequence(F.lit(0), F.greatest(F.abs("miss").cast("int") - 1, F.lit(0)))).alias("k")
    tried = seats.select("i", "target", "seats", "miss", steps).withColumn(
        "quotient",
        F.when(F.col("miss") > 0, F.col("target") / (2 * (F.col("seats") + F.col("k")) + 1)).otherwise(
            -F.col("target") / (2 * (F.col("seats") - F.col("k")) - 1)
        ),
    )
    usable = tried.where("miss > 0 and target > 0 or miss < 0 and seats - k > 0")
    chosen = usable.withColumn("rank", F.row_number().over(Window.orderBy(F.col("quotient").desc(), "i"))).where("rank <= abs(miss)")
    change = chosen.groupBy("i").agg(F.sum(F.signum("miss")).alias("change"))
    return seats.join(change, "i", "left").select(
        *table.columns, (F.col("seats") + F.coalesce("change", F.lit(0))).cast("long").alias("blocks")
    )


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
    block: int = 16,
    shard_docs: int = 250,
    seed: str = "mix",
) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, taken, shard, quota, tie (the text's hash)."""
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _tie().alias("tie"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = materialize(apportion(targets(sources, share, cap, weights), block), "mix-plan")
    by_source = sized["source"].eqNullSafe(plan["source"])
    lined = (
        sized.join(plan.drop("weight"), by_source, "left").drop(plan["source"])
        .withColumn("key", _hash(F.lit(seed), F.col("doc_id")))
        .withColumn("shard", F.pmod("key", F.ceil(F.col("n_docs") / shard_docs).cast("long")))
    )
    shard = Window.partitionBy("i", "shard")
    line = shard.orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = shard.orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = F.lit(block)
    placed = (
        lined.withColumn("stop", F.sum("size").over(line)).withColumn("shard_size", F.sum("size").over(whole))
        .withColumn("begin", F.col("stop") - F.col("size"))
        .withColumn("quota", F.floor(F.col("blocks") * F.col("shard_size") / F.greatest("source_size", F.lit(1)) + 0.5).cast("long"))
        .withColumn("quota", F.least("quota", F.floor(F.lit(cap) * F.col("shard_size") / b).cast("long") + 1))
        .withColumn("words", F.least(F.col("quota") * b, F.floor(F.lit(cap) * F.col("shard_size")).cast("long")))
        .withColumn("rounds", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.when(F.col("shard_size") > 0, F.col("words") - F.col("rounds") * F.col("shard_size")).otherwise(F.lit(0)))
        .withColumn("n_blocks", F.greatest(F.ceil(F.col("shard_size") / b).cast("long"), F.lit(1)))
        .withColumn("from", b * F.pmod(_hash(F.lit(seed), F.col("i"), F.col("shard")), F.col("n_blocks")))
        .withColumn("to", F.col("from") + F.col("left"))
    )
    overlap = lambda lo, hi: F.greatest(F.least("stop", hi) - F.greatest("begin", lo), F.lit(0))
    part = overlap(F.col("from"), F.least("to", F.col("shard_size"))) + overlap(F.lit(0), F.col("to") - F.col("shard_size"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        F.col("shard").cast("long").alias("shard"), "quota", "tie",
    )


def repeat_to_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, each as often as the mix takes its words, rounded; every
    column as it was. Rows without words are not taken. Rows of one doc_id (or
    without), source and text share their mean."""
    own = {c: unused(docs, c) for c in ("taken_id", "taken_source", "taken_text", "times", "time")}
    taken = mix_sources(docs, **parameters).groupBy(F.col("doc_id").alias(own["taken_id"]), F.col("source").alias(own["taken_source"]), F.col("tie").alias(own["taken_text"])).agg(
        F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias(own["times"])
    )
    same = (_tie() == F.col(own["taken_text"])) & F.col("doc_id").cast("long").eqNullSafe(F.col(own["taken_id"])) & F.col("source").cast("string").eqNullSafe(F.col(own["taken_source"]))
    joined = docs.join(taken.where(F.col(own["times"]) > 0), same)
    return joined.withColumn(own["time"], F.explode(F.sequence(F.lit(1), F.col(own["times"])))).select(*[docs[c] for c in docs.columns])
