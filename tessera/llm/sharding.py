"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group, and a group goes whole into one shard unless it exceeds a
shard's fair share in some dimension; then it is dealt out by doc_id in as many parts
as there are shards. Groups above 1/1024 of the corpus in some dimension (a few thousand at most) are
placed on their own, all lighter ones are pooled by hash into a bounded number of
cells. These items (at most some ten thousand, whatever the corpus size) are placed
on the driver, largest first, each into the shard where the dot product of its vector
with the shard's residual capacity is highest; then items change places where that
makes sizes more equal.

Slots are numbered without gaps inside pieces of items, so that a group of any size
is numbered by many tasks.

Nulls: a null text counts as an empty one; a null doc_id is placed like any other.
Repeated rows of one doc_id and text are counted, not shuffled. An empty table gives
an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, id_text, materialize

#: A group above this share of any total is placed on its own; a piece has about this share of the rows.
HEAVY = 1 / 1024
#: Rows that one task writes at once of a row that is there many times.
BLOCK = 10_000


def pack(vectors: np.ndarray, n_shards: int, rounds: int = 200) -> np.ndarray:
    """Shard of each vector (bytes, tokens, rows). Vectors are scaled by the totals; a
    vector that would overfill every shard goes to the emptiest. At most so many rounds
    of exchanges follow, in each of which the pair of fullest and emptiest shard moves
    or swaps what brings their bytes closest, if rows and tokens do not get worse than
    the bytes were."""
    total = np.maximum(vectors.sum(0), 1)
    share = vectors / total
    residual = np.full((n_shards, vectors.shape[1]), 1 / n_shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        score = residual @ share[i]
        fits = (residual - share[i] >= -1e-12).all(1)
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(residual.min(1)))
        out[i] = best
        residual[best] -= share[i]
    for _ in range(rounds):
        high, low = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        gap = residual[low, 0] - residual[high, 0]
        if gap * n_shards < 1e-3:
            break
        give, take = np.flatnonzero(out == high), np.flatnonzero(out == low)
        back = np.vstack([np.zeros(vectors.shape[1]), share[take]])  # nothing, or one item, comes in return
        order = np.argsort(back[:, 0], kind="stable")
        # For each item given, the two returns whose difference is nearest to half the gap.
        at = np.searchsorted(back[order, 0], share[give, 0] - gap / 2)
        tried = [(g, order[k]) for g, a in zip(give.tolist(), at.tolist(), strict=True) for k in (a - 1, a) if 0 <= k < len(order)]
        moves = np.array([share[g] - back[k] for g, k in tried]).reshape(-1, vectors.shape[1])
        worst = np.maximum(np.abs(residual[high] + moves).max(1), np.abs(residual[low] - moves).max(1))
        after = np.maximum(np.abs(residual[high, 0] + moves[:, 0]), np.abs(residual[low, 0] - moves[:, 0]))
        now = max(abs(residual[high, 0]), abs(residual[low, 0]))
        limit = max(np.abs(residual[[high, low]]).max(), 0.02 / n_shards)
        good = np.flatnonzero((after < now * (1 - 1e-9)) & (worst <= limit))
        if not len(good):
            break
        g, k = tried[int(good[np.argmin(after[good])])]
        move = share[g] - back[k]
        out[g] = low
        if k:
            out[take[k - 1]] = high
        residual[high] += move
        residual[low] -= move
    return out


def shard(docs: DataFrame, n_shards: int = 16, n_cells: int = 8192) -> DataFrame:
    """Columns doc_id, size (UTF-8 bytes plus 1), n_tokens, text_crc32, group
    (hash of the text), shard, slot (from 0 without gaps in each shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_text(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("group"),
    )
    keys = ["group", "doc_id", "size", "n_tokens", "text_crc32"]
    rows = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    sums = [F.sum(F.col("size") * F.col("n")).alias("b"), F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("r")]
    total = rows.agg(*sums).first()
    tb, tt, tr = (max(1, x or 0) for x in total)
    heavy = (
        rows.groupBy("group").agg(*sums)
        .withColumn("share", F.greatest(F.col("b") / tb, F.col("t") / tt, F.col("r") / tr))
        .where(F.col("share") > HEAVY)
        .select("group", F.when(F.col("share") * n_shards > 1, n_shards).otherwise(1).alias("parts"), F.ceil(F.col("r") / (tr * HEAVY)).cast("int").alias("pieces"))
    )
    # At most 3 / HEAVY groups can exceed the share: a broadcast with a proven bound.
    known = rows.join(F.broadcast(heavy), "group", "left")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # Rows of a split group go to a part by hash; one that is there often is dealt out to all of them.
    dealt = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.coalesce("parts", F.lit(1)).cast("long"), F.col("n")).cast("int") - 1)))
    dealt = dealt.withColumn("n", F.expr("n div coalesce(parts, 1)") + (F.col("k") < F.col("n") % F.coalesce("parts", F.lit(1))).cast("long"))
    part = F.pmod(h + F.col("k"), F.col("parts")).cast("string")
    light = F.concat(F.lit("c"), F.pmod("group", F.lit(n_cells)).cast("string"))
    placed = dealt.withColumn(
        "item", F.when(F.col("parts").isNull(), light).otherwise(F.concat_ws(":", F.lit("g"), F.col("group").cast("string"), part))
    ).withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces"))).cast("int"))
    found = sorted(map(tuple, placed.groupBy("item", "piece").agg(*sums).collect()))
    names = sorted({f[0] for f in found})
    number = {name: i for i, name in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for item, _, *v in found:
        vectors[number[item]] += v
    where = pack(vectors, n_shards).tolist()
    begun = [0] * n_shards
    plan = []
    for item, piece, _, _, n in found:
        s = where[number[item]]
        plan.append((item, piece, s, begun[s]))
        begun[s] += n
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("begin", T.LongType())])
    plan_df = rows.sparkSession.createDataFrame(plan, schema)
    order = Window.partitionBy("item", "piece").orderBy("doc_id", "group", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.withColumn("to", F.sum("n").over(order)).join(F.broadcast(plan_df), ["item", "piece"])
    first = F.col("begin") + F.col("to") - F.col("n")
    # Repeated rows: blocks first, so that no task writes one row's copies alone.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}")))
    spread = lined.withColumn("first", first).withColumn("block", blocks)
    once, often = spread.where(f"n <= {BLOCK}"), spread.where(f"n > {BLOCK}").repartition("item", "piece", "doc_id", "block")
    own = F.sequence(F.lit(0).cast("long"), F.least(F.lit(BLOCK - 1), F.col("n") - 1 - F.col("block") * BLOCK))
    return once.unionByName(often).withColumn("i", F.explode(own)).select(
        "doc_id", "size", "n_tokens", "text_crc32", "group", "shard", (F.col("first") + F.col("block") * BLOCK + F.col("i")).cast("long").alias("slot")
    )
