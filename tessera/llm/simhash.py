"""SimHash near-duplicates, linked exactly by vantage-point trees.

A fingerprint bit is the majority of that bit among the XXH64 hashes of a text's
word shingles. Equal fingerprints are one node. A vantage-point tree over a
bounded sample of fingerprints cuts the Hamming space into shards; every
fingerprint lives in one shard, and goes as a query into each further shard that
the triangle bound cannot rule out. In a shard a tree over its own fingerprints
does the same down to small leaves, where distances are computed. A shard passes
on a spanning forest of its links, never all pairs of a group; components follow
from the forests by distributed star contraction.

Nulls: a null text has no words and fingerprint 0, linked like any other; a null
doc_id never names a component while its group has an id (else the component is
null). Repeated rows keep a row each. An empty table gives an empty result.
Further columns are ignored, or kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, materialize, small_batches, unused
from .components import components


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = np.concatenate([[0], end[:-1] + 1])[:n].tolist()
    stop = end[min(width, len(words)) - 1 :].tolist()
    h = np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(begin, stop, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Columns doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


@dataclass
class Node:
    """Inside: distance to pivot at most cut. A leaf has no pivot."""

    leaf: int = -1
    pivot: np.uint64 = np.uint64(0)
    cut: int = 0
    inner: Node | None = None
    outer: Node | None = None


def grow(sample: np.ndarray, depth: int, radius: int, least: int = 2) -> tuple[Node, int]:
    """A tree over the sample (distinct fingerprints); returns it and its number of leaves."""
    leaves = 0

    def build(x: np.ndarray, level: int) -> Node:
        nonlocal leaves
        best = None
        if level < depth and len(x) >= least:
            for pivot in x[np.linspace(0, len(x) - 1, 6).astype(int)]:
                d = np.bitwise_count(x ^ pivot).astype(int)
                cut = int(np.median(d))
                if cut == d.max():
                    cut -= 1
                inside = int((d <= cut).sum())
                if 0 < inside < len(x):
                    cost = int((np.abs(d - cut) <= radius).sum()) + 2 * abs(2 * inside - len(x))
                    if best is None or cost < best[0]:
                        best = (cost, pivot, cut, d)
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        _, pivot, cut, d = best
        return Node(-1, pivot, cut, build(x[d <= cut], level + 1), build(x[d > cut], level + 1))

    return build(sample, 0), leaves


def route(node: Node, fps: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int):
    """Yields (leaf, home indices, query indices). A pair within radius, whose ends
    have different homes, meets in the home of one of them: whoever lives inside a
    cut and within reach of it is also a query outside."""
    if node.inner is None:
        yield node.leaf, home, query
        return
    dh = np.bitwise_count(fps[home] ^ node.pivot).astype(int)
    dq = np.bitwise_count(fps[query] ^ node.pivot).astype(int)
    inside = dh <= node.cut
    reach = home[inside & (dh > node.cut - radius)]
    yield from route(node.inner, fps, home[inside], query[dq <= node.cut + radius], radius)
    yield from route(node.outer, fps, home[~inside], np.concatenate([query[dq > node.cut - radius], reach]), radius)


def forest(fps: np.ndarray, n_home: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of the links of the first n_home fingerprints, among
    themselves and with the others (queries)."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    home, query = np.arange(n_home), np.arange(n_home, len(fps))
    tree, _ = grow(fps[:n_home], 40, radius, least=192)
    out = []
    for _, own, asked in route(tree, fps, home, query, radius):
        other = np.concatenate([own, asked])
        for at in range(0, len(own), 256):
            block = own[at : at + 256]
            near = np.bitwise_count(fps[block][:, None] ^ fps[other][None, :]) <= radius
            a, b = np.nonzero(near)
            a, b = block[a], other[b]
            for i, j in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((i, j))
    ends = np.array(out, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def link(nodes: DataFrame, radius: int = 2, shard_size: int = 4000, sample_size: int = 16_384) -> DataFrame:
    """nodes: fp (distinct), rep (long, distinct). Edges a, b between reps that,
    closed transitively, connect all fingerprints within radius of each other. The
    sample that places the vantage points is bounded; it decides no link."""
    spark = nodes.sparkSession
    n = nodes.count()
    drawn = nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample_size).toArrow().column(0).to_numpy()
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / shard_size)), 7, np.log2(sample_size) - 3))
    tree = spark.sparkContext.broadcast(grow(np.sort(drawn.view(np.uint64)), depth, radius)[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy() for i in (0, 1))
            leaf, at, asked = [], [], []
            none = np.zeros(0, np.int64)
            for k, home, query in route(tree.value, fp.view(np.uint64), np.arange(len(fp)), none, radius):
                at += [home, query]
                leaf.append(np.full(len(home) + len(query), k))
                asked.append(np.repeat([False, True], [len(home), len(query)]))
            i = np.concatenate([none, *at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([none, *leaf])), pa.array(fp[i]), pa.array(rep[i]), pa.array(np.concatenate([np.zeros(0, bool), *asked]))],
                ["leaf", "fp", "rep", "asked"],
            )

    def join(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        order = np.lexsort((table.column("fp").to_numpy(), asked))
        fp, rep = (table.column(c).to_numpy()[order] for c in ("fp", "rep"))
        a, b = forest(fp.view(np.uint64), int((~asked).sum()), radius)
        return pa.table({"a": rep[a], "b": rep[b]})

    dealt = nodes.select("fp", "rep").mapInArrow(deal, "leaf long, fp long, rep long, asked boolean")
    return dealt.groupBy("leaf").applyInArrow(join, "a long, b long")


#: Stands for groups without an id: above this, a representative is no doc_id.
_NAMELESS = 1 << 62


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs, width, seed), "fingerprints")
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned("fp", 2)
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", F.coalesce("id", nameless).alias("rep")), "nodes")
    found = components(link(nodes, radius))
    label = F.coalesce("component", "rep")
    named = materialize(
        nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.when(label < _NAMELESS, label).alias("component_id")), "named"
    )
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row of each component, that of its smallest doc_id (of repeated rows of
    it, the first by the other columns); every column as it was. Rows of components
    without an id all stay."""
    kept_id, place = unused(docs, "kept_id"), unused(docs, "place")
    keep = near_duplicates(docs, radius, width).where("component_id is null or doc_id = component_id")
    keep = keep.select(F.col("doc_id").alias(kept_id)).distinct()
    own = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    rest = [docs[c] for c, t in docs.dtypes if c != "doc_id" and not t.startswith("map")]
    first = Window.partitionBy("doc_id").orderBy(*[c.asc_nulls_last() for c in rest])
    named = own.where(F.col("doc_id").isNotNull()).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return named.union(own.where(F.col("doc_id").isNull()))
