"""Groups of near copies by the exact similarity of their word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles (A-Z lower-cased) is 0.8 or more. Fingerprints within two bits, which
`simhash` links exactly, miss most such pairs: 0.8 of similarity is about ten bits
of 64, and at that radius the triangle bound of a vantage-point tree rules nothing
out. So the links of the trees are candidates here beside those of bands of
minimum hashes, and every candidate is judged on the two whole texts.

1. Texts of equal words are one class, whatever their number.
2. First candidates: classes whose fingerprints link (a spanning forest), and the
   members of each band with two of it, its least member and its hub, the one that
   shares most bands with others. A band of n members gives at most 2 n pairs.
3. A candidate is a link if the exact similarity reaches the limit; links close to
   components.
4. In bands that hold several components, all pairs of different ones are judged as
   well: in bands of at most SMALL members pair by pair, in larger ones by blocks of
   bounded size. Members of the band's largest component need no pairs among
   themselves, so a group of near copies costs what the others in its band cost.

A pair at 0.8 misses all of the 14 bands of 4 with probability 0.0006.

Nulls: a null text has no words, and texts without words are one class; rows
without doc_id take no part. Shorter texts have one shingle, the whole sequence.
Repeated rows are one class. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rolling, buffers, byte_codes, id_text, materialize, mix, owner, pieces, small_batches, unused, word_spans
from .components import components
from .simhash import fingerprint, link

BANDS, ROWS = 14, 4
#: Bands up to SMALL members give pairs; the blocks of others have about so many members and shingles.
SMALL, BLOCK_MEMBERS, BLOCK_SHINGLES = 32, 1024, 1 << 19


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's word sequence; text number and hash of every shingle."""
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    n = len(off) - 1
    start, end = word_spans(data, off)
    words = Rolling(Rolling(byte_codes(data)).of(start, end))
    to = np.searchsorted(start, off)
    whole = words.of(to[:-1], to[1:])
    doc = owner(off, start)
    size = np.diff(to)
    last = np.minimum(np.arange(len(start)) + width, to[1:][doc]) if len(start) else np.zeros(0, np.int64)
    full = last - np.arange(len(start)) == width
    at = np.flatnonzero(full | ((size[doc] < width) & (np.arange(len(start)) == to[:-1][doc])))
    return whole[:n], doc[at], words.of(at, last[at])


def bands(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts a hash for each band; texts without shingles have zeros."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(h):
        return out
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    odd = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for band in range(BANDS):
        key = np.full(len(begin), band, np.uint64)
        for factor in odd[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * factor + np.minimum.reduceat(h * factor, begin))
        out[doc[begin], band] = key
    return out


def sketches(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Columns doc_id, text_key (hash of the text), words (hash of the word sequence), fp, size (shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                data, off = buffers(batch.column(1))
                whole, doc, h = shingles(data, off, width)
                fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
                keys = bands(doc, h, batch.num_rows).view(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                size = pa.array(np.bincount(doc, minlength=batch.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(whole.view(np.int64)), pa.array(fp.view(np.int64)), size, rows], ["doc_id", "text_key", "words", "fp", "size", "bands"]
                )

    small_batches(docs.sparkSession)
    rows = id_text(docs).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, words long, fp long, size long, bands array<long>")


def candidates(classes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """classes: words (distinct), fp, size, bands. First pairs a > b of words; the
    members of bands that hold more than one."""
    nodes = materialize(classes.groupBy("fp").agg(F.min("words").alias("rep")), "near-nodes")
    pairs = link(nodes, radius).select("a", "b").union(classes.join(nodes, "fp").select(F.col("words").alias("a"), F.col("rep").alias("b")))
    rows = classes.select("words", "size", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("least")).where("n > 1")
    members = materialize(rows.join(shared, ["band", "key"]), "near-members")
    partners = members.groupBy("words").agg(F.sum("n").alias("partners"))
    hubs = members.join(partners, "words").groupBy("band", "key").agg(F.max(F.struct("partners", "words")).alias("hub"))
    pairs = pairs.union(members.select("words", "least")).union(members.join(hubs, ["band", "key"]).select("words", F.col("hub.words")))
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), members


def unlinked(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the first candidates left open in bands of several components: pairs a > b
    of words in small bands; words, component, band, key, lo, hi (a pair of blocks)
    for the members of larger ones."""
    named = members.join(found, F.col("words") == F.col("node"), "left").select("words", "size", "band", "key", F.coalesce("component", "words").alias("component"))
    named = materialize(named, "near-named-members")
    parts = named.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("words")).alias("sign"))
    whole = parts.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("sign").alias("sign"),
        F.max(F.struct("n", "component", "size")).alias("most"),
    )
    # Bands of the same members are judged once; in a band of two the first candidates are all.
    one = whole.where("parts > 1 AND n > 2").groupBy("n", "size", "parts", "sign").agg(F.min(F.struct("band", "key", "most")).alias("of")).select("n", "size", "of.*")
    inside = materialize(named.drop("size").join(one, ["band", "key"]), "near-open")
    few = inside.where(F.col("n") <= SMALL).select("band", "key", "words", "component")
    pairs = few.withColumnsRenamed({"words": "a", "component": "c"}).join(few.withColumnsRenamed({"words": "b", "component": "d"}), ["band", "key"]).where("a > b AND c <> d")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_SHINGLES, F.lit(1.0)))
    big = F.col("component") == F.col("most.component")
    many = inside.where(F.col("n") > SMALL).withColumn("others", blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))).withColumn("same", blocks(F.col("most.n"), F.col("most.size")))
    # The blocks of the largest component come last, and meet none of their own.
    many = many.withColumn("own", F.pmod(F.xxhash64("words"), F.when(big, F.col("same")).otherwise(F.col("others"))) + F.when(big, F.col("others")).otherwise(0))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(big, 0).otherwise(F.col("same")) - 1))).where("own <> other")
    return pairs.select("a", "b").distinct(), many.select("words", "component", "band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def forest(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels that have the similarity, as many as
    join what all such links join; every pair of different labels is judged."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    token, doc = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(token)))
    both = np.zeros((n, n), np.float32)
    # Shingles of few texts pair by pair, others by products of blocks of columns.
    group = np.repeat(np.arange(len(begin)), count)
    rare = count[group] <= 32
    at, own = doc[rare], group[rare]
    for shift in range(1, 32):
        same = own[shift:] == own[:-shift]
        if not same.any():
            break
        both += np.bincount(at[:-shift][same] * n + at[shift:][same], minlength=n * n).reshape(n, n)
    both += both.T.copy()
    common = np.flatnonzero(count > 32)
    for s in range(0, len(common), 512):
        block = np.zeros((n, 512), np.float32)
        for k, g in enumerate(common[s : s + 512]):
            block[doc[begin[g] : begin[g] + count[g]], k] = 1
        both += block @ block.T
    label, links = label.copy(), []
    for i in range(n):
        shared = both[i].astype(np.float64)
        near = np.flatnonzero((shared >= similarity * (size[i] + size - shared)) & (label != label[i]))
        while len(near):
            links.append((i, int(near[0])))
            label[label == label[near[0]]] = label[i]
            near = near[label[near] != label[i]]
    return links


def judge(blocks: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links a, b between members of different components in each pair of blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                whole, doc, h = shingles(*buffers(batch.column(1)), width)
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                own = np.flatnonzero(whole.view(np.int64) == batch.column(0).to_numpy())
                sets = [np.unique(h[cut[i] : cut[i + 1]]).tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(sets, pa.binary())], ["words", "set"])

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        words = table.column("words").to_numpy()
        links = np.array(forest(sets, table.column("component").to_numpy(), similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(words[links[:, 0]], pa.int64()), "b": pa.array(words[links[:, 1]], pa.int64())})

    small_batches(docs.sparkSession)
    need = blocks.select("words").distinct().join(classes.select("words", "doc_id"), "words")
    sets = need.join(id_text(docs), "doc_id").select("words", "text").mapInArrow(read, "words long, set binary")
    sets = materialize(sets.groupBy("words").agg(F.first("set").alias("set")), "near-sets")
    return blocks.join(sets, "words").select("words", "component", "band", "key", "lo", "hi", "set").groupBy("band", "key", "lo", "hi").applyInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs whose texts' shingle sets have at least that Jaccard similarity."""

    def shingle_set(text: str | None) -> tuple[int, np.ndarray]:
        whole, _, h = shingles(*buffers(pa.array([text], pa.string())), width)
        return int(whole.view(np.int64)[0]), np.unique(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)  # rows of one text come together
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                text_b = batch.column(3)[i].as_py()
                if held[0] != (text_b,):
                    held = ((text_b,), shingle_set(text_b))
                key_b, b = held[1]
                key_a, a = shingle_set(batch.column(2)[i].as_py())
                # Rows of one doc_id may hold several texts: only the class's own counts.
                if key_a == batch.column(0)[i].as_py() and key_b == batch.column(1)[i].as_py():
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[i] = both >= similarity * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    small_batches(docs.sparkSession)
    texts, ids = id_text(docs), classes.select("words", "doc_id")
    for end in ("a", "b"):
        pairs = pairs.join(ids.withColumnsRenamed({"words": end, "doc_id": f"id_{end}"}), end)
    pairs = materialize(pairs, "near-pairs")
    # The smaller end last: a class with many partners is a skewed key there, which a join can split.
    for end in ("a", "b"):
        pairs = pairs.join(texts.withColumnsRenamed({"doc_id": f"id_{end}", "text": f"text_{end}"}), f"id_{end}")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 2, seed: int = 42) -> DataFrame:
    """Columns doc_id, text_key, group, component_id (the smallest doc_id of its group)."""
    rows = materialize(sketches(docs, width, seed), "near-sketches")
    classes = materialize(rows.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "near-classes")
    pairs, members = candidates(classes, radius)
    found = materialize(components(confirm(pairs, classes, docs, similarity, width)), "near-found")
    pairs, blocks = unlinked(members, found)
    links = confirm(pairs, classes, docs, similarity, width).union(judge(blocks, classes, docs, similarity, width))
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    grouped = classes.select("words", "doc_id").join(found, F.col("words") == F.col("node"), "left").select("words", "doc_id", F.coalesce("component", "words").alias("group"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = materialize(grouped.join(least, "group").select("words", "group", "component_id"), "near-named")
    return rows.select("doc_id", "text_key", "words").join(named, "words").select("doc_id", "text_key", "group", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group, one of its smallest doc_id (where that is repeated, of its
    least text in the group by hash; of equal rows one stays); every column as it was.
    Rows without doc_id all stay."""
    kept_id, kept_text, place = (unused(docs, c) for c in ("kept_id", "kept_text", "place"))
    least = near_copies(docs, similarity, width).groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    keep = least.select(F.col("one.doc_id").alias(kept_id), F.col("one.text_key").alias(kept_text)).distinct()
    text = F.xxhash64(F.col("text").cast("string"))
    own = docs.join(keep, (F.col("doc_id").cast("long") == F.col(kept_id)) & (text == F.col(kept_text)), "left_semi")
    rest = [docs[c] for c, t in docs.dtypes if c != "doc_id" and not t.startswith("map")]
    first = Window.partitionBy("doc_id", text).orderBy(*[c.asc_nulls_last() for c in rest])
    one = own.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return one.union(docs.where(F.col("doc_id").isNull()))
