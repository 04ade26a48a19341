"""Hashed word and character n-gram features over Arrow buffers, and the bounded
sample of labelled rows that the two classifiers learn from.

Features: words, pairs of neighbouring words, a mark for a word that repeats its
predecessor, byte 3-grams and byte 5-grams, each hashed into its part of one
table. Case is kept: it tells quality. Texts are read in segments that end between
words, so that memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, buffers, byte_codes, id_text, is_space, mix, owner, pieces, small_batches, word_spans

BITS = 15
#: words, word pairs, 3-grams, 5-grams; the first bucket marks repeated words.
TABLE = 4 << BITS
REPEAT = 0
#: Bytes of one segment.
SEGMENT = 1 << 19


def _bucket(h: np.ndarray, part: int) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(part << BITS)


def segments(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of segments of about size bytes that end behind a space; a word that
    is longer stays whole."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and not is_space(data[to - 1 : to])[0]:
            gaps = np.flatnonzero(is_space(data[to : to + size]))
            to = to + int(gaps[0]) + 1 if len(gaps) else min(to + size, len(data))
        yield at, to
        at = to


def grams(data: np.ndarray, off: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, text number, bucket) of every feature, segment by segment and kind by kind."""
    held = (-1, np.uint64(0))  # text and hash of the segment's last word
    for lo, hi in segments(data, size):
        part = data[lo:hi]
        cuts = np.clip(off, lo, hi) - lo
        start, end = word_spans(part, cuts)
        h = Rolling(byte_codes(part)).of(start, end)
        doc = owner(off, start + lo).astype(np.int32)
        yield 0, doc, _bucket(h, 0)
        if len(doc):
            before = np.concatenate([[held[1]], h[:-1]])
            pair = np.flatnonzero(doc == np.concatenate([[held[0]], doc[:-1]]))
            held = (doc[-1], h[-1])
            x, y = before[pair], h[pair]
            yield 1, doc[pair], np.where(x == y, np.int32(REPEAT), _bucket(mix(x * np.uint64(3) + y), 1))
        for n, kind in ((3, 2), (5, 3)):
            own = data[lo : hi + n - 1]
            m = len(own) - n + 1
            if m <= 0:
                continue
            v = np.zeros(m, np.uint64)
            for j in range(n):
                v |= own[j : j + m].astype(np.uint64) << np.uint64(8 * j)
            ok = np.ones(m, bool)
            inside = off[(off > lo) & (off < hi + n)] - lo
            for j in range(1, n):
                cut = inside - j
                ok[cut[(cut >= 0) & (cut < m)]] = False
            at = np.flatnonzero(ok)
            yield kind, owner(off, at + lo).astype(np.int32), _bucket((v[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), kind)


def mean_of(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, the sum over the four kinds of the mean table value of its
    features of that kind; a kind without features adds 0."""
    n = len(off) - 1
    sums, count = np.zeros((4, n)), np.zeros((4, n))
    for kind, doc, bucket in grams(data, off):
        sums[kind] += np.bincount(doc, table[bucket], n)
        count[kind] += np.bincount(doc, minlength=n)
    return (sums / np.maximum(count, 1)).sum(0)


@dataclass
class Rows:
    """Labelled rows by rising id: row i has the features col[size[i] : size[i + 1]]
    with the shares val."""

    ids: np.ndarray
    y: np.ndarray
    size: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.y)

    def take(self, use: np.ndarray) -> Rows:
        """The rows marked by use."""
        n = np.diff(self.size)
        own = np.repeat(use, n)
        return Rows(self.ids[use], self.y[use], np.concatenate([[0], np.cumsum(n[use])]), self.col[own], self.val[own])

    @classmethod
    def of(cls, rows: list[tuple]) -> Rows:
        """rows: (id, y, buckets, values)."""
        empty = [np.zeros(0, np.int32)]
        return cls(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64),
            np.concatenate([*empty, *[r[2] for r in rows]]).astype(np.int32), np.concatenate([*empty, *[r[3] for r in rows]]).astype(np.float32),
        )


def labelled(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, seed: int) -> DataFrame:
    """doc_id, y of at most max_rows labelled documents, chosen by hash. A document
    labelled more than once takes the larger label; null labels and ids are no labels."""
    one = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return one.agg(F.max(F.col(target).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)


def features_of(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct buckets of every text, and each one's share of its kind."""
    n = len(off) - 1
    keys, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((4, n), np.int64)
    for kind, doc, bucket in grams(data, off):
        total[kind] += np.bincount(doc, minlength=n)
        key, count = np.unique(doc.astype(np.int64) * TABLE + bucket, return_counts=True)
        keys, counts = np.concatenate([keys, key]), np.concatenate([counts, count])
    keys, back = np.unique(keys, return_inverse=True)
    counts = np.bincount(back, counts, len(keys))
    cut = np.searchsorted(keys, np.arange(n + 1) * TABLE)
    # The mark of repeated words counts among the pairs.
    kind = lambda b: np.where(b == REPEAT, 1, b >> BITS)
    out = []
    for i in range(n):
        b = keys[cut[i] : cut[i + 1]] - i * TABLE
        out.append((b.astype("<i4"), (counts[cut[i] : cut[i + 1]] / np.maximum(total[kind(b), i], 1)).astype("<f4")))
    return out


def learn(docs: DataFrame, chosen: DataFrame, fit: Callable) -> tuple[np.ndarray, float] | None:
    """fit(Rows), run in one task over the chosen documents, their whole texts used (of
    rows that share a doc_id, one). A row is at most as long as the feature table, so
    rows times table bounds the task, and the driver sees only the table fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                found = features_of(*buffers(batch.column(1)))
                cols = [pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", "y", "a", "v"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for k in range(b.num_rows):
                x = b.column(2)[k]
                got.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), np.frombuffer(x["a"].as_buffer(), "<i4").copy(), np.frombuffer(x["v"].as_buffer(), "<f4").copy()))
        rows = Rows.of(sorted(got, key=lambda r: r[0]))
        del got
        model = fit(rows)
        if len(rows) and model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(*model).tobytes()], pa.binary())], ["flat"])

    small_batches(docs.sparkSession)
    # chosen has a row limit of its own, so its broadcast is bounded.
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = rows.mapInArrow(run, "doc_id long, y int, a binary, v binary")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("a", "v")).alias("x"))
    found = rows.repartition(1).mapInArrow(one, "flat binary").collect()
    if not found:
        return fit(Rows.of([]))
    flat = np.frombuffer(bytes(found[0]["flat"]), np.float64)
    return flat[:-1], float(flat[-1])
