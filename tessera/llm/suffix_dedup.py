"""Suffix-array dedup by bucket-pointer refinement, on the suffixes that matter.

The suffixes of all texts are sorted only as far as it takes to tell which strings
of `width` bytes begin more than once:

* Initial buckets: every window of `width` bytes has a q-gram that is smallest by
  hash (the leftmost of equals). Windows that share it form a run; a run's initial
  bucket is that q-gram's. Equal windows have equal q-grams at equal offsets, so a
  bucket of one run holds no repeat and is done.
* First refinement: runs of a bucket are split by their whole content (all bytes of
  all windows of the run). Runs of equal content are repeats throughout.
* Where a q-gram is very frequent, its bucket would hold a run of each context it
  stands in. Such q-grams are looked up in a sample of the chunks (it decides who
  asks how, no result), and their runs are refined to windows at once, whose buckets
  are no larger than what repeats.
* Only runs alone in their content, in buckets of several, are refined by window,
  against one run of each content: the bucket of a string of length 2h at a place is
  the pair of the buckets of length h there and h further on, the pointers of
  a doubling reused recursively from the q-gram up to `width`.

Bucket identifiers are 64-bit hashes, so no bucket numbers need exchanging, only
the question which buckets have a second member. Matches never cross documents.

Nulls: a null text is empty. A text shorter than `width` loses nothing. Repeats
inside one document count, overlapping ones too. Repeated rows are documents of
their own. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import Rolling, byte_codes, mix

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Positions of one sliding minimum; places fit the low bits of the compared number.
SEGMENT, PLACE = 1 << 22, np.uint64((1 << 24) - 1)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, where the smallest of h[i : i + w] is, by its upper 40 bits, leftmost first."""
    n = len(h) - w + 1
    out = np.zeros(max(n, 0), np.int64)
    for s in range(0, n, SEGMENT):
        part = h[s : min(s + SEGMENT + w - 1, len(h))]
        x = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64)
        m = len(x) - w + 1
        pad = -len(x) % w
        x = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
        left = np.minimum.accumulate(x, axis=1).reshape(-1)
        right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[s : s + m] = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & PLACE).astype(np.int64) + s
    return out


class Runs:
    """The runs of a chunk's windows, and the distinct (bucket, content) entries of
    runs, or of windows where the bucket is among the hot ones."""

    def __init__(self, chunk: C.Chunk, width: int, gram: int, hot: np.ndarray):
        self.width, self.gram = width, gram
        self.roll = Rolling(byte_codes(chunk.data))
        n = len(chunk.data)
        lengths = np.diff(chunk.off)
        room = np.maximum(lengths - width + 1, 0)
        at = np.repeat(chunk.off[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
        if len(at):
            grams = np.arange(n - gram + 1)
            low = sliding_argmin(self.roll.of(grams, grams + gram), width - gram + 1)[at]
            cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]))
            self.lo, anchor = at[cut], low[cut]
            self.hi = at[np.append(cut[1:], len(at)) - 1] + 1
        else:
            self.lo = anchor = self.hi = np.zeros(0, np.int64)
        # The least of many hashes is small: mixed again, so that buckets are even.
        bucket = mix(self.roll.of(anchor, anchor + gram) + np.uint64(1))
        place = np.minimum(np.searchsorted(hot, bucket), max(len(hot) - 1, 0))
        direct = hot[place] == bucket if len(hot) else np.zeros(len(bucket), bool)
        run = np.flatnonzero(~direct)
        self.spots = self.places(np.flatnonzero(direct))
        own = self.refined(self.spots, width)
        content = mix(self.roll.of(self.lo[run], self.hi[run] - 1 + width) + (anchor - self.lo)[run].astype(np.uint64))
        bucket, content = np.concatenate([bucket[run], own]), np.concatenate([content, own])
        order = np.lexsort((content, bucket))
        b, c = bucket[order], content[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(b) else np.zeros(0, bool)
        self.bucket, self.content = b[new], c[new]
        entry = np.empty(len(b), np.int64)
        entry[order] = np.cumsum(new) - 1
        self.spot_entry = entry[len(run) :]
        self.entry = np.full(len(self.lo), -1)  # of each run; -1 where its windows have their own
        self.entry[run] = entry[: len(run)]
        self.first = np.append(run, np.full(len(own), -1))[order[new]]  # a run of each entry
        self.several = np.diff(np.append(np.flatnonzero(new), len(b))) > 1

    def places(self, which: np.ndarray) -> np.ndarray:
        """Where the windows of the chosen runs begin."""
        n = self.hi[which] - self.lo[which]
        return np.repeat(self.lo[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)

    def refined(self, at: np.ndarray, length: int) -> np.ndarray:
        """Bucket identifiers of the strings of that length: pairs of those of half the length."""
        if length <= self.gram or length % 2:
            return self.roll.of(at, at + length)
        half = length // 2
        return mix(self.refined(at, half) * np.uint64(0x9E3779B97F4A7C15) + self.refined(at + half, half))

    def windows(self, code: np.ndarray):
        """Sorted distinct windows to settle, whether the chunk has several, and each place's."""
        runs = self.first[code >= AMBIGUOUS]  # windows with an entry of their own are settled
        at = self.places(runs)
        key, back, count = np.unique(self.refined(at, self.width), return_inverse=True, return_counts=True)
        return key, count > 1, at, back, np.repeat(runs, self.hi[runs] - self.lo[runs])


ALONE, REPEATED, AMBIGUOUS, WITNESS = range(4)


def _split(arrays: list[np.ndarray], source: np.ndarray) -> list[np.ndarray]:
    bucket, content, several = arrays
    n = len(bucket)
    if not n:
        return [np.zeros(0, np.uint8)]
    order = np.lexsort((source, content, bucket))
    b, c, s = bucket[order], content[order], several[order] > 0
    new_b = np.concatenate([[True], b[1:] != b[:-1]])
    new_c = new_b | np.concatenate([[True], c[1:] != c[:-1]])
    begin_c, begin_b = np.flatnonzero(new_c), np.flatnonzero(new_b)
    size = np.diff(np.append(begin_c, n))
    repeated = (size > 1) | np.logical_or.reduceat(s, begin_c)
    rep = np.repeat(repeated, size)
    size_b = np.diff(np.append(begin_b, n))
    alone = np.repeat((size_b == 1), size_b) & ~rep
    unsettled = np.repeat(np.logical_or.reduceat(~rep, begin_b), size_b) & ~alone
    code = np.where(rep, REPEATED, np.where(alone, ALONE, AMBIGUOUS))
    code[rep & unsettled & new_c] = WITNESS
    out = np.empty(n, np.uint8)
    out[order] = code
    return [out]


def _again(arrays: list[np.ndarray], source: np.ndarray) -> list[np.ndarray]:
    key, several = arrays
    order, begin = C.groups(key)
    if not len(order):
        return [np.zeros(0, np.uint8)]
    size = np.diff(np.append(begin, len(order)))
    return [C.spread(((size > 1) | (np.maximum.reduceat(several[order], begin) > 0)).astype(np.uint8), order, begin)]


def hot_buckets(packed: DataFrame, width: int, gram: int, most: int = 1_000_000) -> np.ndarray:
    """Buckets that would hold more than about most runs of different contents, sorted;
    judged by a sample of at least 16 chunks and one in a thousand. Their number is at
    most that of all runs divided by most (on small corpora, some thousand)."""
    rate = int(np.clip(packed.count() / 16, 1, 1000))
    least = max(64, most // rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.chunks_of(batches):
            bucket, n = np.unique(Runs(chunk, width, gram, np.zeros(0, np.uint64)).bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[n > 1].view(np.int64)), pa.array(n[n > 1])], ["bucket", "n"])

    sample = packed.where(F.pmod(F.xxhash64("chunk_id"), F.lit(rate)) == 0)
    found = sample.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("bucket").toArrow().column(0).to_numpy().view(np.uint64))


def dedup_suffixes(docs: DataFrame, width: int = 400, gram: int = 50) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    packed = C.pack(docs)
    bits = C.buckets_for(packed, 8 << 20)
    hot = docs.sparkSession.sparkContext.broadcast(hot_buckets(packed, width, gram))  # bounded, see there

    def ask_runs(chunk: C.Chunk, _):
        r = Runs(chunk, width, gram, hot.value)
        return r.bucket, [r.bucket, r.content, r.several.astype(np.uint8)]

    def ask_windows(chunk: C.Chunk, answers: dict):
        r = Runs(chunk, width, gram, hot.value)
        key, several, *_ = r.windows(answers[0][0] if 0 in answers else np.zeros(0, np.uint8))
        return key, [key, several.astype(np.uint8)]

    def result(chunk: C.Chunk, answers: dict) -> dict:
        n = len(chunk.data)
        gone = np.zeros(n + 1, np.int64)
        if 0 in answers:
            r, code = Runs(chunk, width, gram, hot.value), answers[0][0]
            whole = np.isin(code[r.entry], (REPEATED, WITNESS)) & (r.entry >= 0)
            spots = r.spots[code[r.spot_entry] == REPEATED]
            np.add.at(gone, spots, 1)
            np.subtract.at(gone, spots + width, 1)
            np.add.at(gone, r.lo[whole], 1)
            np.subtract.at(gone, r.hi[whole] - 1 + width, 1)
            if 1 in answers:
                _, _, at, back, run = r.windows(code)
                at = at[(answers[1][0][back] > 0) & (code[r.entry[run]] == AMBIGUOUS)]
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + width, 1)
        covered = np.cumsum(gone[:-1]) > 0
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        edge = chunk.off[:-1][chunk.off[:-1] < n]
        begins[edge] = covered[edge]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[chunk.off])
        rest = chunk.data[~covered].tobytes()
        to = np.concatenate([[0], np.cumsum(~covered)])[chunk.off].tolist()
        return {
            "doc_id": chunk.id_column(),
            "n_bytes": pa.array(np.diff(chunk.off), pa.int64()),
            "n_removed": pa.array(sums(covered), pa.int64()),
            "n_spans": pa.array(sums(begins), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)], pa.string()),
        }

    codes = C.reply(C.requests(packed, ask_runs, bits), 0, _split, "runs")
    again = C.reply(C.requests(packed, ask_windows, bits, codes), 1, _again, "windows")
    return C.finish(packed, codes.union(again), result, RESULT)
