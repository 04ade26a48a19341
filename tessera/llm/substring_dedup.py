"""Substring dedup by fixed-block anchors.

A window is `width` consecutive words of a document. Any window holds, wherever
it lies, a whole block of half its width that is aligned to the reference grid.
Round 1 indexes the non-overlapping aligned blocks and probes them with every
rolling block: a rolling block is a hit if it equals an aligned block and occurs
in two documents. Round 2 extends hits to the windows around them and finds, for
each distinct window, the smallest doc_id it starts in. Runs of windows with a
smaller document elsewhere are the maximal exact repeats; their words go.

Short prints (24 bits and the bucket) serve in round 1, where a false hit only
costs work; windows are compared by 64-bit hashes of their words.

Nulls: a null text has no words. A null doc_id sorts after all others. Rows that
repeat a doc_id are not smaller than each other. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .common import Rolling, byte_codes, owner, word_spans

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """A chunk's words, rolling blocks and windows."""

    def __init__(self, chunk: C.Chunk, width: int):
        self.chunk, self.width, self.half = chunk, width, width // 2
        self.start, self.end = word_spans(chunk.data, chunk.off)
        self.doc = owner(chunk.off, self.start)
        self.roll = Rolling(Rolling(byte_codes(chunk.data)).of(self.start, self.end))

    def at(self, n: int) -> np.ndarray:
        """Where n words of one document begin."""
        m = max(0, len(self.doc) - n + 1)
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 :]) if m else np.zeros(0, np.int64)

    def blocks(self):
        """Sorted distinct rolling blocks: key, aligned, in several documents; where each position's is."""
        at = self.at(self.half)
        key, back = np.unique(self.roll.of(at, at + self.half), return_inverse=True)
        aligned = np.bincount(back, at % self.half == 0, len(key)) > 0
        lo, hi = np.full(len(key), len(self.chunk.ids)), np.zeros(len(key), np.int64)
        np.minimum.at(lo, back, self.doc[at])
        np.maximum.at(hi, back, self.doc[at])
        return key, aligned, lo != hi, at, back

    def windows(self, hit: np.ndarray):
        """Sorted distinct windows that hold a hit: key, smallest doc_id; positions and where each one's is."""
        _, _, _, at, back = self.blocks()
        marked = np.zeros(len(self.doc) + 1, np.int64)
        marked[at] = hit[back]
        sums = np.concatenate([[0], np.cumsum(marked)])
        at = self.at(self.width)
        at = at[sums[at + self.width - self.half + 1] > sums[at]]
        key, back = np.unique(self.roll.of(at, at + self.width), return_inverse=True)
        least = np.full(len(key), C.NO_ID)
        np.minimum.at(least, back, self.chunk.ids[self.doc[at]])
        return key, least, at, back


def _key24(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key << np.uint64(bits)) >> np.uint64(40)).astype(np.uint32)


def _hits(arrays: list[np.ndarray], source: np.ndarray) -> list[np.ndarray]:
    key, flags = arrays[0] & np.uint32(0xFFFFFF), arrays[0] >> np.uint32(24)
    order, begin = C.groups(key)
    if not len(order):
        return [np.zeros(0, np.uint8)]
    f = flags[order]
    several = (np.maximum.reduceat(source[order], begin) != np.minimum.reduceat(source[order], begin)) | (np.bitwise_or.reduceat(f, begin) & 2 > 0)
    return [C.spread((several & (np.bitwise_or.reduceat(f, begin) & 1 > 0)).astype(np.uint8), order, begin)]


def _smaller(arrays: list[np.ndarray], source: np.ndarray) -> list[np.ndarray]:
    key, least = arrays
    order, begin = C.groups(key)
    if not len(order):
        return [np.zeros(0, np.uint8)]
    low = C.spread(np.minimum.reduceat(least[order], begin), order, begin)
    return [(low < least).astype(np.uint8)]


def kept_words(words: Words, gone: np.ndarray) -> list[str]:
    """For each text, the hash of its remaining words joined by one space."""
    data = words.chunk.data.tobytes()
    at = np.searchsorted(words.doc, np.arange(len(words.chunk.ids) + 1))
    stay = ~gone
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s, e = words.start[a:b][stay[a:b]].tolist(), words.end[a:b][stay[a:b]].tolist()
        out.append(hashlib.sha256(b" ".join([data[i:j] for i, j in zip(s, e, strict=True)])).hexdigest())
    return out


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    packed = C.pack(docs)
    bits = C.buckets_for(packed, 8 << 20)

    def ask_blocks(chunk: C.Chunk, _):
        key, aligned, several, _, _ = Words(chunk, width).blocks()
        flags = aligned.astype(np.uint32) | several.astype(np.uint32) << np.uint32(1)
        return key, [_key24(key, bits) | flags << np.uint32(24)]

    def ask_windows(chunk: C.Chunk, answers: dict):
        hit = answers[0][0] if 0 in answers else np.zeros(0, np.uint8)
        key, least, _, _ = Words(chunk, width).windows(hit)
        return key, [key, least]

    def result(chunk: C.Chunk, answers: dict) -> dict:
        words = Words(chunk, width)
        gone = np.zeros(len(words.doc) + 1, np.int64)
        if 1 in answers:
            _, least, at, back = words.windows(answers[0][0])
            taken = at[(answers[1][0][back] > 0) | (chunk.ids[words.doc[at]] > least[back])]
            gone[taken] += 1
            np.subtract.at(gone, taken + width, 1)
        covered = np.cumsum(gone[:-1]) > 0
        n = len(chunk.ids)
        return {
            "doc_id": chunk.id_column(),
            "n_words": pa.array(np.bincount(words.doc, minlength=n), pa.int64()),
            "n_removed": pa.array(np.bincount(words.doc[covered], minlength=n), pa.int64()),
            "kept_sha256": pa.array(kept_words(words, covered), pa.string()),
        }

    hits = C.reply(C.requests(packed, ask_blocks, bits), 0, _hits, "block-hits")
    smaller = C.reply(C.requests(packed, ask_windows, bits, hits), 1, _smaller, "window-hits")
    return C.finish(packed, hits.union(smaller), result, RESULT)
