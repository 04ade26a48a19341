"""Exchanges over a chunked corpus.

The corpus is written once as chunks: a few MB of whole texts, compressed, with
their ids. Operators that ask every position of the corpus about the rest of it
send, from each chunk to each hash bucket, one packed row of sorted distinct keys;
a bucket answers in the same order. Buckets keep their size however large the
corpus is, so their number grows, and rows are at most one for each key of a chunk. Keys that a chunk holds often are sent once,
so a passage that a third of all documents share costs each chunk one entry.
Answers are joined with their chunk again; chunks, not documents, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, buffers, id_text, materialize, pieces, small_batches

CHUNKS = "chunk_id long, ids binary, nulls binary, lengths binary, body binary"
REQUEST = "bucket int, chunk_id long, payload binary"
REPLY = "chunk_id long, round int, bucket int, payload binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string, byte plane by byte plane, so that
    the high bytes of sorted numbers vanish."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


@dataclass
class Chunk:
    id: int
    ids: np.ndarray  # doc_id, NO_ID for null
    nulls: np.ndarray
    off: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        lengths = np.frombuffer(row["lengths"], np.int64)
        data = np.frombuffer(zstandard.decompress(row["body"]), np.uint8) if lengths.any() else np.zeros(0, np.uint8)
        return cls(row["chunk_id"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], np.uint8).astype(bool), np.concatenate([[0], np.cumsum(lengths)]), data)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk.of(batch.slice(k, 1).to_pylist()[0])


def pack(docs: DataFrame, size: int = 4 << 20) -> DataFrame:
    """The corpus as chunks of about size bytes of text, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight, k = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, weight, k
            table = pa.Table.from_batches(held).combine_chunks()
            data, off = buffers(table.column("text"))
            ids = table.column("doc_id").combine_chunks()
            row = [k, ids.fill_null(NO_ID).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), np.diff(off).tobytes(), zstandard.compress(data.tobytes(), 3)]
            held, weight, k = [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], ["chunk_id", "ids", "nulls", "lengths", "body"])

        for batch in batches:
            for part in pieces(batch, limit=size):
                own = len(buffers(part.column(1))[0])
                if held and weight + own > size:
                    yield flush()
                held.append(part)
                weight += own
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    return materialize(id_text(docs).mapInArrow(run, CHUNKS), "chunks")


def buckets_for(chunks: DataFrame, per_bucket: float) -> int:
    """Bits of the bucket number: so many that a bucket gets about per_bucket bytes of
    text, 64 buckets at least. The upper bound is that of a bucket's int, beyond any corpus."""
    total = chunks.agg(F.sum(F.length("body"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, 2.7 * total / per_bucket))), 6, 30))


def requests(chunks: DataFrame, ask: Callable, bits: int, replies: DataFrame | None = None) -> DataFrame:
    """ask(chunk, answers) gives sorted 64-bit keys and the arrays that go with
    them; answers maps a round to its unpacked answer arrays in key order. Rows of
    REQUEST: for each bucket (the keys' upper bits) its keys' arrays."""

    def cut(chunk: Chunk, answers: dict) -> Iterator[tuple[int, int, bytes]]:
        keys, arrays = ask(chunk, answers)
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
        for i, j in zip(at, np.append(at, len(keys))[1:].astype(int), strict=True):
            yield int(bucket[i]), chunk.id, squeeze(*[a[i:j] for a in arrays])

    return _over_chunks(chunks, replies, cut, REQUEST)


def finish(chunks: DataFrame, replies: DataFrame, result: Callable, schema: str) -> DataFrame:
    """result(chunk, answers) gives the columns of the final rows as Arrow arrays."""
    return _over_chunks(chunks, replies, result, schema)


def answers_of(rows: list[dict]) -> dict[int, list[np.ndarray]]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["round"], r["bucket"])):
        out.setdefault(r["round"], []).append(unsqueeze(r["payload"]))
    return {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in out.items()}


def _table_of(made, schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    if isinstance(made, dict):
        return pa.table({n: made[n] for n in names})
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    rows = list(made)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _over_chunks(chunks: DataFrame, replies: DataFrame | None, f: Callable, schema: str) -> DataFrame:
    if replies is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks_of(batches):
                yield from _table_of(f(chunk, {}), schema).to_batches()

        return chunks.mapInArrow(run, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [_table_of(f(Chunk.of(row), answers_of(right.to_pylist())), schema) for row in left.to_pylist()]
        return pa.concat_tables(made) if made else _table_of([], schema)

    return chunks.groupBy("chunk_id").cogroup(replies.groupBy("chunk_id")).applyInArrow(both, schema)


def reply(asked: DataFrame, number: int, answer: Callable, name: str) -> DataFrame:
    """answer(arrays, source) gets a bucket's entries, all chunks after each other, and
    the chunk number (by rising chunk_id) of each; gives arrays in the same order. If
    it gives a pair of lists, the second is the bucket's own summary, on a row with
    chunk_id -1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        parts = [unsqueeze(x) for x in table.column("payload").to_pylist()]
        size = [len(p[0]) for p in parts]
        arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        got = answer(arrays, np.repeat(np.arange(len(size)), size))
        got, own = got if isinstance(got, tuple) else (got, None)
        at = np.concatenate([[0], np.cumsum(size)])
        packed = [squeeze(*[g[a:b] for g in got]) for a, b in zip(at[:-1], at[1:], strict=True)]
        ids, buckets = table.column("chunk_id").to_pylist(), table.column("bucket").to_pylist()
        if own is not None:
            ids, buckets, packed = [*ids, -1], [*buckets, buckets[0]], [*packed, squeeze(*own)]
        return _table_of(zip(ids, [number] * len(ids), buckets, packed, strict=True), REPLY)

    return materialize(asked.groupBy("bucket").applyInArrow(run, REPLY), name)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where groups of equal keys begin in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def spread(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A value of each group, given to its members in their first order."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(begin, len(order))))
    return out
