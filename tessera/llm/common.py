"""Helpers shared by the operators on text corpora: whole-text tokenising over
Arrow buffers, bounded batches, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where ids are compared; sorts last.
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset, a temporary one serves a local session; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost
    executor costs nothing that was written. The session's tables go as it ends;
    discard() drops one before."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    files, at = _file_system(spark, home)
    files.mkdirs(at)
    files.deleteOnExit(at)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/tessera/" in path:
            files, at = _file_system(table.sparkSession, path)
            files.delete(at, True)


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a worker. A
    smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= mb << 20:
        spark.conf.set(name, str(mb << 20))


def unused(docs: DataFrame, name: str) -> str:
    """A column name like name that docs has not, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together and where each begins (one more
    offset than texts); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, texts: str = "text", limit: int = 1 << 20):
    """Slices of a batch with about limit bytes of text each (one text at least)."""
    col = batch.column(batch.schema.get_field_index(texts))
    _, off = buffers(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        for name, base in (("up", _ODD), ("down", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of arbitrary ranges of a sequence in constant time each: a
    polynomial modulo 2**64 over random 64-bit codes, taken from prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses a text's border."""
    inside = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = off[(off > 0) & (off < len(data))]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[border - 1] = inside[border - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(off, at, "right") - 1
