"""Helpers that the operators share: scratch tables, flat text views and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time in numpy; bounds the temporaries of a task.
SLICE_BYTES = 1 << 20


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that a Python worker gets, unless the session sets them: rows may
    be long texts, and the JVM and the worker hold a batch each."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves local mode only; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "callgrid-scratch")


class Scratch:
    """Intermediate tables as Parquet in the shared folder; they survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/callgrid-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return it as read back, so that its lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables[path] = out
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = df._scratch_path
        self.tables.pop(path, None)
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        for df in list(self.tables.values()):
            if all(df is not t for t in tables):
                self.drop(df)


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets), without copying; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


# --- word hashes -----------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _drawn(x: np.ndarray) -> np.ndarray:
    """A random number for each (place, symbol), given as one whole number."""
    return mix64((x.astype(np.uint64) + np.uint64(1)) * _GOLDEN)


#: Those of bytes at the first places.
_PLACES = 512
_DRAWN = _drawn(np.arange(_PLACES << 8))


def placed_sums(symbols: np.ndarray, place: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """For runs of so many symbols, one after the other: the sums of a random number for each
    (place in the run, symbol). Symbols have at most so many bits."""
    x = (place << bits) | symbols
    if bits == 8:
        h = _DRAWN.take(x, mode="clip")
        far = np.flatnonzero(place >= _PLACES)
        h[far] = _drawn(x[far])
    else:
        h = _drawn(x)
    return np.add.reduceat(h, np.cumsum(size) - size)


def places(size: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each run of so many symbols."""
    stop = np.cumsum(size)
    return np.arange(stop[-1]) - np.repeat(stop - size, size)


def _hash_runs(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    size = ends - starts
    if len(starts) == 1 and size[0] > SLICE_BYTES:
        # a longer run is hashed in parts
        parts = [_hash_runs(piece[i : i + SLICE_BYTES], np.zeros(1, np.int64), np.array([min(SLICE_BYTES, ends[0] - i)]), lower) for i in range(int(starts[0]), int(ends[0]), SLICE_BYTES)]
        return mix64(np.add.reduce(mix64(np.stack(parts) + np.arange(len(parts), dtype=np.uint64)[:, None] * _GOLDEN)) + size.astype(np.uint64))
    place = places(size)
    symbols = piece[place + np.repeat(starts, size)]
    return mix64(placed_sums(_LOWER[symbols] if lower else symbols, place, size, 8) + size.astype(np.uint64))


def same_runs(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether flat[a : a + size] equals flat[b : b + size], run by run."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        if j == i + 1:
            out[i] = np.array_equal(flat[a[i] : a[i] + size[i]], flat[b[i] : b[i] + size[i]])
        else:
            n, full = size[i:j], size[i:j] > 0
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum()))
            unlike = flat[at + np.repeat(a[i:j] - begin, n)] != flat[at + np.repeat(b[i:j] - begin, n)]
            if full.any():
                out[i:j][full] = ~np.logical_or.reduceat(unlike, begin[full])
        i = j
    return out


def word_hashes(flat: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of several texts, in order.

    Returns (hashes, first): text i has the hashes first[i]:first[i + 1]. With `lower`,
    A-Z count as a-z.
    """
    starts, ends, first = word_runs(flat, offsets)
    return run_hashes(flat, starts, ends, lower), first


def word_runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words, in bytes of flat."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = ~_SPACE[flat[lo:hi]]
    n = hi - lo
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cuts = np.zeros(n + 1, bool)
    cuts[offsets - lo] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cuts[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cuts[1:])) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, offsets - lo)


def run_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of non-empty, ascending byte runs, about SLICE_BYTES at a time.

    Every byte adds a random number that depends on its place, so runs collide by chance only
    (2 ** -64 for each two); where results must be exact, callers compare the runs as well.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = _hash_runs(flat[a:b], starts[i:j] - a, ends[i:j] - a, lower)
        i = j
    return out


def code_point_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text: bytes that are not UTF-8 continuations."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    total = np.concatenate(([0], np.cumsum((flat[lo:hi] & 0xC0) != 0x80)))
    return np.diff(total[offsets - lo])
