"""What the operators of this folder share: shipping the package, written tables, words of a text."""

from __future__ import annotations

import ctypes.util
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import parley
from parley.session import shared_folder

#: Bytes of text that a pass holds as Python objects at once.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a worker, where the session does not say: by default it would be 10,000 texts of any length.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Entries of a cache of words in a Python worker.
CACHE_WORDS = 200_000
#: Bits of the filter of ``touched``: its size does not depend on the data.
MARK_BITS = 1 << 24
#: Longer words are not kept in a cache.
CACHED_BYTES = 64
#: White space that ends a word: space and U+0009 to U+000D, as bytes.split() has it.
BLANKS = b"\t\n\x0b\x0c\r "

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as spark-submit --py-files does, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(parley.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="parley-code-"), "parley.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; it goes when the application ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as a long and the text of a table; whatever else it holds, under whatever name, stays out."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def touched(docs: DataFrame, mark: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose mark is surely none of ``marks``, and the others with their ``__mark``; both keep all columns.

    The marks are a filter of ``MARK_BITS`` bits in words of 32, which is broadcast: at most MARK_BITS / 32 rows, whatever
    the number of marks. So texts that no mark concerns need no shuffle.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS))
    one = lambda b: F.expr(f"shiftleft(1L, cast({b} & 31 as int))")
    words = marks.select(bit("mark").alias("__bit")).groupBy(F.shiftright("__bit", 5).alias("__word"))
    words = words.agg(F.bit_or(one("__bit")).alias("__mask"))
    rows = docs.withColumn("__mark", mark).withColumn("__bit", bit("__mark"))
    rows = rows.withColumn("__word", F.shiftright("__bit", 5)).join(F.broadcast(words), "__word", "left")
    maybe = F.coalesce(F.col("__mask").bitwiseAND(one("__bit")) != 0, F.lit(False))
    return rows.where(~maybe).select(*docs.columns), rows.where(maybe).select(*docs.columns, "__mark")


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on the workers, which give back what a task held before the next."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return free memory of this worker to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(found := ctypes.CDLL(libc), "malloc_trim"):
        found.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8 or None) runs of a batch, of at least one row and about ``most`` bytes."""
    column = batch.column(text).cast(pa.binary())
    ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(column).fill_null(0)))) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def pieces(data: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in runs of about ``most`` bytes that end between two words."""
    at = 0
    while len(data) - at > most:
        cut = at + most
        found = [x for x in (data.find(bytes([b]), cut) for b in BLANKS) if x >= 0]
        cut = min(found, default=len(data))
        yield data[at:cut]
        at = cut
    if at < len(data):
        yield data[at:] if at else data


def make_room(cache: dict, more: int, most: int | None = None) -> None:
    """Where ``more`` entries would go over the bound, keep the older half: frequent words come early."""
    most = most or CACHE_WORDS
    if len(cache) + more > most:
        for key in list(cache)[most // 2 :]:
            del cache[key]


def drop_long(cache: dict, keys: Iterable[bytes]) -> None:
    """Take the long ones of some entries out again."""
    for key in keys:
        if len(key) > CACHED_BYTES:
            cache.pop(key, None)


class Hashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                make_room(self, 1)
            self[word] = value
        return value


def hashes_of(words: list[bytes], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes modulo 2^64 over runs of word hashes, with an odd base and its inverse.

    The hash of words x0..x(n-1) is the sum of xi * base^i, mixed at the end. Powers are kept as tables that grow with the
    longest text seen.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(4096, 2 * n)
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in (self.base, self.inverse)
            )

    def windows(self, x: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` in order of their start; none if there are fewer."""
        if len(x) < n or not n:
            return np.zeros(0, np.uint64)
        self._grow(len(x))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        out = (sums[n:] - sums[:-n]) * self.down[: len(x) - n + 1]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """For n places, whether one of the windows of ``width`` that begin at ``starts``, all different, covers it."""
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + width] -= 1
    return np.cumsum(change[:n]) > 0
