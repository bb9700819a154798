"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.session import ensure_checkpoint_dir, ship_package

#: A table is broadcast only when rows x bytes per row stays below this.
BROADCAST_BYTES = 32 << 20

#: Bits of a bitmap of keys: a power of two, of 16 a key or more, up to 32 MB.
MAX_BITS = 1 << 28
_BUCKET = 1 << 15

WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn, schema: str | T.StructType, **params) -> DataFrame:
    """``mapInArrow`` with a module-level function and bound parameters."""
    ship_package(df.sparkSession)
    return df.mapInArrow(partial(_released, partial(fn, **params)), schema)


def _released(fn: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _busy()
    yield from fn(batches)
    release()
    _idle()


def release() -> None:
    """Hand freed memory back to the machine: an idle worker of one operator else keeps its peak while
    the next one's workers grow beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def binary_column(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """A string column as bytes objects (no decoding, tolerant of odd bytes)."""
    return batch.column(i).cast(pa.binary()).to_pylist()


def binary_values(batch: pa.RecordBatch, i: int) -> Iterator[bytes | None]:
    """As ``binary_column``, one value at a time."""
    return (v.as_py() for v in batch.column(i).cast(pa.binary()))


def record_batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, schema)],
        schema=schema)


def empty_guard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows."""
    return (b for b in batches if b.num_rows)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def optional(df: DataFrame, name: str, kind: str = "string"):
    """The named column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


_WORKER: dict = {}
#: Seconds without a task after which a worker drops its table.
IDLE_SECONDS = 3.0
_timer: threading.Timer | None = None


def _busy() -> None:
    if _timer:
        _timer.cancel()


def _idle() -> None:
    """Drop the worker's table unless a task follows soon: Spark keeps idle workers for a minute, beside those
    of the next session's tasks."""
    global _timer
    _busy()
    _timer = threading.Timer(IDLE_SECONDS, _forget)
    _timer.daemon = True
    _timer.start()


def _forget() -> None:
    _WORKER.clear()
    gc.collect()
    release()


def worker_cache(name, make):
    """A table that lives as long as the Python worker; only the last operator's stays, so stages that
    follow each other in the same workers don't add up."""
    found = _WORKER.get(name)
    if found is None:
        _WORKER.clear()
        gc.collect()
        release()
        found = _WORKER[name] = make()
    return found


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint behind a size check; beyond it Spark joins by shuffle (and AQE splits skew)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


class KeyFilter:
    """Bitmap of two bits a key; never misses a key that is in it."""

    def __init__(self, bits: int, buckets: list[tuple[int, bytes]]):
        self.mask = np.uint64(bits - 1)
        self.map = np.zeros(max(1, bits // _BUCKET) * (_BUCKET // 8), np.uint8)
        for no, part in buckets:
            self.map[(no - 1) * (_BUCKET // 8):][:len(part)] = np.frombuffer(part, np.uint8)

    def _set(self, at: np.ndarray) -> np.ndarray:
        at = at & self.mask
        return self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0

    def where(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in it."""
        hit = np.nonzero(self._set(keys))[0]
        return hit[self._set(keys[hit] >> np.uint64(32))]


def filter_bits(keys: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(_BUCKET, 1 << (16 * keys - 1).bit_length() if keys else 0))


def bitmap(bits: DataFrame) -> DataFrame:
    """(no, map) of 4 kB parts of the bitmap of ``bit``; dealt by part first, since partial maps of every task would be
    larger than the bits."""
    at = bits.select((F.col("bit") + 1).alias("bit"))  # these functions count from 1
    at = at.select(F.bitmap_bucket_number("bit").alias("no"), F.bitmap_bit_position("bit").alias("position"))
    return at.repartition("no").groupBy("no").agg(F.bitmap_construct_agg("position").alias("map"))


def key_filter(keys: DataFrame, total: int, max_bits: int = MAX_BITS) -> KeyFilter:
    """Filter of the 64-bit ``key`` column; at most max_bits / 8 bytes reach the driver."""
    bits = filter_bits(total, max_bits)
    halves = keys.select(F.explode(F.array("key", F.shiftrightunsigned("key", 32))).alias("bit"))
    maps = bitmap(halves.select(F.col("bit").bitwiseAND(F.lit(bits - 1)).alias("bit")))
    return KeyFilter(bits, [tuple(r) for r in maps.collect()])


def _marked(rows: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``__may``: whether its (file, row) may be among ``some``. The bitmap is broadcast; its size is bounded."""
    bits = filter_bits(n)
    key = F.xxhash64("file", "row").bitwiseAND(F.lit(bits - 1))
    maps = bitmap(some.select(key.alias("bit"))).withColumnsRenamed({"no": "__no", "map": "__map"})
    at = F.bitmap_bit_position(key + 1)
    byte = F.conv(F.hex(F.substring("__map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int"), F.lit(2)) == 1, F.lit(False))
    return (rows.withColumn("__no", F.bitmap_bucket_number(key + 1)).join(F.broadcast(maps), "__no", "left")
            .withColumn("__may", held).drop("__no", "__map"))


def at_rows(rows: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """``rows`` (file, row, ...) joined with the ``n`` rows of ``some``. Beyond the broadcast bound a bitmap of them is applied
    in the scan first, so texts that aren't asked for stay where they are."""
    if n * 256 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(some), ["file", "row"])
    return _marked(rows, some, n).where("__may").drop("__may").join(some, ["file", "row"])


def not_at_rows(rows: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """``rows`` (file, row, ...) without the ``n`` rows of ``some``; texts that surely stay are not shuffled."""
    if n * 256 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(some), ["file", "row"], "left_anti")
    marked = _marked(rows, some, n)
    doubtful = marked.where("__may").drop("__may").join(some, ["file", "row"], "left_anti")
    return marked.where(~F.col("__may")).drop("__may").unionByName(doubtful)


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (SplitMix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Make an empty folder where nothing was written (a stream without rows)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
