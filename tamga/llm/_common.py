"""Shared helpers: checkpoints, an exact-join prefilter, flat views of Arrow text, hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None

#: Upper bound of what `IdFilter` broadcasts; beyond it the filter lets more rows through, the join after it stays exact.
FILTER_BYTES = 4 << 20


def shared_folder(spark) -> str:
    """The folder that driver and executors share: the cluster's, or one of our own where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tamga-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark) -> None:
    """Let go of shuffle files that no frame refers to any more. They go when the driver's collector runs, which a driver
    with little to do puts off for long; after a step that moved much and is saved it is worth a call."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark) -> None:
    """Arrow batches of 1,000 rows and 8 MB at most, unless the session has settings of its own: at the defaults a batch of
    long texts, which JVM and worker hold at the same time, takes hundreds of MB for each core."""
    for key, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        try:
            if spark.conf.get(key) == _arrow_defaults.setdefault(key, spark.conf.get(key)):
                spark.conf.set(key, ours)
        except Exception as e:  # a version without the setting
            if "SQL_CONF_NOT_FOUND" not in str(e) and "NoSuchElement" not in str(e):
                raise


_arrow_defaults: dict[str, str] = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def stored_bytes(df: DataFrame, text_col: str) -> int:
    """About the bytes of a text column: the planner's estimate, or a sum where it has none."""
    size = int(df.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


class IdFilter:
    """Bloom filter over a bigint column, built and probed with built-in functions only.

    It only saves shuffling of rows that a later exact join would drop; its size is bounded by FILTER_BYTES.
    """

    HASHES = 3

    def __init__(self, ids: DataFrame, max_bytes: int = FILTER_BYTES):
        name = ids.columns[0]
        self.spark = ids.sparkSession
        n = ids.count()
        self.bits = 1 << 10
        while self.bits < 10 * n and self.bits < 8 * max_bytes:
            self.bits <<= 1
        spots = F.explode(F.array(*[self._spot(F.col(name), i) for i in range(self.HASHES)])).alias("p")
        words = ids.select(spots).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        table = words.toArrow()
        packed = np.zeros(self.bits // 64, dtype="<i8")
        if table.num_rows:
            packed[table.column("w").to_numpy()] = table.column("v").to_numpy()
        self.row = self.spark.createDataFrame([(bytearray(packed.tobytes()),)], "bits binary")

    def _spot(self, value: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(value, F.lit(i)), F.lit(self.bits))

    def has(self, value: Column) -> Column:
        """True for every id that went in, and for a small share of others."""
        packed = self.row.scalar()
        found = F.lit(True)
        for i in range(self.HASHES):
            p = self._spot(value, i)
            byte = F.conv(F.hex(F.substring(packed, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
            found = found & (F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1)
        return value.isNotNull() & found


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind one another, and n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tidy() -> None:
    """Give freed memory back to the system; workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def packed(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """keep and `packed`, each text compressed by itself, for rows that are about to be shuffled."""

    def run(text: pa.Array) -> pa.Array:
        raw, at = flat(text)
        view, press = memoryview(raw), zstandard.ZstdCompressor(level=3)
        return pa.array([press.compress(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())

    return rows.select(*keep, F.arrow_udf(run, "binary")(F.col(text_col)).alias("packed"))


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a `packed` column, as binary."""
    open_ = zstandard.ZstdDecompressor()
    return pa.array([open_.decompress(x) if len(x) else b"" for x in (y.as_buffer() for y in column)], pa.large_binary())


def slices(offsets: np.ndarray, size: int):
    """Ranges of rows with about `size` bytes each, whole rows only."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
