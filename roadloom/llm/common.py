"""Shared plumbing of the text operators: scratch tables, Arrow text access, hashing.

Everything here works on whole texts. Memory per task is bounded by `SLICE_BYTES`
(plus the longest single text), never by the size of a partition.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 1 << 20

_scratch_dirs: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="roadloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _remove_scratch() -> None:
    for path, spark in _scratch_dirs.items():
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may have ended before the interpreter
            pass


atexit.register(_remove_scratch)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, lost executors lose nothing.

    The table is removed when the interpreter ends, since lazily read results may need it until then.
    """
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/roadloom-{spark.sparkContext.applicationId}"
    _scratch_dirs[root] = spark
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been staged and are not referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold `rows` rows unless the session says otherwise: texts are long, and a batch is
    held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names, made of `names`, that `docs` doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name)
    return tuple(out)


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, equals `rest`; a null id is hashed as an empty string."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest


def text_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE_CODES = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of code(data[j]) * base^j over j < i, so that spans hash by difference."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up, out=out[1:])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than space and tab to carriage return), each
    word's row, and each row's first word (len(rows)+1). Rows never share a word."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = ~_SPACE[data]
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1]
    firsts = offsets[:-1]
    firsts = firsts[(firsts < n) & (np.diff(offsets) > 0)]
    starts_mask[firsts] = inside[firsts]
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    ends_mask[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    h = prefix_hash(data)
    _, down = powers(n)
    hashes = fmix((h[ends] - h[starts]) * down[starts])
    first_word = np.searchsorted(starts, offsets)
    return hashes, np.repeat(np.arange(rows), np.diff(first_word)), first_word
