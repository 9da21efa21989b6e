"""What the training-data operators share: reading, cutting lineage, flat views of Arrow text.

Tables that cut lineage are written as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-run
of tasks, never of the whole job, and nothing lives on one machine's disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a stored table is broadcast instead of shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The temporary folder of each application that names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        app = spark.sparkContext.applicationId
        where = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="lodestone-"))
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession, size: str = "4m") -> None:
    """Bounds Arrow batches by bytes and not only by rows, which may be long texts; a bound of the user's own stays.

    Batches are made when a result is written, so the setting has to outlive the call.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own
        spark.conf.set(key, size)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is a stored table of at most that many rows and bytes; else unchanged."""
    wide = [F.octet_length(F.col(c).cast("string")) for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "struct", "map"))]
    each = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))
    n, total = df.agg(F.count(F.lit(1)), F.sum(each.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


#: What drops that which an operator remembers in a Python worker between its tasks, by the operator's name.
remembered: dict[str, Callable[[], None]] = {}
_tidied = 0.0


def tidy() -> None:
    """Give freed memory back to the system; the C library and Arrow's pool else keep it as long as the worker lives."""
    global _tidied
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
    _tidied = time.monotonic()


def forget(keeps: str = "") -> None:
    """Drop what all operators but one remember in this worker."""
    for name, drop in remembered.items():
        if name != keeps:
            drop()


def lean(run: Callable, keeps: str = "") -> Callable:
    """``run`` over batches, for a Python worker that other operators' tasks use before and after.

    What others remember is dropped first, and memory given back afterwards.
    The task names functions of this module only: variables would go to the worker as copies.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


def lean_groups(run: Callable) -> Callable:
    """``run`` on one group at a time; memory is given back at most twice a second."""

    @functools.wraps(run)
    def group(rows):
        out = run(rows)
        settle()
        return out

    return group


def settle() -> None:
    if time.monotonic() - _tidied > 0.5:
        forget()
        tidy()


def text_key(doc_id: Column, text: Column) -> Column:
    """32 bytes that tell rows of different id or text apart; nulls are values of their own."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("\0")).otherwise(F.lit(":")), F.coalesce(text.cast("string"), F.lit(""))), 256))


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is worked out once for a row, also if ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that on pure ASCII; other texts take the slower ``translate``."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C55)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        size += size // 4
        _powers[:] = []
        for b in (BASE, UNBASE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, symbol: np.ndarray = SYMBOL) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for every range, whatever its place, by one prefix sum."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(symbol[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
