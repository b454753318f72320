"""Pieces shared by the text operators: shared-folder tables, vectorised
tokenising and hashing over Arrow buffers, and fixed-size tables that are merged
on the executors.

Everything here works on bytes. The separators of all word patterns in use are
ASCII, and UTF-8 never uses ASCII bytes inside another character, so splitting
bytes is the same as splitting characters.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.shipping import ship

U64 = np.uint64
#: Odd multipliers for mixing; any odd constants do.
K1, K2, K3, K4 = (U64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Most bytes of text that a task holds decoded at once. Arrays of larger slices fall out of
#: the processor's caches and are mapped and unmapped each time, which doubles the work.
SLICE_BYTES = 1 << 20

_local_root: list[str] = []
_stored: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Settings of sessions as they were before `tune`.
_settings: dict[tuple[str, str], str | None] = {}


# ---------------------------------------------------------------- shared tables
def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a local one on one machine
    (tests); executors elsewhere would not see it, so there it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("executors of a cluster share no local folder: set spark.checkpoint.dir")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="causalframe-"))
    return _local_root[0]


#: For tables whose rows are megabytes: row groups of 16 MB, and sizes looked at after each row
#: (usually only after 100, which a task then holds at once).
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def store(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut and
    the rows outlive every executor."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _stored.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `store` gave and that nothing will read any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path in _stored:
            _stored.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """How many tables are stored: what `release` can go back to."""
    return len(_stored)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this driver stored, or those since a mark, and gives the session
    its own settings back. Call it once results are written."""
    while len(_stored) > since:
        _delete(spark, _stored.pop())
    if not since:
        session = spark._jsparkSession.sessionUUID()
        for own, key in [k for k in _settings if k[0] == session]:
            value = _settings.pop((own, key))
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def tune(spark: SparkSession) -> int:
    """Small Arrow batches, since texts can be long, until `release`; returns the shuffle width.
    Results are lazy and take the settings of the time they run, so these must stay."""
    ship(spark)
    session = spark._jsparkSession.sessionUUID()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        _settings.setdefault((session, key), spark.conf.get(key, None))
        spark.conf.set(key, value)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and local rows that df reads, as the plan knows them; None if it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [n for n in sizes if n < 1 << 60]
    return sum(known) if known else None


def task_count(df: DataFrame) -> int:
    """About how many tasks a scan of df's input has, or a shuffle of it."""
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (input_bytes(df) or 0) // split)


def groups(df: DataFrame, width: int, group_bytes: int) -> int:
    """How many groups to deal df's rows into: by its size, so that a group stays as large as
    it is, and one for each shuffle partition at least (four where the size is not known)."""
    size = input_bytes(df)
    return 4 * width if size is None else max(width, min(-(-size // group_bytes), 1 << 26))


def filter_log2(df: DataFrame, bits_a_byte: float, least: int = 20, most: int = 28) -> int:
    """The size of a filter or table that grows with df's input, up to what a task can hold.
    Beyond that it lets more through; results never depend on it."""
    return min(most, max(least, int((input_bytes(df) or 1 << 30) * bits_a_byte).bit_length()))


def trim() -> None:
    """Gives freed memory back to the system. Workers are used again, and each executor
    has a few: what one task's arrays took would be missing in the next stage."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow that gives memory back after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


def apply_arrow(df: DataFrame, by: str, run: Callable, schema: str) -> DataFrame:
    """applyInArrow by one column that gives memory back after each group."""

    def group(key, table):
        try:
            return run(key, table)
        finally:
            trim()

    return df.groupBy(by).applyInArrow(group, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of these columns (arrays, numpy arrays or lists)."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose column 1 (text) holds about `limit` bytes at most; one longer
    text stands alone and whole."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            base = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


# ------------------------------------------------------------------ raw bytes
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets; null counts as empty."""
    a = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return _LOWER[data]


def _table(separators: list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[separators] = False
    return table


#: Words of any bytes but space and the control characters 9 to 13.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each row's first word (one more than rows)."""
    w = is_word[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = w[edge]
    before = edge[edge > 0] - 1
    end[before] = w[before]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_codes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for every word and the dictionary of distinct words (binary)."""
    if not len(s):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    sizes = e - s
    mark = np.zeros(len(data) + 1, np.int8)
    mark[s] += 1
    mark[e] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(s) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = tokens.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), found.dictionary


# --------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= K2
    x ^= x >> U64(27)
    x *= K3
    x ^= x >> U64(31)
    return x


def _multipliers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * K1) | U64(1)


def hash_bytes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64 bits for each binary value: a multilinear hash, then mixed."""
    data, offsets = text_bytes(dictionary)
    n = np.diff(offsets)
    if not len(n):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        r = _multipliers(int(n.max()) + 1, seed)
        at = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], n)
        terms = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * r[at], out=terms[1:])
        return mix((terms[offsets[1:]] - terms[offsets[:-1]]) + n.astype(U64) * K4)


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len(h) - n + 1 values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, U64)
        for i, k in enumerate(_multipliers(n, 77)):
            total += h[i : i + m] * k
        return mix(total)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


# ----------------------------------------------------------- fixed-size tables
#: Slices that are merged in one group.
FAN_IN = 64


def merge_tables(df: DataFrame, dtype: str, op: str, fan_in: int = FAN_IN) -> np.ndarray:
    """One table out of the partial ones of all tasks. df: (part int, blob binary); each blob
    is a zstd-compressed slice of a table whose size does not depend on the rows. Slices are
    merged on executors, fan_in tasks' at a time, level by level; the driver gets one table."""
    import zstandard

    kind = np.dtype(dtype)

    def merge(key, table):
        total = None
        for blob in table.column("blob"):
            x = np.frombuffer(zstandard.decompress(blob.as_py()), kind)
            total = x.copy() if total is None else (np.bitwise_or if op == "or" else np.add)(total, x, out=total)
        blob = pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())
        return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "blob": blob})

    rows, schema = df.withColumn("task", F.spark_partition_id()).select("part", "task", "blob"), "part int, task int, blob binary"
    # The number of tasks, roughly: with a level too few or too many groups are larger or smaller.
    tasks = task_count(df)
    while tasks > fan_in:
        rows = rows.withColumn("task", (F.col("task") / fan_in).cast("int"))
        rows = apply_arrow(rows.withColumn("grp", F.concat_ws("/", "part", "task")), "grp", merge, schema)
        tasks = -(-tasks // fan_in)
    found = {r["part"]: np.frombuffer(zstandard.decompress(r["blob"]), kind) for r in apply_arrow(rows, "part", merge, schema).collect()}
    return np.concatenate([found[p] for p in sorted(found)]) if found else np.zeros(0, kind)


def table_slices(table: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    import zstandard

    blobs = [zstandard.compress(x.tobytes(), 1) for x in np.split(table, parts)]
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


class Bloom:
    """A filter. It only ever lets too much through, so results do not depend on its size."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, U64(len(bits) * 8 - 1)

    @staticmethod
    def empty(log2_bits: int) -> Bloom:
        return Bloom(np.zeros(1 << (log2_bits - 3), np.uint8))

    def _at(self, h: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            second = mix(h + K4) | U64(1)
            for i in range(4):
                yield (h + second * U64(i)) & self.mask

    def add(self, h: np.ndarray) -> None:
        for x in self._at(h):
            np.bitwise_or.at(self.bits, (x >> U64(3)).astype(np.int64), np.uint8(1) << (x & U64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for x in self._at(h):
            ok &= (self.bits[(x >> U64(3)).astype(np.int64)] >> (x & U64(7)).astype(np.uint8)) & np.uint8(1) != 0
        return ok


def bloom_of(df: DataFrame, columns: list[str], log2_bits: int) -> np.ndarray:
    """Bits of a filter over 64-bit values, built in parts and merged on executors."""

    def run(batches):
        filled = Bloom.empty(log2_bits)
        for b in batches:
            for c in range(b.num_columns):
                filled.add(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
        yield table_slices(filled.bits)

    return merge_tables(map_arrow(df.select(*columns), run, "part int, blob binary"), "uint8", "or")


# --------------------------------------------------------------------- digests
def doc_key(ids: pa.Array, text: pa.Array) -> list[bytes]:
    """16 bytes that stand for (doc_id, text): the same in every pass over the
    documents, whatever the order of rows. Equal rows share it."""
    import xxhash

    found = []
    for i, t in zip(ids.to_pylist(), text.cast(pa.large_binary()).to_pylist(), strict=True):
        x = xxhash.xxh3_128(b"-" if i is None else str(i).encode())
        x.update(b"\0" + (t or b""))
        found.append(x.digest())
    return found
