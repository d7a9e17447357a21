"""Vectorised text primitives shared by the corpus operators.

Texts come in as Arrow string arrays and are handled as one byte buffer with
document offsets, so words, lines and n-grams are found and hashed with numpy
over megabytes at a time.  Work is cut into document-aligned chunks, which
bounds memory whatever the size of an Arrow batch; a single document longer
than a chunk is a chunk of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(*parts) -> np.ndarray:
    """Boolean table over the 256 bytes; each part is a string or an inclusive (low, high) pair."""
    table = np.zeros(256, bool)
    for part in parts:
        if isinstance(part, tuple):
            table[part[0] : part[1] + 1] = True
        else:
            table[list(part.encode())] = True
    return table


#: bytes of words: all but blank, tab, LF, VT, FF and CR
NOT_SPACE = ~byte_table(" ", (0x09, 0x0D))
#: bytes of words once A-Z are lower-cased: digits, a-z and all of a multi-byte character
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the splitmix64 constants), for uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; only the tables of one chunk size are kept."""
    if n > CHUNK_BYTES + 1:
        return _new_powers(n)
    if not _powers:
        _powers[0] = _new_powers(CHUNK_BYTES + 1)
    up, down = _powers[0]
    return up[:n], down[:n]


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        a = np.full(n, _U(base))
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def rolling_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64: spans are hashed by ``span_hash``."""
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    up, _ = _power_tables(len(data) + 1)
    np.cumsum(_TABLE[data] * up[:-1], out=prefix[1:])
    return prefix


#: spans from which on bytes are hashed by a cryptographic hash: long ones with equal polynomials can be made on purpose
LONG_SPAN = 512


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand.

    ``data``, the bytes of ``prefix``, must be given where spans of ``LONG_SPAN``
    bytes or more may occur and hashes stand for the bytes.
    """
    _, down = _power_tables(len(prefix))
    size = ends - starts
    out = mix((prefix[ends] - prefix[starts]) * down[starts] + size.astype(np.uint64))
    if data is not None:
        for k in np.flatnonzero(size >= LONG_SPAN).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(np.ascontiguousarray(data[starts[k] : ends[k]]), digest_size=8).digest(), "little")
    return out


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Order-dependent hash of several aligned uint64 arrays."""
    out = np.full(len(parts[0]), _U(seed))
    for part in parts:
        out = mix(out * _U(0x9FB21C651E98DF25) + part)
    return out


class Chunk:
    """Some consecutive documents: ``data`` bytes, ``off`` their offsets, ``first`` the row of the first one."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first = data, off, first

    def __len__(self) -> int:
        return len(self.off) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of ``table`` bytes, and the offset of each document in them."""
        inside = table[self.data]
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.off)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string array as chunks of documents; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield Chunk(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``off`` cuts it into (empty ranges give 0)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


#: bits of a filter for each of its hashes, and its bits at most; filters only save work
HASH_BITS, MOST_BITS = 16, 27


def bit_filter(hashes: DataFrame, column: str) -> bytes:
    """Which low bits the longs of a column have: some bits a row, 2**MOST_BITS (16 MB) at most."""
    bits = min(MOST_BITS, max(10, (HASH_BITS * hashes.count()).bit_length()))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def in_filter(raw: bytes, values: np.ndarray) -> np.ndarray:
    """For each 64-bit value whether its low bits are in the filter."""
    bits = np.frombuffer(raw, np.uint8)
    low = (values.view(_U) & _U(8 * len(bits) - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dictionary that an operator keeps in a worker from task to task, until a released task of another one begins there."""
    return _caches.setdefault(name, {})


def _drop_caches(keeps: str | None) -> None:
    for name, cache in _caches.items():
        if cache and name != keeps:
            cache.clear()
            gc.collect()
            _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(task, keeps: str | None = None):
    """``task`` for mapInArrow, giving freed memory back to the system at its end, as workers are used again.

    What other operators than ``keeps`` left in the worker goes before it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_caches(keeps)
        yield from task(batches)
        _release()

    return run


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (not made yet) below the folder that the whole cluster shares.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder of this process stands in, but only for a local master: on
    a cluster every machine would write to a disk of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local:
            made = tempfile.mkdtemp(prefix="caselens-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _local[context.applicationId] = f"file://{made}"
        root = _local[context.applicationId]
    return f"{root.rstrip('/')}/caselens/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage and survives lost executors.  ``discard`` takes it away."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
