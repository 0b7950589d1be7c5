"""Helpers shared by the training-data operators.

Everything here runs inside Spark tasks (numpy over the buffers of one Arrow batch) or only builds
DataFrames; nothing gathers rows on the driver.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy pass; a single longer text makes a pass of its own.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 4 + 3
_STEP = int(_rng.integers(1 << 61, 1 << 62)) * 4 + 3
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and shift)."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        a = np.full(max(n, 1 << 16), base, dtype=_U)
        a[0] = 1
        got = _powers[base] = np.multiply.accumulate(a)
    return got[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def release() -> None:
    """Gives memory that this Python worker has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that ends by giving freed memory back."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes, the n + 1 byte offsets and the non-null mask of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    valid = np.ones(n, dtype=bool) if not col.null_count else np.asarray(col.is_valid())
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs, valid


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each row, and the n + 1 offsets of rows in words."""
    base = int(offs[0])
    d = data[base : int(offs[-1])]
    o = offs - base
    solid = ~_WS[d]
    cut = np.zeros(len(d) + 1, dtype=bool)
    cut[o] = True
    before = np.empty(len(d), dtype=bool)
    after = np.empty(len(d), dtype=bool)
    if len(d):
        before[0] = after[-1] = False
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts + base, ends + base, np.searchsorted(starts, o, side="left")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, _U)
    lo, hi = int(starts[0]), int(ends[-1])
    d = data[lo:hi]
    if lower:
        d = _LOWER[d]
    total = np.empty(len(d) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(_BYTE[d] * _pow(_BASE, len(d)), out=total[1:])
    s, e = starts - lo, ends - lo
    h = (total[e] - total[s]) * _pow(_inverse(_BASE), len(d))[s]
    return mix(h + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` consecutive words (rows are not told apart; the caller picks the starts)."""
    n = len(words)
    if n < width:
        return np.zeros(0, _U)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    np.cumsum(words * _pow(_STEP, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * _pow(_inverse(_STEP), n)[: n - width + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def partitions(spark: SparkSession, amount: int = 0, each: int = 1) -> int:
    """Parts to deal `amount` over, `each` in a part; never fewer than the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-amount // each))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a local session gets one of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name never meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, each one shuffle over the remaining edges, and stores the edges after
    each round. The number of rounds grows with the logarithm of the longest chain, so `rounds` is never met in
    practice; running out raises, it never returns unfinished labels.
    """
    spark = edges.sparkSession
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = e
    state = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = stored(small.filter("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("connected_components did not settle")
    ids = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return ids.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
