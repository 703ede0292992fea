"""Shared helpers of the training-data operators: stage tables, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import time
import uuid
from contextlib import contextmanager, suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task hashes at a time; bounds its scratch arrays.
CHUNK_BYTES = 1 << 19
SPACES = (0x20, *range(0x09, 0x0E))


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where it is unset a local session, as in tests, gets a
    temporary one; a cluster has no folder that all its machines see by then."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_dir()
    return folder.rstrip("/")


@lru_cache(maxsize=None)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="gateflow-stages-")


#: Bytes that go to a Python task at a time; texts can be long.
BATCH_BYTES = 4 << 20
#: Rows that a scan of a table reads at a time: it holds them as arrays of its own, whole texts and all.
SCAN_ROWS = 512
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS}


def keep_batches_small(spark: SparkSession) -> None:
    """From now on Python tasks of this session get batches of at most about ``BATCH_BYTES``, and scans read at most ``SCAN_ROWS``
    rows at a time, unless it asks for less. For results over whole texts: their tasks run when the caller writes
    them, after the operator has returned, by the settings of that time."""
    for key, most in _BATCHES.items():
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


@contextmanager
def small_batches(spark: SparkSession):
    """Within it batches are small, see :func:`keep_batches_small`; after it the session has its own sizes again."""
    before = {key: spark.conf.get(key) for key in _BATCHES}
    try:
        keep_batches_small(spark)
        yield
    finally:
        for key, size in before.items():
            spark.conf.set(key, size)


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the lineage, and
    survives the loss of any executor. With ``by`` it is written in hash buckets of that column, so that
    joins and groups by it need no shuffle."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{stage_dir(spark)}/{name}"
    writer = df.write.option("compression", "zstd")
    with small_batches(spark):
        if by is None:
            writer.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        writer.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, and the plan knows them
    return out


# --- Python workers --------------------------------------------------------------------------


#: Seconds between two releases of a worker: a task can have thousands of small groups.
RELEASE_S = 1.0
_released = [0.0]


@lru_cache(maxsize=None)
def _give_back() -> None:
    """Once in a worker: what is freed goes back to the system at once, if it is a megabyte or more, and Arrow keeps no store of its own."""
    pa.set_memory_pool(pa.system_memory_pool())
    with suppress(AttributeError, OSError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def release(least_s: float = RELEASE_S) -> None:
    """Hand freed memory back to the system: a worker serves many tasks, and would keep the most that any of them took."""
    if time.monotonic() - _released[0] < least_s:
        return
    _powers.cache_clear()
    gc.collect()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    _released[0] = time.monotonic()


def lean(f):
    """``f``, a generator of a task's batches or a function of one or two groups, with :func:`release` around it."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(batches):
            _give_back()
            release()
            try:
                yield from f(batches)
            finally:
                release(0.2)

    elif len(inspect.signature(f).parameters) == 1:

        @wraps(f)
        def run(group):
            _give_back()
            try:
                return f(group)
            finally:
                release()

    else:

        @wraps(f)
        def run(left, right):
            _give_back()
            try:
                return f(left, right)
            finally:
                release()

    return run


# --- word hashing --------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd multiplier modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up, self.down = self._table(1 << 12)

    def _table(self, n: int):
        out = []
        for b in (self.base, self.inverse):
            x = np.full(n, b, dtype=np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(x, dtype=np.uint64))
        return out

    def upto(self, n: int):
        if n > len(self.up):
            self.up, self.down = self._table(1 << int(n - 1).bit_length())
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=None)
def _byte_table(lower: bool) -> np.ndarray:
    t = seeds(256, 7)
    if lower:
        t[65:91] = t[97:123]
    return t


@lru_cache(maxsize=None)
def _space_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(SPACES)] = True
    return t


@lru_cache(maxsize=None)
def _powers(k: int) -> Powers:
    return Powers(int(seeds(8, 11)[k]))


def windows_hash(items: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive items, for every start where one fits."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(which).upto(len(items))
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * up, out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, hashed from their UTF-8 bytes.

    ``hashes``: one per word, in order; ``first``: the place of each row's first word, and the end;
    ``start``, ``end``: the words' places in ``data``."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, lower: bool):
        rows = rows.astype(np.int64)
        data = data[rows[0] : rows[-1]]
        rows = rows - rows[0]
        n = len(data)
        self.data, self.rows = data, rows
        gap = np.ones(n + 2, dtype=bool)  # gap[i + 1]: byte i is white space
        gap[1:-1] = _space_table()[data]
        cut = np.zeros(n + 1, dtype=bool)  # a row begins here
        cut[rows] = True
        word = ~gap[1:-1]
        self.start = np.flatnonzero(word & (gap[:-2] | cut[:-1]))
        self.end = np.flatnonzero(word & (gap[2:] | cut[1:])) + 1
        up, down = _powers(0).upto(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_byte_table(lower)[data] * up[:n], out=sums[1:])
        self.hashes = mix64((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, rows)

    def __len__(self) -> int:
        return len(self.rows) - 1


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """(first row, bytes, row offsets) of runs of rows with about ``chunk_bytes`` of text each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data, offsets[at : to + 1]
        at = to


def word_chunks(texts: pa.Array, lower: bool):
    """(first row, :class:`Words`) of runs of rows."""
    for at, data, offsets in text_chunks(texts):
        yield at, Words(data, offsets, lower)


# --- connected components ------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates the large-star and small-star steps on the edge table until it no longer changes;
    every step is a shuffle of edges, nothing is collected. Each round's table is staged in the
    shared folder."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage(e)
    marks = (F.count("*"), F.expr("bit_xor(xxhash64(a, b))"))
    old = e.agg(*marks).first()
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large-star: every larger neighbour of a node is tied to the least node around it
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: the node and its smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stage(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        new = e.agg(*marks).first()
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
