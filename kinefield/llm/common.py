"""Shared pieces of the corpus operators: scratch tables, Arrow batches, hashing.

Scratch tables are Parquet files in the folder that ``spark.checkpoint.dir``
names, so any executor can read them again after another one is lost.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LIBC = ctypes.CDLL(None)
#: Text bytes that a numpy pass works on at once; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 19
#: Rows that a numpy pass takes at most, and rows of an Arrow batch: long texts make
#: batches of the default size, 10,000 rows, too large for a small executor.
BATCH_ROWS, ARROW_ROWS = 512, 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one in local mode alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinefield-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables and files of one run of an operator, under one folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/kinefield/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; this cuts the lineage."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches have ARROW_ROWS rows, if they had the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that none of ``columns`` has, in any case of letters."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give the memory that numpy and Arrow have freed back to the system.

    Workers are used again by other stages, and what they keep counts against the executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with freed memory given back after each."""
    for batch in batches:
        yield batch
        del batch
        release()


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow with batches cut to BATCH_ROWS rows.

    ``fn(batch)`` yields record batches or dicts of column arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(struct)
        for batch in released(batches):
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for got in fn(batch.slice(at, BATCH_ROWS)):
                    if isinstance(got, dict):
                        got = pa.RecordBatch.from_arrays(
                            [as_arrow(got[f.name], f.type) for f in out], schema=out
                        )
                    yield got

    return df.mapInArrow(run, struct)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values.cast(kind) if values.type != kind else values
    return pa.array(values, type=kind)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = max(at + 1, min(to, n))
        yield at, to
        at = to


# Hashing ---------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """P[i] = sum of (symbol j + 1) * BASE**j over j < i, modulo 2**64."""
    up, _ = powers(len(symbols))
    sums = np.empty(len(symbols) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


#: Spans beyond so many bytes are hashed one by one.
LANE_BYTES = 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end), wherever it lies.

    Spans are taken in words of 8 bytes, each mixed into the hash so far, so there is no
    algebra between places (as a polynomial has), and spans of equal length up to 8 bytes
    never collide.
    """
    import xxhash

    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(seed) * BASE + np.uint64(1))
    if not len(out):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words_ = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    long = size > LANE_BYTES
    left = np.flatnonzero(~long & (size > 0))
    for at in range(0, LANE_BYTES, 8):
        if not len(left):
            break
        lane = words_[start[left] + at]
        short = (8 * np.minimum(size[left] - at, 8)).astype(np.uint64)
        lane &= ~np.uint64(0) >> (np.uint64(64) - short)
        out[left] = mix((out[left] ^ lane) * BASE)
        left = left[size[left] > at + 8]
    if long.any():
        view = memoryview(padded)
        where = np.flatnonzero(long)
        out[where] = [
            xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)
        ]
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+`` and the first word of each row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the first of each row.

    A row with fewer words, but one at least, has the whole sequence as one.
    """
    start, end, first = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = span_hashes(lowered(data), start, end)
    count = np.diff(first)
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], have)
    size = np.repeat(np.minimum(count, width), have)
    out = mix(size.astype(np.uint64))
    whole = size.min(initial=width) == width
    for k in range(width):
        if whole:
            out = mix((out ^ word[at + k]) * BASE)
        else:
            some = np.flatnonzero(size > k)
            out[some] = mix((out[some] ^ word[at[some] + k]) * BASE)
    return out, begin


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
