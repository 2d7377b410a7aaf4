"""Shared helpers: written intermediate tables, word splitting and hashing on Arrow text.

Words are maximal runs of bytes other than space and 0x09-0x0D.  Since all
separators are ASCII, splitting the UTF-8 bytes equals splitting the text.
Hashes are 64-bit; they identify words, shingles and windows (two different
ones meet with probability about n^2 / 2^65 for n distinct values).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemscope.session import checkpoint_dir

#: Text handled at once inside a task; bounds numpy's temporary arrays.
SLICE_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stash(df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back, in a folder for each value of ``by``.

    ``codec``: of the files, if not the session's.

    Cuts the lineage with a table every executor can read again, so a lost
    executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/itemscope-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the written table replaces the shuffle files behind it
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that ``stash`` wrote (or their folder ``part``), once all that reads them is written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{table._stash_path}/{part}".rstrip("/"))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that sums of hashes spread over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with about ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_bytes(batch.column(text))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of a slice of texts: ``start``/``end`` in ``data`` and row ``doc``."""

    __slots__ = ("data", "off", "start", "end", "doc", "n")

    def __init__(self, data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.off, self.n = data, off, len(off) - 1
        inside = ~separator[data]
        first = np.ones(len(data), bool)
        last = np.ones(len(data), bool)
        if len(data):
            first[1:] = ~inside[:-1]
            last[:-1] = ~inside[1:]
            edge = off[:-1][off[:-1] < len(data)]
            first[edge] = True
            last[edge[edge > 0] - 1] = True
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        with np.errstate(over="ignore"):
            total = np.cumsum(size)
            begin = total - size
            at = np.arange(total[-1]) - np.repeat(begin, size)
            value = BYTE_VALUES[self.data[at + np.repeat(self.start, size)]]
            value *= powers(int(size.max()))[at]
            return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def words(col: pa.Array, lower: bool = True) -> Words:
    data, off = text_bytes(col)
    return Words(LOWER[data] if lower else data, off)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weight = mix(powers(k + 1)[1:] + np.uint64(k))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i:i + n] * (weight[i] | np.uint64(1))
    return mix(out)


def shingle_sets(w: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of k-word shingles) of every row.

    A row with 1 to k-1 words has its whole sequence as one shingle; a row
    without words has the empty set.
    """
    h = w.hashes()
    full = window_hashes(h, k)
    edge = np.searchsorted(w.doc, np.arange(w.n + 1))
    for i in range(w.n):
        lo, hi = edge[i], edge[i + 1]
        if hi - lo >= k:
            yield i, np.unique(full[lo:hi - k + 1])
        elif hi > lo:
            yield i, window_hashes(h[lo:hi], int(hi - lo))
        else:
            yield i, np.zeros(0, np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.uint64).view(np.int64)


def lists(values: list[np.ndarray], dtype=np.int64) -> pa.Array:
    """One Arrow list per array."""
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(dtype, copy=False)))


def clean_names(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns the operator reads, so extra columns cannot clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in keep])


def with_arrow_columns(df: DataFrame, reads: list[str], make, new: list[T.StructField],
                       limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns made by ``make(slice) -> arrays``, without a shuffle.

    Own columns pass through as they are; those named like a new one are dropped,
    unless ``make`` reads them (then the new ones replace them).
    """
    names = [f.name for f in new]
    own = [c for c in df.columns if c not in names]
    held = [F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(own)]
    held += [F.col(f"`{c}`").alias(f"in{j}") for j, c in enumerate(reads)]
    schema = T.StructType([T.StructField(f"own{i}", df.schema[c].dataType) for i, c in enumerate(own)] + new)

    def run(batches):
        for part in slices(batches, f"in{len(reads) - 1}", limit):
            given = pa.RecordBatch.from_arrays([part.column(f"in{j}") for j in range(len(reads))], names=reads)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(own))] + make(given),
                                             names=schema.names)
    return df.select(*held).mapInArrow(run, schema).toDF(*own, *names)


def numbered(df: DataFrame, reads: list[str]) -> DataFrame:
    """``df`` with columns own0, own1, ... and copies of ``reads`` under their names,
    so that an operator's own column names cannot clash with the table's."""
    return df.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(df.columns)],
                     *[F.col(f"`{c}`") for c in reads])


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back from ``numbered`` to the columns of ``like``."""
    return df.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(like.columns)])
