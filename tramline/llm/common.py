"""What the operators of this subpackage share: tables, the shared folder, and byte arrays of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_dir, written  # noqa: F401

#: Texts are worked on in slices of about so many bytes, which bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20
#: Stands for a null doc_id in join keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, through Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key() -> list[Column]:
    """Join key of a document row: its id (null has its own value) and a hash of its text, so that rows that repeat an id stay apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")]


#: Bits of a bitmap of document keys: 8 MB, whatever the number of documents.
BITS = 1 << 26


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with _may: false only where no row of ``keys`` has their _d and _h, so such rows need not be shuffled to find that out.

    The keys' hashes make a bitmap of fixed size, in parts of 32,768 bits; that is what is sent to the rows.
    """
    bit = F.pmod(F.xxhash64("_d", "_h"), F.lit(BITS)) + 1
    parts = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    own = rows.withColumn("_bit", bit).join(F.broadcast(parts), F.bitmap_bucket_number("_bit") == F.col("_part"), "left")
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.col("_bits").isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return own.withColumn("_may", F.coalesce(may, F.lit(False))).drop("_bit", "_part", "_bits")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of column ``name``; at least a row each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        _, off, *_ = col.buffers()
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2 for _ in _BASES]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n+1 powers of a base and of its inverse modulo 2^64; grown when needed."""
    own = _POWERS[which]
    if len(own[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            own[k] = np.multiply.accumulate(step)
    return own[0][: n + 1], own[1][: n + 1]


class Rolling:
    """Hashes of any substrings of one byte array, from a prefix sum; ``which`` base."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        up, self.down = powers(n, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def all(self, k: int) -> np.ndarray:
        """Of every substring of k bytes."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, in two passes over blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; intervals that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
