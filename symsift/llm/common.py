"""Shared helpers: durable intermediate tables and small numpy primitives."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from symsift.storage import discard, scratch

U64 = np.uint64
MASK64 = (1 << 64) - 1
SHORT = 48  # what sequence_hash mixes in place by place; the rest of a longer stretch is hashed at once


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: what is read later survives the loss of any executor and is
    not computed again.  The table goes when the driver ends, or with ``tidy``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    _saved.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_saved: list[str] = []


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that were saved inside go at the end; only what was written elsewhere stays.

    Gives a second ``save``, whose tables stay until the block around this one ends.
    """
    at = len(_saved)
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = save(df, name)
        kept.append(_saved.pop())
        return out

    try:
        yield keep
    finally:
        for path in _saved[at:]:
            discard(spark, path)
        _saved[at:] = kept


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one freed memory goes back to the system, as Python workers live on through later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def sequence_hash(codes: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of codes[start : start + size] for every stretch, mixed value by value.

    No polynomial: no structure of a stretch makes its hash predictable.
    """
    short = np.minimum(size, SHORT + 1).astype(np.int16)  # sorted by counting
    order = np.argsort(-short, kind="stable")
    first, left, short = start[order], size[order], -short[order]
    h = mix(left.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK64))
    longest = min(-int(short[0]), SHORT) if len(left) else 0
    active = np.searchsorted(short, -np.arange(longest), side="left")  # how many are longer than each place
    at = first.copy()
    for n in active.tolist():
        g, place = h[:n], at[:n]
        g ^= codes[place]
        g *= U64(0xD6E8FEB86659FD93)
        g ^= g >> U64(32)
        place += 1
    for j in range(int(np.searchsorted(short, -SHORT, side="left"))):  # the few long ones
        h[j] ^= U64(xxhash.xxh3_64_intdigest(codes[first[j] + SHORT : first[j] + left[j]].tobytes(), seed & MASK64))
    out = np.empty(len(h), U64)
    out[order] = mix(h)
    return out


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for every n, one after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Rolling:
    """Polynomial hashes of any substring of an array, by prefix sums modulo 2**64."""

    _pw: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        have = self._pw.get(base)
        if have is None or len(have[0]) <= n:
            size = max(1 << 16, 1 << (n + 1).bit_length())
            have = self._pw[base] = (powers(base, size), powers(pow(base, -1, 1 << 64), size))
        self.inverse = have[1]
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * have[0][:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]
