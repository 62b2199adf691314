"""Shared helpers: joins that split hot keys, filters of fixed size, and byte-level text kernels in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from manifoldry.operators.shared import clear_scratch, cut, drop_scratch, scratch_path, shared_dir  # noqa: F401

U64 = np.uint64
_LIBC = ctypes.CDLL(None)


#: A key with less rows than the first is never hot; more keys than the second can't be, since each has more than its part of all rows; and in how many parts a hot key falls.
COLD, HOT, SALTS = 10_000, 4096, 64


def join_by_counts(left: DataFrame, right: DataFrame, keys: list[str], count: str, by: str) -> DataFrame:
    """The inner join of left with right, a written table with one row a key and in `count` how many rows of left have that key.

    A key that holds over a HOTth of all rows is dealt to SALTS tasks, by the hash of left's column `by`. The keys to look out for are HOT rows at most, a proven bound for their broadcast.
    """
    total, most = right.agg(F.sum(count), F.max(count)).first()
    least = max(COLD, -(-(total or 0) // HOT))
    if (most or 0) < least:
        return left.join(right, keys)
    is_hot = F.col(count) >= least
    hot = right.where(is_hot).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    salted = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot").join(salted, [*keys, "__salt"]).drop("__salt")


#: Words of 64 bits of a filter: it is of a fixed size, and lets more rows through than it must where very many are known.
FILTER = 1 << 19


def sift(df: DataFrame, known: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df in two parts by a column of 64-bit hashes: rows whose hash known's column of that name may hold, and rows whose hash it surely doesn't. What is done with the first shuffles no row of the second."""
    word, bit = F.col(column).bitwiseAND(FILTER - 1), F.shiftrightunsigned(column, 58).cast("int")
    # FILTER rows at most: a proven bound
    bits = known.groupBy(word.alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 58) as int))")).alias("__bits"))
    sifted = df.withColumn("__word", word).join(F.broadcast(bits), "__word", "left").withColumn("__may", F.coalesce(F.getbit("__bits", bit), F.lit(0)) == 1)
    return tuple(sifted.where(c).select(*df.columns) for c in ("__may", "not __may"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on an array of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The separators of words: the bytes 20 and 09-0D in hex.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))


class Family:
    """A polynomial hash family over unsigned 64-bit symbols; two families give 128 bits."""

    def __init__(self, number: int):
        self.base = _BASES[number]
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))
        self.byte = splitmix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019 + 2 * number))
        self._up = self._down = np.ones(1, dtype=U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                self._up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, self.base)]), dtype=U64)
                self._down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, self.inverse)]), dtype=U64)
        return self._up, self._down

    def spans(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of symbols[starts:ends], each of at least one symbol."""
        if not len(starts):
            return np.zeros(0, dtype=U64)
        up, down = self.powers(len(symbols) + 1)
        total = np.zeros(len(symbols) + 1, dtype=U64)
        np.cumsum(symbols * up[: len(symbols)], out=total[1:], dtype=U64)
        return splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


FAMILIES = (Family(0), Family(1))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), at


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about limit bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the rows, and each row's first word (n + 1 values)."""
    sep = SEPARATOR[data]
    inside = ~sep
    full = offsets[1:] > offsets[:-1]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= sep[:-1]
        end[:-1] &= sep[1:]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first] = inside[first]
        end[last] = inside[last]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    starts = np.flatnonzero(begin[lo:hi]) + lo
    ends = np.flatnonzero(end[lo:hi]) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: Family = FAMILIES[0], limit: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in pieces of bounded memory; a word longer than limit makes a longer piece."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = family.spans(family.byte[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on and does other work."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """In here, batches of rows on their way to Python workers hold about `size` instead of up to 64 MB, on both sides: for stages that write all they ask of the workers before they return."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def append_columns(df: DataFrame, text_col: str, fields: str, fn, keep: list[str] | None = None) -> DataFrame:
    """df's columns (or only those in keep) and new ones: fn(column of text) gives the arrays of the DDL in fields, in order.

    A column of df with the name of a new one is replaced, as by withColumn. Row order inside a batch stays.
    """
    new = StructType.fromDDL(fields)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    schema = StructType([*(df.schema[c] for c in kept), *new])
    # by place, under names that can't clash
    given = df.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = bytes_of(batch.column(len(kept)))
            for lo, hi in slices(at, 2 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *fn(part.column(len(kept)))], names=schema.names)
        trim()

    return given.mapInArrow(run, schema)
