"""What the corpus operators share: tables in the shared folder, and text as numpy arrays.

Texts reach Python as Arrow batches. The helpers here work on the UTF-8 bytes of a whole batch at
once, in chunks of about CHUNK bytes (a longer document is a chunk of its own), so that a worker's
memory follows its longest document and not its partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.store import dropped, shared_dir, written  # noqa: F401

CHUNK = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
#: Java's form of the characters between words.
GAP = r"[\x20\x09-\x0D]+"


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def joined_small(big: DataFrame, small: DataFrame, key: str, limit: int, salts: int = 16) -> DataFrame:
    """big left join small on key. small is broadcast if it is counted to have at most limit rows;
    beyond that, big's hot keys are spread over salted copies of small's rows."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), key, "left")
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], "left").drop("__salt")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back, unlike the pooling ones
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges [i, j) of about `most` bytes each, a row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1, i + 1)
        yield i, j
        i = j


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOL = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """(base to the i, its inverse) modulo 2**64, for i up to n."""
    if held.get("n", -1) < n:
        size = max(n + 1, CHUNK + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        held.update(n=size - 1, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return held["up"], held["down"]


class Hashes:
    """Hashes of any stretch [i, j) of a sequence of 64-bit symbols in constant time."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mixed((self.sums[j] - self.sums[i]) * self.down[i])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _SYMBOL[data]


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, the number of words before each document and in all) of a batch's words."""
    n = len(data)
    inside = ~_GAP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words(), and a 64-bit hash of each word."""
    starts, ends, before = words(data, offsets)
    symbols = byte_symbols(_LOWER[data] if lower else data)
    hashes = Hashes(symbols).of(starts, ends) + (ends - starts).astype(np.uint64)
    return starts, ends, before, mixed(hashes)
