"""Bloom filters of bounded size, built by tasks and tested with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest filter: 2**26 bits are 8 MB, small enough to ship to every task.
MAX_LOG2 = 26
PROBES = 4


def log2_bits(keys: int, per_key: int = 16, most: int = MAX_LOG2) -> int:
    return min(most, max(10, (max(keys, 1) * per_key - 1).bit_length()))


def positions(hashes: np.ndarray, log2: int) -> list[np.ndarray]:
    """Bit positions of 64-bit hashes: double hashing of their mixed halves."""
    x = hashes.astype(np.int64).view(np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    step = (x >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log2) - 1)
    return [((x + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PROBES)]


def build(hashes: DataFrame, log2: int) -> np.ndarray:
    """The filter of the long column ``h``.

    Tasks or their bits into words, words are or-ed with map-side combining,
    and the driver gets one row for each word of the filter at most.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(np.concatenate(positions(batch.column("h").to_numpy(), log2)))
                word, first = np.unique(at >> 5, return_index=True)
                bits = np.bitwise_or.reduceat(np.int64(1) << (at & 31), first)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bits, pa.int64())], names=["w", "b"])

    got = hashes.select("h").mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (log2 - 5), dtype=np.uint32)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return bits


def test(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; never false for one that is."""
    found = np.ones(len(hashes), dtype=bool)
    for p in positions(hashes, len(bits).bit_length() + 4):
        found &= (bits[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
    return found
