"""A membership filter of fixed size: small enough to send to every task, whatever it was built from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22


def slots_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each of the ``SLOTS`` remainders that occur (512 KB); a full filter lets everything through."""
    seen = hashes.select(F.pmod(F.col(column), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()["slot"]
    bits = np.zeros(SLOTS, dtype=bool)
    bits[seen.to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def may_hold(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % SLOTS
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)



def filter_of(hashes: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A bit for each value of the lowest ``bits`` bits of the hashes: 4 MB by default, built by the executors."""
    slot = hashes.select((F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("s"))  # buckets are counted from 1
    maps = slot.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")
    )
    packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        packed[at : at + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return packed


def held(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash may be among those of ``filter_of``."""
    slot = hashes & np.uint64(8 * len(packed) - 1)
    return (packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def passing(packed: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Whether each signed hash may be in the filter; a null is not."""
    inside = held(packed, hashes.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    return inside & hashes.is_valid().to_numpy(zero_copy_only=False)


def passes(df: DataFrame, column: str, *filters: np.ndarray) -> Column:
    """Whether a row's hash may be in all of the filters of ``filter_of``; a null hash is in none. Only hashes go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("boolean")
    def both(hashes: pa.Array) -> pa.Array:
        return pa.array(np.logical_and.reduce([passing(packed, hashes) for packed in shared.value]))

    return both(F.col(column))
