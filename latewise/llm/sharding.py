"""Sharding: a two-pass external shuffle into shards decided by key and shard count alone.

A key goes to the shard with the greatest seeded hash of (key, shard), so one more shard takes rows only into itself.
Pass one counts rows and bytes in fine hash cells and groups cells into buckets that fit in memory; pass two scatters
the records into those buckets, shuffles each bucket (Fisher-Yates, seeded by bucket) and writes it. Slots are the
bucket's offset in its shard plus the place in the bucket. The order depends on seed and content only, not on
partitions or arrival.

Null keys share one shard; their rows spread over its buckets by content. Rows equal in every column share a bucket
and are interchangeable. An empty table gives no rows. Input columns travel in the struct ``record``, so their names
never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewise.llm.work import written

CELLS = 65_536


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard with the greatest hash of (key, shard)."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("draw"), F.lit(i).alias("shard"))
             for i in range(n_shards)]
    return F.array_max(F.array(*draws)).shard


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffle_into_shards(
    rows: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 7,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """(record, shard, slot): every row with its shard 0..n-1 and gapless slot, buckets written and read back."""
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if not _holds_map(f.dataType)]
    scattered = rows.select(
        F.struct("*").alias("record"),
        rendezvous(F.col(key), n_shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed), *hashed).alias("content"),
    )
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), "content"), F.lit(CELLS))
    cells = written(
        scattered.groupBy("shard", cell.alias("cell"))
        .agg(F.count("*").alias("n"), F.sum(record_bytes(F.col(f"record.{text}"))).alias("bytes"))
    )
    total = cells.agg(F.sum("bytes")).first()[0] or 0
    per_shard = min(CELLS, max(1, math.ceil(total / n_shards / bucket_bytes)))

    def bucket(at: Column) -> Column:
        return F.floor(at * per_shard / CELLS).cast("int")

    # One row for each bucket; a shard has at most CELLS of them.
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("shard", bucket(F.col("cell")).alias("bucket")).agg(F.sum("n").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    )
    shape = T.StructType([
        T.StructField("record", scattered.schema["record"].dataType), T.StructField("shard", T.IntegerType()),
        T.StructField("slot", T.LongType()),
    ])

    def permuted(key: tuple, records: pa.Table, first: pa.Table) -> pa.Table:
        shard, at = (k.as_py() for k in key)
        # Arrival order depends on the run, so records start in the order of their content.
        start = np.argsort(records["content"].to_numpy(), kind="stable")
        order = start[np.random.default_rng([seed, shard, at]).permutation(len(start))]  # Fisher-Yates
        slots = first["first"][0].as_py() + np.arange(len(order), dtype=np.int64)
        return pa.table({
            "record": records["record"].combine_chunks().take(pa.array(order)),
            "shard": pa.array(np.full(len(order), shard, dtype=np.int32)), "slot": pa.array(slots),
        })

    buckets = scattered.withColumn("bucket", bucket(cell))
    shuffled = (
        buckets.groupBy("shard", "bucket").cogroup(offsets.groupBy("shard", "bucket")).applyInArrow(permuted, shape)
    )
    return written(shuffled)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))
