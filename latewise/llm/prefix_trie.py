"""Prefix trie of conversations: distinct prefixes in minimal-perfect-hash node tables, subtree sums over flat arrays.

A node of depth d is a distinct sequence of d turns; the root is empty. Its members are the conversations that start
with it. A prefix is named by a digest of 128 bits: the exclusive or of the hashes of (place, turn), so digests of one
conversation come from a running aggregate that is cut into stretches, however long the conversation.

Nodes with more members than ``crowd`` are few (no more than ``MAX_TOP``). Every conversation leaves them at one node,
the cut; all prefixes from the cut on go to the shard of the cut, so a subtree below the crowd is whole in one shard. A
shard gives its distinct digests the slots of a minimal perfect hash, checks every occurrence against the digest, parent
and turn that its slot holds (two prefixes with one digest raise an error), scatters the counts into flat arrays, and
adds from the deepest nodes up through the parents' slots. Totals of the cuts then go, as additions to the crowd's
nodes, through the same table once more.

Turns are ranked by a sort over ranges, not by a window over a conversation; the ids that end at a node are joined in
stretches before they are hashed. So neither a third of all turns in one conversation nor a third of all conversations
at one node meet in a task.

Turns are ordered by turn (null first), role, text; null role or text is empty. Rows without conversation id belong to no
conversation and are left out; repeated rows are turns of their own; an empty table has no nodes, not even a root. Other
columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewise.llm.work import written

STRETCH, SALTS, MAX_TOP = 1_024, 16, 65_536


def numbered(convs: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """(conv_id, place, a, b, chars): turns in order from 1, named by two hashes of role and text.

    ``convs`` has conv_id, turn, role, text.
    """
    given = convs.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    sorted_ = given.repartitionByRange(1 + given.count() // rows_per_part, *order).sortWithinPartitions(*order)
    slim = sorted_.select(
        F.spark_partition_id().alias("part"), "conv_id", F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            opens = np.append(True, ids[1:] != ids[:-1])
            at = np.arange(len(ids))
            local = at - np.maximum.accumulate(np.where(opens, at, 0)) + 1
            if ids[0] == last:
                first = int(opens[1:].argmax()) + 1 if opens[1:].any() else len(ids)
                local[:first] += n
            last, n = ids[-1], int(local[-1])
            yield batch.append_column("local", pa.array(local))

    kind = slim.schema["conv_id"].dataType.simpleString()
    placed = written(slim.mapInArrow(place, f"part int, conv_id {kind}, a long, b long, chars long, local long"))
    per_part = placed.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a part can have begun before it.
    begun = F.broadcast(per_part.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before"))
    found = placed.join(begun, ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "a", "b", "chars")


def salt_of(place: Column) -> Column:
    """Turns of a long conversation are spread over salts by stretches; those of a short one have salt 0."""
    return F.pmod(F.floor((place - 1) / STRETCH), F.lit(SALTS)).cast("int")


def salts_of(n: Column) -> Column:
    """All salts that occur among ``n`` turns."""
    return F.sequence(F.lit(0), F.least(F.floor(F.greatest(n - 1, F.lit(0)) / STRETCH), F.lit(SALTS - 1)).cast("int"))


def grafted(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation c begins with the first h turns of c - c % block; its own follow after its first h.

    h is the CRC-32 of the decimal id modulo ``most``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % block
    planned = sizes.withColumns({"h": h, "base": base})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    planned = planned.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    planned = written(planned.drop("n_base"))
    heads = turns.filter((F.col("place") < most) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    first = planned.select("conv_id", "base", "taken").join(heads, "base").filter("place <= taken").drop("base", "taken")
    plan = planned.select("conv_id", "h", "taken", F.explode(salts_of(F.col("n_own"))).alias("salt"))
    own = turns.withColumn("salt", salt_of(F.col("place"))).join(plan, ["conv_id", "salt"]).filter("place > h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken")).select(*first.columns)
    return planned.select("conv_id"), first.unionByName(own)


class NodeTable:
    """A minimal perfect hash of distinct pairs of longs: slots 0 to n - 1, each checked against the key it holds.

    Level by level, keys that fall alone on a bit of an array of 1.5 bits a key get the rank of that bit; the others go
    to the next level.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.high, self.low = np.zeros(len(high), dtype=np.int64), np.zeros(len(high), dtype=np.int64)
        left, given = np.arange(len(high)), 0
        while len(left):
            size = 8 + len(left) * 3 // 2
            at = self._place(high[left], low[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = given + np.cumsum(alone) - 1
            mine = alone[at]
            self.high[rank[at[mine]]], self.low[rank[at[mine]]] = high[left[mine]], low[left[mine]]
            self.levels.append((alone, rank))
            left, given = left[~mine], given + int(alone.sum())

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = high.view(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15) ^ low.view(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of keys that are not in the table."""
        slot, open_ = np.full(len(high), -1), np.arange(len(high))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(high[open_], low[open_], level, len(alone))
            hit = alone[at]
            found = rank[at[hit]]
            same = (self.high[found] == high[open_[hit]]) & (self.low[found] == low[open_[hit]])
            slot[open_[hit][same]] = found[same]
            open_ = open_[~hit]
        return slot


_NODE = (
    "d1 long, d2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long"
)


def _nodes_of(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of a shard from occurrences of prefixes.

    An occurrence stands for ``n`` conversations, of which ``conv`` is the least, and brings what lies below it in other
    shards: ``children``, ``leaves`` and ``saved``.
    """
    keys = np.unique(np.stack([rows["d1"], rows["d2"]]), axis=1)
    table = NodeTable(keys[0], keys[1])
    n, slot = keys.shape[1], table.slots(rows["d1"], rows["d2"])
    some = np.zeros(n, dtype=np.int64)
    some[slot] = np.arange(len(slot))
    for name in ("p1", "p2", "a", "b", "depth", "chars"):
        if (rows[name] != rows[name][some][slot]).any():
            raise ValueError("two different prefixes have one digest")
    p1, p2, depth = (rows[name][some] for name in ("p1", "p2", "depth"))
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, rows["conv"])
    n_convs, children, leaves, below = (np.zeros(n, dtype=np.int64) for _ in range(4))
    for total, name in ((n_convs, "n"), (children, "children"), (leaves, "leaves"), (below, "saved")):
        np.add.at(total, slot, rows[name])
    saved = below + (n_convs - 1) * rows["chars"][some]
    parent = np.where(depth > 0, table.slots(p1, p2), -1)
    np.add.at(children, parent[parent >= 0], 1)
    leaves += children == 0
    order = np.argsort(depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for level in reversed(np.split(order, ends)):
        up = level[parent[level] >= 0]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    above = pa.array(first[np.maximum(parent, 0)], mask=parent < 0)
    columns = [table.high, table.low, p1, p2, depth, first, above, n_convs, children, leaves, saved]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _NODE.replace(" long", "").split(", "))


def _shards(occurrences: DataFrame) -> DataFrame:
    """One node table for each partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if sum(map(len, parts)):
            table = pa.Table.from_batches(parts)
            yield _nodes_of({name: table.column(name).to_numpy() for name in table.column_names})

    return occurrences.mapInArrow(build, _NODE)


def _occurrences(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, chars, d1, d2, p1, p2): each turn as the last of a prefix, with the prefix and the one before."""
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("place").alias("depth"), "a", "b", "chars",
        F.xxhash64("place", "a", "b").alias("h1"), F.xxhash64(F.lit("second"), "b", "a", "place").alias("h2"),
        F.floor((F.col("place") - 1) / STRETCH).alias("stretch"),
    )
    per_stretch = rows.groupBy("conv", "stretch").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = per_stretch.select(
        "conv", "stretch", F.bit_xor("x1").over(earlier).alias("y1"), F.bit_xor("x2").over(earlier).alias("y2")
    ).filter("stretch > 0")
    running = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(begun, ["conv", "stretch"], "left").withColumns({
        f"d{i}": F.bit_xor(f"h{i}").over(running).bitwiseXOR(F.coalesce(f"y{i}", F.lit(0))) for i in (1, 2)
    })
    return rows.select(
        "conv", "depth", "a", "b", "chars", "d1", "d2", F.col("d1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("d2").bitwiseXOR(F.col("h2")).alias("p2"),
    )


def _ends(convs: DataFrame, occurrences: DataFrame, per_part: int) -> DataFrame:
    """(d1, d2, ends_sha256): the ids of the conversations that end at each node, ascending, joined and hashed."""
    # All turns of a conversation together give the digest of its last prefix.
    own = occurrences.select("conv", F.col("d1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("d2").bitwiseXOR(F.col("p2")).alias("h2"))
    last = own.groupBy(F.col("conv").alias("conv_id")).agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"))
    ends = convs.join(last, "conv_id", "left").select(
        F.coalesce("d1", F.lit(0)).alias("d1"), F.coalesce("d2", F.lit(0)).alias("d2"), "conv_id"
    )
    order = ["d1", "d2", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, ids = (batch.column(name).to_numpy() for name in order)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (d1, d2, ids)] + [pa.array(texts)], [*order, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]]), pa.array([node[1]]), pa.array([sha.hexdigest()])], ["d1", "d2", "ends_sha256"]
            )

        for batch in batches:
            for d1, d2, ids in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), batch.column("ids")):
                if (d1, d2) == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, sha = (d1, d2), hashlib.sha256()
                sha.update(ids.as_buffer())
        if node is not None:
            yield row()

    dealt = ends.repartitionByRange(1 + convs.count() // per_part, *order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(join, "d1 long, d2 long, conv_id long, ids string")
    together = joined.repartition("d1", "d2").sortWithinPartitions(*order)
    return together.select("d1", "d2", "ids").mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, crowd: int = 256, rows_per_shard: int = 200_000) -> DataFrame:
    """All nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: distinct conv_id, also those without turns; ``turns``: conv_id, place (from 1), a, b (hashes of the
    turn), chars.
    """
    convs = convs.select(F.col("conv_id").cast("long").alias("conv_id"))
    turns = turns.withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = written(_occurrences(turns))
    n_rows = rows.count()
    key, none = ["d1", "d2"], [F.lit(0).cast("long").alias(name) for name in ("children", "leaves", "saved")]
    # At most MAX_TOP nodes can have more than a MAX_TOP-th of all prefixes as members.
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    top = written(sizes.filter(F.col("n") > max(crowd, n_rows // MAX_TOP)).select(*key))
    inner = F.broadcast(top.withColumn("inner", F.lit(True)))
    flagged = rows.join(inner, key, "left")
    outer = top.select(F.col("d1").alias("p1"), F.col("d2").alias("p2")).unionByName(
        top.sparkSession.range(1).select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    )
    below = flagged.filter(F.col("inner").isNull()).drop("inner")
    cuts = below.join(F.broadcast(outer), ["p1", "p2"], "left_semi")
    lengths = rows.groupBy("conv").agg(F.max("depth").alias("m"))
    cuts = cuts.select("conv", F.col("d1").alias("c1"), F.col("d2").alias("c2")).join(lengths, "conv")
    cuts = cuts.select("conv", "c1", "c2", F.explode(salts_of(F.col("m"))).alias("salt"))
    below = below.withColumn("salt", salt_of(F.col("depth"))).join(cuts, ["conv", "salt"])
    names = ["d1", "d2", "p1", "p2", "a", "b", "depth", "chars", "conv"]
    dealt = below.repartition(1 + n_rows // rows_per_shard, "c1", "c2")
    deep = written(_shards(dealt.select(*names, F.lit(1).cast("long").alias("n"), *none)))

    totals = deep.join(F.broadcast(outer), ["p1", "p2"], "left_semi").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    tops = flagged.filter("inner").groupBy(*[n for n in names if n != "conv"]).agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    zero = {name: F.lit(0).cast("long") for name in names if name != "conv"}
    root = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).filter("n > 0").withColumns(zero)
    tops = tops.unionByName(root).join(totals, key, "left").fillna(0, ["children", "leaves", "saved"])
    high = written(_shards(tops.select(*names, "n", "children", "leaves", "saved").repartition(1)))

    above = high.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("above"))
    deep = deep.join(F.broadcast(above), ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    nodes = deep.drop("above").unionByName(high).join(_ends(convs, rows, rows_per_shard), key, "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
