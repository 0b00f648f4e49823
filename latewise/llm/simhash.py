"""SimHash near-duplicates: fingerprints of word shingles, linked when few bits differ, and their components.

Fingerprint: A-Z lower-cased, words split at ASCII blanks, shingles of ``width`` words (repeats included, fewer words:
the whole sequence) hashed with XXH64 seed 42; a bit is set if set in more than half of the hashes.

Search: distinct fingerprints are cut into bands. Two that differ in at most ``max_bits`` bits agree on all but
``max_bits`` bands, so each is dealt once for every choice of the remaining bands, by the hash of their bits. The
number of bands follows the number of fingerprints. Where fingerprints share a deal, their Hamming distances to the
reference fingerprints are laid out as a table; a pair is discarded if any coordinate differs by more than
``max_bits`` (triangle inequality), and survivors are verified by their own distance. Deals of more than
``dense`` fingerprints are dealt again on bands of their remaining bits. Of the links a task finds it keeps a
spanning forest, so a large group never becomes all its pairs.

Null texts have no words: fingerprint zero, linked like any other. Null ids take part but never name a component that
holds another id. Repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.llm.components import components
from latewise.llm.work import written

SEED, N_PIVOTS = 42, 16
#: Reference fingerprints, from a fixed generator.
PIVOTS = np.random.default_rng(SEED).integers(0, 2**64, size=N_PIVOTS, dtype=np.uint64)


def fingerprint(text: str, width: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1))
    begins = [0, *(e + 1 for e in ends[:-1])]
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    tails = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, tails)), dtype=np.uint64, count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # a block at a time: unpacked bits take eight times the room
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", width) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(each, f"id {given.schema['id'].dataType.simpleString()}, fp long")


def band_masks(bits: list[int], n_bands: int, agreeing: int) -> list[int]:
    """The masks of every choice of ``agreeing`` out of ``n_bands`` bands of these bits, as signed longs."""
    bands = [sum(1 << b for b in part) for part in np.array_split(np.array(bits, dtype=object), n_bands)]
    masks = [sum(chosen) for chosen in itertools.combinations(bands, agreeing)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _dealt(rows: DataFrame, masks: list[int], base: Column) -> DataFrame:
    keys = [F.xxhash64(base, F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    return rows.select(F.posexplode(F.array(*keys)).alias("choice", "key"), "fp")


def near_links(distinct: DataFrame, max_bits: int = 4, dense: int = 100_000) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all those within ``max_bits``."""
    n = distinct.count()
    bands = next((b for b in range(max_bits + 1, max_bits + 4) if 2 ** (64 * (b - max_bits) // b) >= n), max_bits + 4)
    masks = band_masks(list(range(64)), bands, bands - max_bits)
    dealt = _dealt(distinct, masks, F.lit(0))
    crowded = written(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("key"))
    if not crowded.isEmpty():
        again = dealt.join(crowded, "key", "left_semi")
        parts = [
            _dealt(again.filter(F.col("choice") == i).select("fp", F.col("key").alias("base")),
                   band_masks([b for b in range(64) if not mask >> b & 1], max_bits + 2, 2), F.col("base"))
            for i, mask in enumerate(m % 2**64 for m in masks)
        ]
        dealt = dealt.join(crowded, "key", "left_anti")
        for part in parts:
            dealt = dealt.unionByName(part)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held_key = np.concatenate([held_key, batch.column("key").to_numpy()])
                held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
                if not len(held_key):
                    continue
            # The last deal may go on in the next batch.
            cut = len(held_key) if batch is None else int(np.searchsorted(held_key, held_key[-1]))
            u, v = _links_of(held_key[:cut], held_fp[:cut].view(np.uint64), max_bits)
            held_key, held_fp = held_key[cut:], held_fp[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    # Adaptive execution may join small partitions but never moves rows of one key apart.
    return dealt.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link, "u long, v long")


def _links_of(keys: np.ndarray, fps: np.ndarray, max_bits: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return fps, fps
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    found = []
    few = np.repeat(sizes <= small, sizes)
    for step in range(1, min(small, int(sizes.max()))):
        at = np.flatnonzero((keys[:-step] == keys[step:]) & few[:-step])
        if not len(at):
            break
        at = at[np.abs(table[at] - table[at + step]).max(axis=1) <= max_bits]
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        found.append((fps[at], fps[at + step]))
    for start, size in zip(starts[sizes > small], sizes[sizes > small]):
        found.append(_links_in_crowd(fps[start : start + size], table[start : start + size], max_bits))
    u, v = (np.concatenate(side) for side in zip(*found)) if found else (fps[:0], fps[:0])
    return _forest(u, v)


def _links_in_crowd(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one deal: each fingerprint is compared with those not reached so far."""
    left = np.arange(len(fps))
    us, vs, front = [], [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        survive = np.abs(table[left] - table[at]).max(axis=1) <= max_bits
        near = np.flatnonzero(survive)
        near = near[np.bitwise_count(fps[left[near]] ^ fps[at]) <= max_bits]
        if len(near):
            reached = left[near]
            us.append(np.full(len(reached), fps[at]))
            vs.append(fps[reached])
            front.extend(reached.tolist())
            left = np.delete(left, near)
    if not us:
        return fps[:0], fps[:0]
    return np.concatenate(us), np.concatenate(vs)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = np.zeros(len(u), dtype=bool)
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep[i] = True
    return u[keep], v[keep]


def near_duplicates(
    docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id): each document with the smallest id reachable over links of ``max_bits`` bits."""
    marked = written(fingerprints(docs, width, id_col, text_col))
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")))
    tree = components(near_links(distinct.select("fp"), max_bits))
    rooted = distinct.join(tree.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
