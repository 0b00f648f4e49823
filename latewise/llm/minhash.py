"""MinHash near-duplicates: min-max signatures of word shingles, banded, links confirmed on full sets, components.

Set of a document: A-Z lower-cased, words split at ASCII blanks, distinct shingles of ``width`` words (fewer words: the
whole sequence as one; no words: empty). A shingle is the 64-bit combination of its words' XXH64; two different ones of
one pair of documents fall together about once in 2**64 / (words of both)**2 pairs.

Signature: under each of ``N_HASHES`` permutations of the hashes both the least and the greatest value are kept, so one
evaluation gives two values that agree with the probability of the Jaccard similarity. A band is ``ROWS`` least values,
or the greatest values of the same permutations. That both agree is a little less likely than for independent values,
so bands of greatest values catch what the bands of least values miss. At similarity 0.85 the 32 bands miss a pair
with probability (1 - 0.85**5)**32 = 7e-9; other values agree in proportion to similarity and only cost time.

Links: documents with equal sets are one node. The nodes of a bucket (a band's value) are first compared with one of
them, the first in an order that is the same for all buckets; nodes linked to one node count as one part. Buckets that
still hold several parts are compared whole, in groups of bounded size: a crowded bucket is dealt again by each of its nodes' other bands, and
what stays crowded goes by pairs of blocks. Only links between parts are looked for, and of those a spanning forest is
kept, so no group becomes all its pairs and none is cut.

Null texts and texts without words have the empty set, are linked with nothing and form components of their own. Null
ids take part but never name a component that holds another id; an empty text without id has component null. Repeated
rows get equal results (equal ids of empty texts too); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.llm.components import components
from latewise.llm.membership import filter_of, held
from latewise.llm.work import written

SEED, N_HASHES, ROWS = 42, 80, 5
#: Odd factors and offsets of the permutations x -> a * x + b of 64-bit numbers, from a fixed generator.
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, size=(2, N_HASHES), dtype=np.uint64)
FACTORS, OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
#: Factors of the words of a shingle by place.
PLACES = np.random.default_rng(SEED + 1).integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_sets(texts: list[str | None], width: int, known: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    sets = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, the six ASCII blanks
        sets.append(_shingles(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)), width))
    return sets


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    span = min(width, len(words))
    n = len(words) - span + 1
    total = np.full(n, span, dtype=np.uint64)  # a short sequence never equals a full shingle
    for i in range(span):
        total += words[i : i + n] * PLACES[i]
    return np.unique(_mixed(total))


def digest(grams: np.ndarray) -> bytes:
    """The name of a set: 16 bytes over its sorted members."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """Two signed longs for each group of ``ROWS`` permutations and set: of the least and of the greatest values."""
    out = np.zeros((len(sets), 2 * N_HASHES // ROWS), dtype=np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for band in range(N_HASHES // ROWS):
        low = np.full(len(full), 2 * band, dtype=np.uint64)
        high = np.full(len(full), 2 * band + 1, dtype=np.uint64)
        for p in range(band * ROWS, (band + 1) * ROWS):
            values = x * FACTORS[p] + OFFSETS[p]
            low = _mixed(low + np.minimum.reduceat(values, starts))
            high = _mixed(high + np.maximum.reduceat(values, starts))
        out[full, 2 * band], out[full, 2 * band + 1] = low.view(np.int64), high.view(np.int64)
    return out


def _pieces(column: pa.Array, size: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts of a column, a few at a time."""
    held, n = [], 0
    for text in column:
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands): size and name of every document's set, and its bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            at = 0
            for texts in _pieces(batch.column("text")):
                sets = shingle_sets(texts, width, known)
                bands = band_values(sets)
                ends = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands.ravel())),
                ], ["id", "n", "digest", "bands"])
                at += len(texts)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(each, f"id {kind}, n long, digest binary, bands array<bigint>")


def _sets_of(docs: DataFrame, digests: DataFrame, width: int, text_col: str) -> DataFrame:
    """(digest, grams): the full sets of these names, hashed from the texts again."""
    hashed = digests.select(F.xxhash64("digest").alias("h"))
    allowed = docs.sparkSession.sparkContext.broadcast(filter_of(hashed, "h"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), allowed.value
        for batch in batches:
            for texts in _pieces(batch.column("text")):
                found = {digest(s): s for s in shingle_sets(texts, width, known) if len(s)}
                wanted = held(bits, np.array([xxhash.xxh64_intdigest(name, SEED) for name in found], dtype=np.uint64))
                found = {name: s for (name, s), may in zip(found.items(), wanted) if may}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array([s.tobytes() for s in found.values()], pa.binary())],
                    ["digest", "grams"],
                )

    given = docs.select(F.col(text_col).alias("text")).mapInArrow(each, "digest binary, grams binary")
    return written(given.groupBy("digest").agg(F.first("grams").alias("grams")).join(digests, "digest", "left_semi"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough.

    ``v`` may be one node for very many ``u``: pairs are salted by ``u``, and the set of ``v`` is dealt to the salts
    that occur.
    """
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(64)).cast("int").alias("salt"))
    right = pairs.select("v", "salt").distinct().join(sets.select(F.col("digest").alias("v"), F.col("grams").alias("b")), "v")
    both = pairs.join(sets.select(F.col("digest").alias("u"), F.col("grams").alias("a")), "u").join(right, ["v", "salt"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column("a"), batch.column("b"))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(check, "u binary, v binary")


def _similar(x: pa.Buffer, y: pa.Buffer, percent: int) -> bool:
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _common(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many members every two sets share, by products of 0/1 matrices of ``step`` columns."""
    n = len(sets)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    several = times[column] > 1
    row, column = row[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        part = slice(*np.searchsorted(column, [at, at + step]))
        cells = np.zeros((n, step), dtype=np.float32)
        cells[row[part], column[part] - at] = 1
        shared += cells @ cells.T
    return shared.astype(np.int64)


def links_between(labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar enough and which connect all parts (labels) that any such pair connects."""
    _, part = np.unique(np.array([label.hex() for label in labels]), return_inverse=True)
    if not len(part) or part.max() == 0:
        return []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = _common(sets)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    near &= part[:, None] < part[None, :]
    parent = list(range(int(part.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in zip(*(side.tolist() for side in np.nonzero(near))):
        a, b = root(int(part[i])), root(int(part[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the parts of each group (key, digest, label), whose sizes are bounded by the caller."""

    def compare(rows: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("grams")]
        names = rows.column("digest").to_pylist()
        found = links_between(rows.column("label").to_pylist(), grams, percent)
        return pa.table({
            "u": pa.array([names[i] for i, _ in found], pa.binary()), "v": pa.array([names[j] for _, j in found], pa.binary()),
        })

    held = groups.select("key", "digest", "label").join(sets, "digest")
    return held.groupBy("key").applyInArrow(compare, "u binary, v binary")


def _first_parts(members: DataFrame, links: DataFrame, order: Callable[[str], Column]) -> DataFrame:
    """Members with a part as label: the first of those that a node is linked to, or what that one is linked to."""
    first = written(links.groupBy(F.col("u").alias("digest")).agg(F.min_by("v", order("v")).alias("lead")))
    beyond = first.select(F.col("digest").alias("lead"), F.col("lead").alias("next"))
    parts = first.join(beyond, "lead", "left").select("digest", F.coalesce("next", "lead").alias("part"))
    found = members.drop("label").join(parts, "digest", "left")
    return written(found.withColumn("label", F.coalesce("part", "digest")).drop("part"))


def _open(members: DataFrame, least: int) -> DataFrame:
    """(key, weight, n_nodes) of the buckets of ``least`` nodes or more that hold several parts, one of those with the same nodes."""
    per_key = members.groupBy("key").agg(
        F.count("*").alias("n_nodes"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("digest")).alias("x"),
        F.min(F.xxhash64("label")).alias("low"), F.max(F.xxhash64("label")).alias("high"),
    )
    several = per_key.filter((F.col("low") < F.col("high")) & (F.col("n_nodes") >= least))
    return several.groupBy("n_nodes", "weight", "x").agg(F.min("key").alias("key"))


def near_links(
    docs: DataFrame, nodes: DataFrame, width: int, percent: int, text_col: str = "text", max_weight: int = 4_000_000,
    max_nodes: int = 4_096,
) -> DataFrame:
    """(u, v): links between distinct sets (digest, n, bands) that connect all those that are similar enough.

    ``max_weight`` (shingles) and ``max_nodes`` bound the groups that a task compares whole.
    """
    dealt = nodes.select("digest", "n", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = written(dealt.join(shared, "key").withColumn("label", F.col("digest")))
    sets = _sets_of(docs, members.select("digest").distinct(), width, text_col)

    def order(name: str) -> Column:
        return F.xxhash64(F.lit(SEED), name)

    leads = members.groupBy("key").agg(F.min_by("digest", order("digest")).alias("v"))
    pairs = members.join(leads, "key").filter(F.col("digest") != F.col("v")).select(F.col("digest").alias("u"), "v").distinct()
    links = written(_confirmed(pairs, sets, percent))
    members = _first_parts(members, links, order)

    still = written(_open(members, 3))  # the nodes of a bucket of two have been compared
    members = members.join(still, "key")
    fits = (F.col("weight") <= max_weight) & (F.col("n_nodes") <= max_nodes)
    groups = members.filter(fits).select("key", "digest", "label")
    if not still.filter(~fits).isEmpty():
        # Two similar sets agree on many bands: crowded buckets are dealt again by each of the other bands.
        crowd = members.filter(~fits).select("key", "digest", "label", "n").join(nodes.select("digest", "bands"), "digest")
        other = F.array_except("bands", F.array("key"))
        crowd = crowd.select("digest", "label", "n", "key", F.explode(other).alias("band"))
        again = written(crowd.select("digest", "label", "n", F.xxhash64("key", "band").alias("key")))
        still = written(_open(again, 2))
        again = again.join(still, "key")
        groups = groups.unionByName(again.filter(fits).select("key", "digest", "label"))
        # What stays crowded goes by pairs of blocks.
        blocks = F.ceil(F.greatest(2 * F.col("weight") / max_weight, 2 * F.col("n_nodes") / max_nodes)).cast("int")
        mine = F.pmod(F.xxhash64("digest"), F.col("b")).cast("int")
        split = again.filter(~fits).withColumn("b", blocks).withColumn("i", mine)
        split = split.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        split = split.select("digest", "label", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
        groups = groups.unionByName(split.select("key", "digest", "label"))
    return links.unionByName(written(_compared(groups, sets, percent)))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", **bounds: int
) -> DataFrame:
    """(id, n_shingles, component_id): each document with the smallest id reachable over similar sets."""
    marked = written(signatures(docs, width, id_col, text_col))
    nodes = written(
        marked.filter("n > 0").groupBy("digest").agg(
            F.min("id").alias("least"), F.count("*").alias("n_rows"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    tree = components(near_links(docs, nodes.select("digest", "n", "bands"), width, percent, text_col, **bounds))
    rooted = nodes.select("digest", "least", "n_rows").join(
        tree.select(F.col("u").alias("digest"), F.col("v").alias("root")), "digest", "left"
    ).withColumn("root", F.coalesce("root", "digest"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("digest", "n_rows", "component_id"))
    some, total = marked.filter("n > 0").select("id", "n", "digest"), marked.count()
    # Fewer than a thousand sets can hold more than a thousandth of all rows each.
    common = F.broadcast(named.filter(F.col("n_rows") * 1000 > total).drop("n_rows"))
    rest = some.join(common.select("digest"), "digest", "left_anti").join(named.drop("n_rows"), "digest")
    alone = marked.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = some.join(common, "digest").unionByName(rest).select("id", "n", "component_id").unionByName(alone)
    return out.withColumnRenamed("n", "n_shingles")
