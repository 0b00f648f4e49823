"""Line dedup: of lines that are equal or a few edits apart, the first one in the corpus stays.

A line goes if an earlier line (by document id, then place in the text) equals it or lies within ``threshold`` edits
of it, whether or not that earlier line goes itself. Exact copies go from ``equal_chars`` code points on (with 1: every
line that is not blank), near ones from ``min_chars`` on; without ``equal_chars`` both begin at ``min_chars``.

The edit join partitions segments. A line is cut into threshold + 1 segments; two lines within the threshold share a
segment, so each line is indexed under (its length, segment number, segment) and probes the index of equal and
shorter lengths with the substrings that could match, a few for each segment (positions bounded by the edits left on
either side). Keys are hashed and dealt out; keys that hold one line only are dropped there, which leaves the lines
with a possible partner. Their texts are fetched, sorted inside each key by place, and each is compared with earlier
ones of fitting length and letter counts until one is verified by bit-parallel edit distance in a band. So a large
group of alike lines costs few verifications, and no pairs are written. The lines of a key with more than ``dense``
entries are cut into blocks, and each pair of blocks is a key of its own, so no task holds more than two blocks.

Rows that agree in id and text are one document and keep the same lines. Null texts stay null and have no lines; null
ids come first; an empty table gives no rows; other input columns travel in ``record``, so names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewise.llm.membership import may_hold, slots_of
from latewise.llm.work import written

_digest = xxhash.xxh64_intdigest


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(begin, size) of the segments of a line of this length; the longer ones are last."""
    n = threshold + 1
    short, longer = length // n, length % n
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, begin, size) of every substring that a line of this length has to look up.

    Segment i can only match where the edits before it are at most i and those behind it at most threshold - i.
    The line's own segments are not listed.
    """
    out = []
    for other in range(max(0, length - threshold), length + 1):
        more = length - other
        for i, (at, size) in enumerate(segments(other, threshold)):
            low = max(0, at - i, at + more - (threshold - i))
            high = min(length - size, at + i, at + more + (threshold - i))
            out += [(other, i, b, size) for b in range(low, high + 1) if more or b != at]
    return out


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most ``threshold``.

    Bit o of state d says that a[: j + o - threshold] becomes b[:j] with at most d edits: one small integer for each
    d, moved along the diagonal band.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    a, b = _trimmed(a, b)
    if not a or not b:
        return max(len(a), len(b)) <= threshold
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in (a, b))
    width = 2 * threshold + 1
    padded = np.full(len(y) + 2 * threshold + max(0, len(x) - len(y)), 0xFFFFFFFF, dtype=np.uint32)
    padded[threshold : threshold + len(x)] = x
    same = sum((padded[o : o + len(y)] == y).astype(np.int64) << o for o in range(width))
    full = (1 << width) - 1
    states = [((1 << (d + 1)) - 1 << threshold) & full for d in range(threshold + 1)]
    for match in same.tolist():
        before, states[0] = states[0], states[0] & match
        for d in range(1, threshold + 1):
            now = (states[d] & match | before | before >> 1 | states[d - 1] << 1) & full
            before, states[d] = states[d], now
        if not states[threshold]:
            return False
    return bool(states[threshold] >> (len(a) - len(b) + threshold) & 1)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Without the common begin and end."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.endswith(b[len(b) - mid :]) else (low, mid - 1)
    return a[: len(a) - low], b[: len(b) - low]


class _Keys:
    """(key, tag) of every distinct line of a batch; a tag is the line's hash, its lowest bit says index or probe."""

    def __init__(self, threshold: int, min_chars: int) -> None:
        self.threshold, self.min_chars, self.plans = threshold, min_chars, {}

    def _plan(self, n: int) -> list[tuple[int, int, int, int]]:
        if n not in self.plans:
            own = [(i, at, at + size, 1) for i, (at, size) in enumerate(segments(n, self.threshold))]
            self.plans[n] = [(n * (self.threshold + 1) + i, a, b, one) for i, a, b, one in own] + [
                (other * (self.threshold + 1) + i, at, at + size, 0)
                for other, i, at, size in probes(n, self.threshold)
            ]
        return self.plans[n]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, seen = [], [], set()
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < self.min_chars:
                        continue
                    line_hash = _digest(line.encode()) & ~1
                    if line_hash in seen:
                        continue
                    seen.add(line_hash)
                    for seed, a, b, own in self._plan(len(line)):
                        keys.append(_digest(line[a:b].encode(), seed))
                        tags.append(line_hash | own)
                if len(keys) > 1_000_000:
                    yield _longs(key=keys, tag=tags)
                    keys, tags = [], []
            yield _longs(key=keys, tag=tags)


def _longs(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        k: pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for k, v in columns.items()})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key holds an indexed line and a second one."""
    held = None
    for batch in _and_end(batches):
        if batch is not None:
            table = np.stack([batch.column("key").to_numpy(), batch.column("tag").to_numpy()])
            held = table if held is None else np.concatenate([held, table], axis=1)
        if held is None or not held.shape[1]:
            continue
        cut = held.shape[1] if batch is None else int(np.searchsorted(held[0], held[0, -1]))
        done, held = held[:, :cut], held[:, cut:]
        if not cut:
            continue
        key, tag = done
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        line = tag >> 1
        several = np.minimum.reduceat(line, first) != np.maximum.reduceat(line, first)
        indexed = np.maximum.reduceat(tag & 1, first) == 1
        keep = np.repeat(several & indexed, np.diff(np.append(first, len(key))))
        yield pa.RecordBatch.from_pydict({"key": pa.array(key[keep]), "tag": pa.array(tag[keep])})


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _letters(line: str) -> np.ndarray:
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(codes & 31, minlength=32).astype(np.int32)


class _Verify:
    """Rows sorted by (key, place): the lines that have an earlier line within the threshold."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, own = None, [], []
        near: list[str] = []
        for batch in batches:
            for k, line, tag in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "tag"))):
                if k != key:
                    near += self._near(lines, own)
                    key, lines, own = k, [], []
                lines.append(line)
                own.append(tag & 1)
            yield pa.RecordBatch.from_pydict({"line": pa.array(near, pa.string())})
            near = []
        yield pa.RecordBatch.from_pydict({"line": pa.array(self._near(lines, own), pa.string())})

    def _near(self, lines: list[str], own: list[int]) -> list[str]:
        if len(lines) < 2:
            return []
        sizes = np.array([len(x) for x in lines])
        letters, indexed, near = np.stack([_letters(x) for x in lines]), np.array(own, dtype=bool), []
        for i in range(1, len(lines)):
            fits = (np.abs(sizes[:i] - sizes[i]) <= self.threshold) & (indexed[:i] | indexed[i])
            at = np.flatnonzero(fits)
            at = at[np.abs(letters[at] - letters[i]).sum(axis=1) <= 2 * self.threshold]
            if any(lines[j] != lines[i] and within(lines[j], lines[i], self.threshold) for j in at.tolist()):
                near.append(lines[i])
        return near


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _in_blocks(entries: DataFrame, dense: int) -> DataFrame:
    """Entries of crowded keys under a new key for each pair of blocks that holds them; the others as they are."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dense)
    crowded = written(sizes.select("key", F.ceil(F.col("n") / dense).cast("int").alias("blocks")))
    if crowded.isEmpty():
        return entries
    pairs = (
        entries.join(crowded, "key")
        .withColumn("own", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return entries.join(crowded, "key", "left_anti").unionByName(pairs.select(key.alias("key"), "tag", "hash"))


def near_lines(docs: DataFrame, threshold: int, min_chars: int, dense: int = 50_000) -> DataFrame:
    """(line): lines with an earlier, different line within the threshold. ``docs`` has id, content, text."""
    keys = docs.select("text").mapInArrow(_Keys(threshold, min_chars), "key long, tag long")
    shared = written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, tag long"))
    entries = shared.distinct().withColumn("hash", F.shiftright("tag", 1))
    spark = docs.sparkSession
    slots = spark.sparkContext.broadcast(slots_of(entries, "hash"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, lines, hashes = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                for place, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars:
                        rows.append(i)
                        places.append(place)
                        lines.append(line)
                        hashes.append(_digest(line.encode()))
                if len(rows) > 20_000 or i == len(batch) - 1:
                    signed = np.array(hashes, dtype=np.uint64).view(np.int64) >> 1
                    at = np.flatnonzero(may_hold(slots.value, signed))
                    own = pa.array(np.array(rows, dtype=np.int64)[at])
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(c).take(own) for c in ("id", "content")),
                        pa.array(np.array(places, dtype=np.int32)[at]), pa.array(signed[at]),
                        pa.array([lines[k] for k in at.tolist()], pa.string()),
                    ], ["id", "content", "place", "hash", "line"])
                    rows, places, lines, hashes = [], [], [], []

    shape = T.StructType([*docs.select("id", "content").schema.fields, T.StructField("place", T.IntegerType()),
                          T.StructField("hash", T.LongType()), T.StructField("line", T.StringType())])
    texts = written(
        docs.mapInArrow(fetch, shape).groupBy("hash", "line")
        .agg(F.min(F.struct("id", "content", "place")).alias("first"))
    )
    sorted_keys = (
        _in_blocks(entries, dense).join(texts, "hash").select("key", "tag", "first", "line").repartition("key")
        .sortWithinPartitions("key", "first")
    )
    return sorted_keys.select("key", "tag", "line").mapInArrow(_Verify(threshold), "line string").distinct()


def dedup_lines(
    docs: DataFrame, threshold: int = 2, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text",
    dense: int = 50_000, equal_chars: int | None = None,
) -> DataFrame:
    """(record, kept_text, n_lines, n_equal, n_near): every document, and its text without the lines that go."""
    given = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"),
    )
    plain = given.select("id", "content", "text")
    # A blank line parts paragraphs and repeats nothing.
    lines = plain.select("id", "content", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).filter(
        (F.length("line") >= min_chars) if equal_chars is None
        else (F.length("line") >= equal_chars) & F.col("line").rlike(r"[^ \t\n\x0B\f\r]")
    ).select("id", "content", "place", *_hashes(F.col("line")))
    near = near_lines(plain, threshold, min_chars, dense).select(*_hashes(F.col("line")), F.lit(True).alias("near"))
    place = F.struct("id", "content", "place")
    repeated = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.max(place).alias("last")
    ).filter("first != last").drop("last")
    goes = written(repeated.join(near, ["h1", "h2"], "full"))
    dropped = lines.join(goes, ["h1", "h2"]).withColumn(
        "equal", F.col("first").isNotNull() & (F.struct("id", "content", "place") != F.col("first"))
    ).withColumn("near", ~F.col("equal") & F.coalesce("near", F.lit(False))).filter(F.col("equal") | F.col("near"))
    drops = written(dropped.distinct().groupBy("id", "content").agg(
        F.collect_list("place").alias("drops"), F.sum(F.col("equal").cast("long")).alias("n_equal"),
        F.sum(F.col("near").cast("long")).alias("n_near"),
    ))
    # Only documents that may lose a line are moved; the others stay where they are read.
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(drops, "content"))
    marked = given.mapInArrow(_Mark(slots), T.StructType([*given.schema.fields, T.StructField("may", T.BooleanType())]))
    untouched = marked.filter("not may").select(
        "record", F.col("text").alias("kept_text"), _n_lines().alias("n_lines"),
        F.lit(0).cast("long").alias("n_equal"), F.lit(0).cast("long").alias("n_near"),
    )
    right = drops.withColumnsRenamed({"id": "_id", "content": "_content"})
    beside = marked.filter("may").join(
        right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left"
    ).select("record", "text", "drops", _n_lines().alias("n_lines"),
             F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    kept = T.StructType([given.schema["record"], T.StructField("kept_text", T.StringType()), *(
        T.StructField(c, T.LongType()) for c in ("n_lines", "n_equal", "n_near"))])
    return untouched.unionByName(beside.mapInArrow(_without, kept))


def _n_lines() -> Column:
    return F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")


class _Mark:
    def __init__(self, slots) -> None:
        self.slots = slots

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = may_hold(self.slots.value, batch.column("content").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], [*batch.schema.names, "may"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, drops in zip(batch.column("text"), batch.column("drops")):
            text, gone = text.as_py(), set(drops.as_py() or ())
            texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("record"), pa.array(texts, pa.string()), *(batch.column(c) for c in _COUNTS)],
            ["record", "kept_text", *_COUNTS],
        )


_COUNTS = ("n_lines", "n_equal", "n_near")
