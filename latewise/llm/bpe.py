"""Byte-level BPE: whole texts to token ids and back.

A text is cut into chunks that overlap. Chunks are pre-tokenised apart from each other; a chunk's first boundaries can
be wrong, as it may begin inside a pre-token, but from the first boundary it shares with the chunk before it both
agree. Texts are cut at those boundaries and the pieces encoded on their own. Where an overlap holds no shared
boundary (one pre-token runs through it), the two chunks are joined again and encoded as one piece. A text of one
chunk needs no stitching and stays in its task; longer ones are dealt out chunk by chunk.

A cut is made only after a character that is not white space: the pattern looks one character ahead there. The last
characters of a chunk give no boundary, as they could begin a contraction that goes on behind it.

The vocabulary file is read on the driver and sent to the tasks; its size is checked against ``MAX_VOCABULARY``.

Null texts are empty and have no tokens; repeated rows each get their ids, an empty table gives no rows, other
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_VOCABULARY, MAX_CACHED, MARGIN = 1_000_000, 300_000, 4


def read_ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} are sent to the tasks")
    return ranks


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) as one number to the id of the merged token."""
    return {
        ranks[t[:i]] << 32 | ranks[t[i:]]: r
        for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    }


def merge(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token: the leftmost pair of lowest rank is merged until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    find, none = pairs.get, 1 << 32
    merged = [find(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
    while merged and (best := min(merged)) != none:
        i = merged.index(best)
        parts[i] = best
        del parts[i + 1], merged[i]
        if i:
            merged[i - 1] = find(parts[i - 1] << 32 | best, none)
        if i < len(merged):
            merged[i] = find(best << 32 | parts[i + 1], none)
    return parts


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list: n log n for a run of any length."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = parts[i] + parts[after[i]]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, pair))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue  # one side has been merged meanwhile
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes in a task; pre-tokens seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pairs, self.find = ranks, pair_table(ranks), regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}.__getitem__
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, pieces = self.known, self.find(text)
        for p in set(pieces).difference(known):
            known[p] = np.array(merge(p.encode(), self.ranks, self.pairs), dtype=np.int32).tobytes()
        ids = np.frombuffer(b"".join([known[p] for p in pieces]), dtype=np.int32)
        if len(known) > MAX_CACHED:
            known.clear()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small batches, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32()))


def boundaries(chunk: str, start: int, low: int, high: int, find: regex.Pattern) -> list[int]:
    """Where pre-tokens begin in [low, high), after a character that is not white space; positions of the text."""
    at = [m.start() for m in find.finditer(chunk)]
    return [start + i for i in at if low <= start + i < high and i and not chunk[i - 1].isspace()]


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk: int = 32_768, overlap: int = 1_024) -> None:
        if not MARGIN < overlap < chunk:
            raise ValueError(f"the overlap must lie between {MARGIN} and the chunk length")
        self.ranks, self.pattern, self.chunk, self.overlap = ranks, pattern, chunk, overlap

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, ids) of every row."""
        short, long = self._by_length(docs, id_col, text_col)
        return self._encoded(short, ["id"]).unionByName(self._encode_long(long))

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, ids, decoded) of every row; texts of one chunk are encoded and their ids decoded by the same worker."""
        short, long = self._by_length(docs, id_col, text_col)
        return self._encoded(short, ["id"], decode=True).unionByName(self.decode(self._encode_long(long)))

    def _by_length(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        """Texts of one chunk (id, text) and longer ones (id, text, row)."""
        size = self.chunk + self.overlap
        given = docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        )
        return given.filter(F.length("text") <= size).select("id", "text"), given.filter(F.length("text") > size)

    def _encoded(self, rows: DataFrame, keys: list[str], decode: bool = False) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.ranks)
        pattern = self.pattern

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if pattern not in _ENCODERS:  # the merge table is kept for the next tasks of this worker
                _ENCODERS.clear()
                _ENCODERS[pattern] = Encoder(shared.value, pattern)
            encoder = _ENCODERS[pattern]
            if encoder.ranks != shared.value:
                encoder = _ENCODERS[pattern] = Encoder(shared.value, pattern)
            for batch in _slices(batches):
                ids = [encoder(t) for t in batch.column("text").to_pylist()]
                cells, names = [*(batch.column(k) for k in keys), _lists(ids)], [*keys, "ids"]
                if decode:
                    cells.append(pa.array([b"".join(map(encoder.token, i.tolist())) for i in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cells, names)
            encoder.known.clear()  # the worker lives on for other operators' tasks

        shape = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
        return rows.select(*keys, "text").mapInArrow(encode, f"{shape}ids array<int>" + ", decoded binary" * decode)

    def _encode_long(self, docs: DataFrame) -> DataFrame:
        step, overlap, pattern = self.chunk, self.overlap, self.pattern
        id_type = docs.schema["id"].dataType.simpleString()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    bodies = [text[at : at + step + overlap] for at in range(0, max(1, len(text) - overlap), step)]
                    k = np.arange(len(bodies), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([
                        *(pa.concat_arrays([batch.column(c).slice(i, 1)] * len(k)) for c in ("id", "row")),
                        pa.array(k), pa.array(bodies, type=pa.string()),
                    ], ["id", "row", "k", "body"])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = regex.compile(pattern)
            for batch in batches:
                heads, tails = [], []
                for k, body in zip(batch.column("k").to_pylist(), batch.column("body")):
                    body = body.as_py()
                    start, end = k * step, k * step + len(body)
                    heads.append(boundaries(body, start, start, start + overlap - MARGIN, find))
                    tails.append(boundaries(body, start, start + step, end - MARGIN, find))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "row", "k", "body")),
                     *(pa.array(x, type=pa.list_(pa.int64())) for x in (heads, tails))],
                    ["id", "row", "k", "body", "head", "tail"],
                )

        chunks = docs.mapInArrow(cut, f"id {id_type}, row long, k int, body string").repartition("row", "k")
        marked = chunks.mapInArrow(mark, f"id {id_type}, row long, k int, body string, head array<long>, tail array<long>")
        order = Window.partitionBy("row").orderBy("k")
        start = F.col("k").cast("long") * step
        shared = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
        placed = marked.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(shared))
        placed = placed.withColumns({
            "begin": F.coalesce("cut", start + overlap),
            "piece": F.max(F.when(F.col("cut").isNotNull(), F.col("k"))).over(order),
        })
        placed = placed.withColumn("end", F.coalesce(F.lead("begin").over(order), start + F.length("body")))
        part = F.substr(
            F.col("body"), (F.col("begin") - start + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")
        )
        pieces = placed.groupBy("row", "piece").agg(
            F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", part.alias("part")))).alias("parts")
        ).withColumn("text", F.array_join(F.transform("parts", lambda p: p.part), ""))
        encoded = self._encoded(pieces, ["id", "row", "piece"])
        return encoded.groupBy("row").agg(
            F.first("id").alias("id"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda p: p.ids)).alias("ids"),
        ).select("id", "ids")

    def decode(self, tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
        """The input columns and the raw bytes of the ids; null ids give no bytes."""
        shared = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in self.ranks.items()})
        names = [f.name for f in tokens.schema.fields]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            token = shared.value.__getitem__
            for batch in _slices(batches):
                ids = batch.column(names.index(ids_col)).fill_null([])
                flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(ids).to_pylist()])
                texts = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.binary())], [*names, "decoded"])

        shape = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
        return tokens.mapInArrow(decode, shape)
