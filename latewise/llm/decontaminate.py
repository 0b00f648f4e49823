"""Benchmark decontamination: an FM-index over the words of each training shard, searched for benchmark passages.

Words: A-Z lower-cased, runs of ASCII letters, digits and anything beyond ASCII. A window is ``width`` consecutive
words of an item; an item of fewer words, but not none, is one window. A task gathers documents into shards of about
``shard_words`` words, indexes each, finds the row range of every window by backward search, locates the occurrences
and merges them into removal spans.

The index's symbols are the words of the windows; any other word is an end mark, as no window can reach over it.
Stretches between marks are cut into overlapping parts of bounded length, so sorting takes a bounded number of rounds
whatever the texts repeat.

Windows are taken in blocks of at most ``block`` (by their hash), each one pass over the documents; a block is what
is sent to the tasks. Which items hold a window is joined afterwards.

Null texts have no words; null ids are kept. Rows with equal id and text get equal results; empty tables on either
side are fine; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.llm.fm_index import FMIndex
from latewise.llm.work import written

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns what is no word character into a blank; bytes beyond ASCII belong to words.
_TABLE = bytes(c if c >= 128 or c in _ALNUM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PART = 128


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): distinct windows as joined words, with the items (as strings) that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                own = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} - {b""}
                rows += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.binary()).cast(pa.string()), batch.column("item").take(pa.array(rows, pa.int32()))],
                ["window", "item"],
            )

    given = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return given.mapInArrow(cut, "window string, item string").distinct()


class _Block:
    """The windows of one block as rows of symbols, by length."""

    def __init__(self, found: list[str]) -> None:
        texts = [w.encode().split() for w in found]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.width = max(map(len, texts), default=1)
        self.by_length = {}
        for n in sorted({len(t) for t in texts}):
            at = [i for i, t in enumerate(texts) if len(t) == n]
            self.by_length[n] = np.array(at), np.array([[self.number[w] for w in texts[i]] for i in at], dtype=np.int64)


def _parts(symbols: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without 0 in overlapping parts, each with an end mark; and every symbol's place in the input."""
    inside = np.concatenate([[False], symbols > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    # A last part of overlap words or fewer would repeat what the part before it holds.
    n = np.maximum(1, -(-(ends - begins - overlap) // PART))
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = begins[which] + nth * PART
    size = np.minimum(start + PART + overlap, ends[which]) - start + 1
    offset = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(offset - start, size)
    text = np.append(symbols, 0)[place]
    text[offset + size - 1] = 0
    return text, place


def _search(symbols: np.ndarray, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, window) of every occurrence in a shard's words."""
    none = np.zeros(0, dtype=np.int64)
    text, place = _parts(symbols, block.width - 1)
    if not len(text):
        return none, none, none
    index, found = FMIndex(text, len(block.number) + 1), []
    for length, (ids, patterns) in block.by_length.items():
        low, high = index.search(patterns)
        n = np.maximum(high - low, 0)
        rows = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        found.append((place[index.locate(rows)], np.full(len(rows), length), np.repeat(ids, n)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)


class _Scan:
    def __init__(self, block, shard_words: int, all_rows: bool) -> None:
        self.block, self.shard_words, self.all_rows = block, shard_words, all_rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = self.block.value
        held: list[tuple[pa.Scalar, int, str, np.ndarray]] = []
        size = 0
        for batch in batches:
            for key, content, text in zip(*(batch.column(c) for c in ("id", "content", "text"))):
                content, text = content.as_py(), text.as_py()
                words = words_of(text)
                held.append((key, content, text, np.fromiter(
                    map(block.number.get, words, itertools.repeat(0)), dtype=np.int32, count=len(words))))
                size += len(words) + 1
                if size >= self.shard_words:
                    yield self._shard(held, block, batch.schema.field("id").type)
                    held, size = [], 0
        if held:
            yield self._shard(held, block, held[0][0].type)

    def _shard(self, held: list, block: _Block, id_type: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(ids) + 1 for *_, ids in held])
        starts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), dtype=np.int64)
        for at, (*_, ids) in zip(starts, held):
            symbols[at : at + len(ids)] = ids
        first, length, window = _search(symbols, block)
        cover = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + length, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]]).astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
        doc_of_span, doc_of_hit = (np.searchsorted(starts, x, side="right") - 1 for x in (begins, first))
        spans: dict[int, list] = {}
        for d, a, b in zip(doc_of_span.tolist(), begins.tolist(), ends.tolist()):
            spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
        seen: dict[int, list] = {}
        for d, w in np.unique(np.stack([doc_of_hit, window], axis=1), axis=0).tolist():
            seen.setdefault(d, []).append(w)
        rows = range(len(held)) if self.all_rows else sorted(spans)
        out = [_row(held[d], spans.get(d, []), seen.get(d, [])) for d in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([held[d][0].as_py() for d in rows], type=id_type),
            *(pa.array(list(x), type=t) for x, t in zip(
                zip(*out) if out else [[]] * 5,
                [pa.int64(), pa.int64(), pa.list_(_SPAN), pa.list_(_SPAN), pa.list_(pa.int32())],
            )),
        ], ["id", "content", "n_words", "word_spans", "spans", "hits"])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _row(held: tuple, spans: list[tuple[int, int]], hits: list[int]) -> tuple:
    _, content, text, ids = held
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    return (
        content, len(ids), [{"start": a, "end": b} for a, b in spans],
        [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans], hits,
    )


def find_passages(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block: int = 200_000, shard_words: int = 1_000_000,
) -> DataFrame:
    """(id, content, n_words, word_spans, spans, items): for each document the merged spans that lie in occurrences of
    a window, as words and as code points (end exclusive), and the sorted items whose windows occur.
    ``content`` is the hash of the text."""
    spark = docs.sparkSession
    held = written(windows(items, width, item_col, item_text))
    names = held.select("window").distinct()
    n_blocks = max(1, -(-names.count() // block))
    given = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text")
    )
    shape = (f"id {given.schema['id'].dataType.simpleString()}, content long, n_words long, word_spans {_SPANS}, "
             f"spans {_SPANS}, hits array<int>")
    scans, hits = [], []
    for i in range(n_blocks):
        # Hashed blocks hold about ``block`` windows each.
        own = [r[0] for r in names.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == i).toLocalIterator()]
        scan = written(given.mapInArrow(_Scan(spark.sparkContext.broadcast(_Block(own)), shard_words, i == 0), shape))
        number = spark.createDataFrame(pa.table({
            "hit": pa.array(range(len(own)), type=pa.int32()), "window": pa.array(own, type=pa.string())}))
        found = scan.select("id", "content", F.explode("hits").alias("hit")).distinct()
        hits.append(found.join(number, "hit").join(held, "window").select("id", "content", "item").distinct())
        scans.append(scan.drop("hits"))
    named = hits[0]
    for more in hits[1:]:
        named = named.unionByName(more)
    named = named.groupBy("id", "content").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = _beside(scans[0], named, ["items"]).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    for more in scans[1:]:
        parts = more.groupBy("id", "content").agg(F.first("word_spans").alias("w"), F.first("spans").alias("s"))
        found = _beside(found, parts, ["w", "s"]).withColumns({
            "word_spans": F.when(F.col("w").isNull(), F.col("word_spans")).otherwise(_merged("word_spans", "w")),
            "spans": F.when(F.col("s").isNull(), F.col("spans")).otherwise(_merged("spans", "s")),
        }).drop("w", "s")
    return found


def _beside(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({"id": "_id", "content": "_content"})
    same = left["id"].eqNullSafe(right["_id"]) & left["content"].eqNullSafe(right["_content"])
    return left.join(right, same, "left").select(*left.columns, *columns)


def _merged(a: str, b: str):
    """Two lists of spans as one list of spans that do not touch."""
    return F.aggregate(F.array_sort(F.concat(a, b)), F.array().cast(_SPANS), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1).end >= s.start),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).end, s.end).alias("end")
        ))),
    ).otherwise(F.concat(done, F.array(s))))
