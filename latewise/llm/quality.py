"""Quality rules: plain counts, and a log-likelihood ratio of trusted against raw text.

Byte 4-grams are hashed into ``N_BUCKETS`` buckets. Two multinomials are counted: over all documents, and over
trusted documents (all labels say quality 1 and toxic 0). The trusted shares start from the raw ones with the weight of ``prior``
n-grams, so little trusted text says little. A document's score is the mean over its n-grams of
log(trusted share / raw share); it is kept if the score reaches ``threshold``. How far scores spread depends on the
amount of trusted text, so ``fit_threshold`` sets it from trusted documents that the counts left out (one in
``HOLD_OUT``, by hash): the ``passing`` share of those that meet the base rules reaches it.

Both counts and the threshold cover every document that is trusted; ``max_trusted`` bounds them only where it is given.
Texts stay where they are read: a membership filter of the trusted ids goes to the tasks, and what it lets through wrongly is
counted again and taken off. Only the texts of those documents, or of ids that a second filter takes for theirs, move.

Null texts have no words; texts of fewer than four bytes have no n-gram and score 0. Without any trusted document
every score is 0; without a held-out one the threshold is ``THRESHOLD``. Repeated rows count each time; tables can be empty; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewise.llm.membership import filter_of, passes, passing
from latewise.llm.text import utf8
from latewise.llm.work import written

N_GRAM, N_BUCKETS = 4, 65_536
HOLD_OUT, THRESHOLD = 5, -0.15
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
#: Bytes that are blanks or go on with a code point.
_NO_POINT = BLANKS + bytes(range(0x80, 0xC0))


def buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte but the last three."""
    if len(raw) < N_GRAM:
        return np.zeros(0, dtype=np.uint16)
    gram = raw[:-3].astype(np.uint32)
    for i in range(1, N_GRAM):
        gram = gram << np.uint32(8) | raw[i : len(raw) - 3 + i]
    # The product's upper half is the bucket.
    return (gram * np.uint32(2_654_435_769) >> np.uint32(16)).astype(np.uint16)


def _blocks(raw: np.ndarray, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, a block at a time, so a long text takes no more memory."""
    for at in range(0, len(raw) - (N_GRAM - 1), size):
        yield buckets(raw[at : at + size + N_GRAM - 1])


def _texts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) of the texts of a batch; a few at a time are unpacked."""
    for first in range(0, len(batch), rows):
        raw, offsets = utf8(batch.column("text").slice(first, rows))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield first + i, raw[a:b]


def _counter(shared=None):
    """Counts n-grams by bucket: of all texts, and of those whose hash passes the filter that is ``shared`` with the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_BUCKETS), dtype=np.int64)
        kept: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            marked = [False] * len(batch) if shared is None else passing(shared.value, batch.column("hash")).tolist()
            for row, raw in _texts(batch):
                for block in _blocks(raw):
                    kept[marked[row]].append(block)
                    size += len(block)
                    if size > 1 << 21:
                        _add(total, kept)
                        size = 0
        _add(total, kept)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(seen.astype(np.int32)), "raw": pa.array(total[0][seen]), "trusted": pa.array(total[1][seen])
        })

    return count


def _add(total: np.ndarray, kept: tuple[list, list]) -> None:
    for trusted, blocks in enumerate(kept):
        if blocks:
            counts = np.bincount(np.concatenate(blocks), minlength=N_BUCKETS)
            total[0] += counts
            if trusted:
                total[1] += counts
            blocks.clear()


def trusted_ids(labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """All ids whose labels all say quality 1 and toxic 0, or the ``max_trusted`` with the smallest hashes."""
    ids = (
        labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
        .filter("quality = 1 AND toxic = 0").select("doc_id")
    )
    return ids if max_trusted is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(HOLD_OUT)) == 0


def _hashed(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and ids (written) with their ids in the wider of both types and a hash of it."""
    kind = docs.select("doc_id").union(ids.select("doc_id")).schema["doc_id"].dataType
    doc_id = F.col("doc_id").cast(kind).alias("doc_id")
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("hash")
    return docs.select(doc_id, "text").select("*", own), written(ids.select(doc_id).select("*", own))


def wrongly_passed(docs: DataFrame, ids: DataFrame, packed: np.ndarray, bits: int) -> DataFrame:
    """(text) of the documents that pass the filter of the ids but are not among them; only texts that pass a filter of those move."""
    found = docs.select("doc_id", "hash").filter(passes(docs, "hash", packed))
    wrong = written(found.distinct().join(ids, "doc_id", "left_anti"))
    if wrong.isEmpty():
        return docs.select("text").limit(0)
    near = docs.filter(passes(docs, "hash", packed, filter_of(wrong, "hash", bits)))
    # Written, as a task that filters and counts would need two Python workers at a time.
    return written(near.join(wrong.select("doc_id"), "doc_id", "left_semi").select("text"))


def _counts(rows: DataFrame, shared=None) -> np.ndarray:
    counts = (
        rows.mapInArrow(_counter(shared), "bucket int, raw long, trusted long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    )
    both = np.zeros((2, N_BUCKETS))
    for row, name in enumerate(("raw", "trusted")):
        both[row, counts["bucket"].to_numpy()] = counts[name].to_numpy()
    return both


def fit_ratio(
    docs: DataFrame, labels: DataFrame, max_trusted: int | None = None, prior: float = 500_000, hold_out: bool = False, bits: int = 25
) -> np.ndarray:
    """The log ratio of each bucket (65,536 numbers, whatever the corpus); ``hold_out`` for ``fit_threshold``.

    ``bits`` sets the size of the membership filters (2 to that power); smaller ones move more texts and change nothing else.
    """
    ids = trusted_ids(labels, max_trusted)
    docs, ids = _hashed(docs, ids.filter(~_held_out()) if hold_out else ids)
    packed = filter_of(ids, "hash", bits)
    both = _counts(docs.select("text", "hash"), docs.sparkSession.sparkContext.broadcast(packed))
    both[1] -= _counts(wrongly_passed(docs, ids, packed, bits))[0]
    if not both[1].any():
        return np.zeros(N_BUCKETS)
    raw = (both[0] + 1) / (both[0].sum() + N_BUCKETS)
    return np.log((both[1] + prior * raw) / (both[1].sum() + prior) / raw)


def fit_threshold(
    docs: DataFrame, labels: DataFrame, ratio: np.ndarray, max_trusted: int | None = None, passing: float = 0.99, bits: int = 25
) -> float:
    """The greatest score that the ``passing`` share of the held-out trusted documents reaches; exact.

    Documents that pass a filter of their ids are scored where they are read; ids and scores alone move.
    """
    if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:
        docs = docs.filter(_held_out())  # the same hash on both sides
    docs, ids = _hashed(docs, trusted_ids(labels, max_trusted).filter(_held_out()))
    scored = score_quality(docs, ratio, only=filter_of(ids, "hash", bits)).filter(~F.col("base_failed"))
    scored = scored.select(F.col("record.doc_id").alias("doc_id"), "score")
    scores = written(scored.join(ids, "doc_id", "left_semi").select("score"))
    n = scores.count()
    return nth_smallest(scores, int((1 - passing) * n)) if n else THRESHOLD


def nth_smallest(scores: DataFrame, place: int, most: int = 10_000, cells: int = 1_000) -> float:
    """The score at a place, from 0, of all in order: ranges are narrowed by counts until ``most`` scores are left."""
    while True:
        r = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n")).first()
        if r["low"] == r["high"]:
            return float(r["low"])
        if r["n"] <= most:
            return float(np.sort(scores.toArrow()["score"].to_numpy())[place])
        # The lowest score falls into the first cell and the highest into the last, so a range always shrinks.
        cell = F.floor((F.col("score") - r["low"]) / (r["high"] - r["low"]) * cells)
        for at, n in sorted((c["cell"], c["count"]) for c in scores.groupBy(cell.alias("cell")).count().collect()):
            if place < n:
                scores = scores.filter(cell == at)
                break
            place -= n


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in 3-word windows that occur twice or more.

    Of a text in UTF-8: bytes split at exactly the six ASCII blanks, and 0x80 to 0xBF begin no code point.
    """
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(raw.translate(None, _NO_POINT)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), _repeated(words),
    )


def _repeated(words: list[bytes]) -> int:
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) < 4 or len(number) > len(ids) - 1:
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        inside[shift : len(ids) - 2 + shift] |= again
    return int(inside.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, only: np.ndarray | None = None) -> DataFrame:
    """(record, counts, score, base_failed, kept): every row with its verdict; input columns are in ``record``.

    With ``only``, a membership filter, rows whose column ``hash`` does not pass it are left out.
    """
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(only)
    weights = docs.sparkSession.sparkContext.broadcast(ratio)
    columns = [f.name for f in docs.schema.fields]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("record"), F.col("text").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(passing(wanted.value, batch.column("record").field("hash"))))
            mean, counts = np.zeros(len(batch)), []
            for row, raw in _texts(batch):
                total = sum(float(weights.value[block].sum()) for block in _blocks(raw))
                mean[row] = total / max(len(raw) - (N_GRAM - 1), 1)
                counts.append(base_counts(raw.tobytes()))
            counts = np.array(counts, dtype=np.int64)
            counts = counts.reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("record"), *(pa.array(c) for c in counts.T), pa.array(mean)],
                ["record", *COUNTS, "score"],
            )

    shape = T.StructType([
        T.StructField("record", packed.schema["record"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS),
        T.StructField("score", T.DoubleType()),
    ])
    scored = packed.mapInArrow(score, shape)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )
