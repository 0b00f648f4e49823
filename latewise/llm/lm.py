"""Language-model scoring: exact word counts over all training text, and a gated recurrent model on top of them.

Tokens are the words of a text (A-Z lower-cased, split at ASCII blanks) and one end. Counting, training and scoring
run in tasks. The most frequent ``known`` words travel to the tasks with their counts; the counts of all other words
stay a table and are joined to the words that each text leaves open, so every count is exact.

Training takes every training document once, in ``rounds`` parts (by hash). In a round each task goes on from the
common parameters over its own documents; the results are averaged by tokens, piece by piece. Which documents a task
has decides what it learns, so scores change a little with the partitions of the input. The words that the model tells
apart grow with the distinct words, up to ``Shape.of``'s bound.

The model predicts the class of the next token and, inside a class, the word. Words outside the model's own share the
last class; there a word has the smoothed share (c + 0.1) / (n + 0.1 (v + 1)) of those words.

Null texts are empty: one end. A null id counts as the empty string and is held out. Repeated rows count each time
and get equal scores; with no training text all counts are 0. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.llm.gru import Params, Shape, Trainer, flat, initial, score_texts, unflat
from latewise.llm.work import one_thread, written

END, ADD, LIMIT = b"", 0.1, 200_000
#: Texts are gathered to about this many tokens before a model runs over them: more fill the lanes more evenly.
GATHER = 6_000_000
#: Parameters that travel and are added up together.
PIECE = 16_384


def tokens_of(text: str | None) -> list[bytes]:
    """The words and one end, which is written as the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _words(words) -> pa.Array:
    return pa.array(list(words), type=pa.binary()).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_words(counts), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(tokens_of(text.as_py()))
            if len(counts) > LIMIT:
                yield rows()
                counts.clear()
    yield rows()


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) of a table's ``text``, written."""
    return written(training.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(
        F.sum("c").alias("c")))


@dataclass
class Lexicon:
    """The known words by falling count, and what the counts sum to."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    shape: Shape

    def __post_init__(self) -> None:
        # The end is always one of the model's own words.
        own = ([END] + [w for w in self.words if w != END])[: self.shape.words]
        given = dict(zip(self.words, self.counts.tolist()))
        self.own_counts = np.array([given.get(w, 0) for w in own], dtype=np.float64)
        self.rest_total = self.total - int(self.own_counts.sum())
        self.rest_distinct = self.distinct - int((self.own_counts > 0).sum())
        self.own = own

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.total + ADD * (self.distinct + 1)))

    def rest(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.rest_total + ADD * (self.rest_distinct + 1)))

    def index(self) -> dict[bytes, int]:
        """Own words first, then the other known ones."""
        own = {w: i for i, w in enumerate(self.own)}
        return own | {w: self.shape.words + i for i, w in enumerate(x for x in self.words if x not in own)}

    def start(self) -> Params:
        share = (self.own_counts + ADD) / (self.total + ADD * (self.distinct + 1))
        return initial(self.shape, share, max(self.rest_total, 1) / max(self.total, 1))


def build_lexicon(counts: DataFrame, known: int = 131_072, shape: Shape | None = None) -> Lexicon:
    """The most frequent words; without a shape the model's own words grow with the number of distinct words."""
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(known).toArrow()
    words = [w.encode() for w in top["word"].to_pylist()]
    return Lexicon(words, top["c"].to_numpy().astype(np.int64), row[0], row[1], shape or Shape.of(row[1], row[0]))


class _Coder:
    """Words to input codes: own words, or a hash bucket for all others."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.shape, self.index = lexicon.shape, lexicon.index()
        self.code = np.array([*range(self.shape.words), *(
            self._bucket(w) for w in list(self.index)[len(lexicon.own) :]
        )], dtype=np.int32)

    def _bucket(self, word: bytes) -> int:
        return self.shape.words + zlib.crc32(word) % self.shape.hashed

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Codes of all words, places in the lexicon of the known ones, and the words that are not known."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        codes, open_at = self.code[at], np.flatnonzero(at < 0)
        rare = [words[i] for i in open_at.tolist()]
        crc, first, n = zlib.crc32, self.shape.words, self.shape.hashed
        codes[open_at] = [first + crc(w) % n for w in rare]
        return codes, at[at >= 0], rare


def fit(training: DataFrame, lexicon: Lexicon, rounds: int = 3, n_lanes: int = 512, task_tokens: int = 1_000_000) -> Params:
    """Parameters after every training document was taken once."""
    spark, params = training.sparkSession, lexicon.start()
    one_thread(spark)
    part = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((lexicon, params))

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lexicon, start = shared.value
            coder, trainer = _Coder(lexicon), Trainer(start, lexicon.shape, n_lanes=n_lanes)
            for texts in _gathered(batches, lambda text: coder(tokens_of(text))[0]):
                trainer.learn(texts)
            values = flat(trainer.p).astype(np.float32)
            pieces = [values[at : at + PIECE].tobytes() for at in range(0, len(values), PIECE)] if trainer.tokens else []
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(pieces, pa.binary()),
                pa.array(np.full(len(pieces), trainer.tokens, dtype=np.int64)),
            ], ["piece", "values", "tokens"])

        # Not more tasks than have ``task_tokens`` to learn from: each sends all parameters.
        own = training.filter(part == k).select("text").coalesce(1 + lexicon.total // rounds // task_tokens)
        found = own.mapInArrow(train, "piece int, values binary, tokens long").repartition("piece").mapInArrow(
            _summed, "piece int, sums binary, tokens long").orderBy("piece").collect()
        if found:
            values = np.concatenate([np.frombuffer(r["sums"]) / r["tokens"] for r in found])
            params = unflat(values, params)
    return params


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece of the parameters: the sums of all tasks, weighted by tokens."""
    held: dict[int, list] = {}
    for batch in batches:
        for piece, values, tokens in zip(*(batch.column(c).to_pylist() for c in ("piece", "values", "tokens"))):
            own = held.setdefault(piece, [0.0, 0])
            own[0] = own[0] + np.frombuffer(values, dtype=np.float32).astype(np.float64) * tokens
            own[1] += tokens
    yield pa.RecordBatch.from_arrays([
        pa.array(list(held), pa.int32()), pa.array([sums.tobytes() for sums, _ in held.values()], pa.binary()),
        pa.array([n for _, n in held.values()], pa.int64()),
    ], ["piece", "sums", "tokens"])


def _gathered(batches: Iterator[pa.RecordBatch], code) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append(code(text.as_py()))
            size += len(held[-1])
            if size >= GATHER:
                yield held
                held, size = [], 0
    if held:
        yield held


SCORED = "n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,n:bigint>>"


def score_documents(
    docs: DataFrame, counts: DataFrame, lexicon: Lexicon, params: Params, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): log10 probabilities of every text by counts and by the model."""
    one_thread(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, params))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, params = shared.value
        coder = _Coder(lexicon)
        in_model = lexicon.shape.words
        counted = np.zeros(len(coder.code))
        given = dict(zip(lexicon.words, lexicon.counts.tolist()))
        for word, i in coder.index.items():
            counted[i] = given.get(word, 0)
        base = lexicon.base(counted)
        rest = np.where(np.arange(len(counted)) < in_model, 0.0, lexicon.rest(counted))

        def rows(held: list) -> pa.RecordBatch:
            ids, codes, n_known, base_score, rest_score, rare = zip(*held)
            model = score_texts(params, lexicon.shape, list(codes)) / np.log(10)
            open_words = pa.StructArray.from_arrays([
                pa.chunked_array([w for w, _ in rare], pa.string()).combine_chunks(),
                pa.chunked_array([n for _, n in rare], pa.int64()).combine_chunks(),
            ], ["word", "n"])
            ends = np.cumsum([0, *(len(w) for w, _ in rare)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array([x.as_py() for x in ids], type=ids[0].type), pa.array([len(c) for c in codes], pa.int64()),
                pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()),
                pa.array(model + np.array(rest_score), pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends), open_words),
            ], ["id", "n_tokens", "n_known", "base_score", "score", "rare"])

        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text")):
                codes, at, words = coder(tokens_of(text.as_py()))
                rare = Counter(words)
                held.append((
                    key, codes, int((counted[at] > 0).sum()), base[at].sum(), rest[at].sum(),
                    (_words(rare), pa.array(list(rare.values()), pa.int64())),
                ))
                size += len(codes)
                if size >= GATHER:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {given.schema['id'].dataType.simpleString()}, {SCORED}"
    scored = written(given.mapInArrow(score, shape).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.n")
    c = F.coalesce("c", F.lit(0)).cast("double")
    n = F.col("n").cast("double")

    def share(total: int, distinct: int) -> Column:
        return F.log10((c + ADD) / F.lit(float(total + ADD * (distinct + 1))))

    more = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(n * share(lexicon.total, lexicon.distinct)).alias("more_base"),
        F.sum(n * share(lexicon.rest_total, lexicon.rest_distinct)).alias("more_score"),
    )
    return scored.join(more, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
