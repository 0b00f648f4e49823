"""Collocations: frequent phrases of two to four words by multikey quicksort of word suffixes, scored at their weakest cut.

Text: A-Z lower-cased, pieces split at ``.,;:!?`` and line ends, words at blanks and tabs; nothing crosses a piece. All is
counted per language (null: ``und``) over all documents and whole texts.

1. Words are counted. A word rarer than ``least`` cannot be part of a frequent phrase, so it ends a suffix.
2. Every other position gives its suffix of up to ``longest`` words; equal ones are added up inside a block of texts, and
   what a block has for one task travels as one compressed table. Suffixes are routed by their two leading words, so a
   phrase meets all its occurrences in one task. Leading pairs that
   hold more than a 2048th of all words (so fewer than 2048) are routed by the whole suffix instead, and their shorter
   prefixes travel as rows of their own: each row says from which depth on it counts. No task gets a hot prefix whole.
3. A task sorts pointers to its suffixes with a three-way multikey quicksort, one word a level. The weight of an equal
   partition is the count of its phrase; partitions below ``least`` are abandoned.
4. Counts of the two sides of each cut are joined on, the cut with the lowest score decides, candidates inside a longer
   candidate of nearly the same count go, and the best ``top`` of each language remain.

Membership of frequent words is a filter of fixed size whose false hits only cost time. Null and empty texts have no
words and give nothing; repeated rows count again; an empty table gives no rows; other columns are ignored. Equal scores
and counts are ordered by the bytes of the phrase, so ranks have no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewise.llm.membership import filter_of, held
from latewise.llm.work import written

SEED = 42
#: Odd factors of the hashes of a suffix's words by place.
PLACES = np.random.default_rng(SEED).integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER + b"\t.,;:!?\x0b\x0c\r", _LOWER + b" " + b"\n" * 9)


class Words:
    """The words of some texts of one language as codes, and where pieces end."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.lengths: list[int] = []

    def add(self, text: str) -> None:
        for piece in text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n"):
            words = [w for w in piece.split(b" ") if w]
            if words:
                self.words += words
                self.lengths.append(len(words))

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the code of each word, and whether it is the last of its piece."""
        encoded = pa.array(self.words, pa.binary()).dictionary_encode()
        last = np.zeros(len(self.words), dtype=bool)
        last[np.cumsum(self.lengths) - 1] = True
        return encoded.dictionary.cast(pa.string()), encoded.indices.to_numpy().astype(np.int64), last


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[dict[str, Words]]:
    """The words of about ``block_chars`` characters at a time, by language."""
    block: dict[str, Words] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            said = text.as_py()
            if said:
                block.setdefault(lang.as_py(), Words()).add(said)
                n += len(said)
            if n > block_chars:
                yield block
                block, n = {}, 0
    if block:
        yield block


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of some columns and how often each occurs."""
    names = [str(i) for i in range(len(keys))]
    table = pa.table(dict(zip(names, map(pa.array, keys)))).group_by(names).aggregate([([], "count_all")])
    return tuple(table.column(name).to_numpy() for name in [*names, "count_all"])


def word_counts(docs: DataFrame, block_chars: int = 1 << 23, n_hot: int = 2_048) -> DataFrame:
    """(lang, word, pair, n): counts of words; of no word, all words; and, as ``pair``, blocks' counts of hot pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            for lang, words in block.items():
                if not words.words:
                    continue
                names, codes, last = words.coded()
                pairs, n_pairs = _counted(codes[:-1][~last[:-1]] << 32 | codes[1:][~last[:-1]])
                hot = n_pairs * (n_hot // 4) >= len(codes)
                pairs, n_pairs = pairs[hot], n_pairs[hot]
                joined = pc.binary_join_element_wise(names.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF)), " ")
                n = np.concatenate([np.bincount(codes, minlength=len(names)), n_pairs, [len(codes)]])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.concat_arrays([names, joined, pa.nulls(1, pa.string())]),
                    pa.array(np.arange(len(n)) // len(names) * (np.arange(len(n)) < len(n) - 1) > 0), pa.array(n),
                ], ["lang", "word", "pair", "n"])

    found = docs.mapInArrow(each, "lang string, word string, pair boolean, n long")
    return found.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n"))


def _hash(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64`` of the language, a tab and the word."""
    head = lang.encode("utf-8", "surrogatepass") + b"\t"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, SEED) for w in words), dtype=np.uint64, count=len(words))


def suffix_rows(
    names: pa.Array, codes: np.ndarray, last: np.ndarray, known: np.ndarray, hot: set[str], longest: int, hashes: np.ndarray
) -> tuple[pa.Table, np.ndarray]:
    """(suffix, n, begins) and routes: distinct suffixes of two or more known words, sorted by the codes of their words.

    A row counts for its prefixes of ``begins`` or more words. Its route is a hash of the two leading words, or of all
    words where it begins later.
    """
    own = np.where(known[codes], codes, -1)
    after = np.append(own[1:], -1)
    after[last] = -1
    parts = [own]
    for _ in range(longest - 1):
        parts.append(np.where(parts[-1] >= 0, after, -1))
        after = np.append(after[1:], -1)
    starts = parts[1] >= 0
    *parts, n = _counted(*(p[starts] for p in parts))
    begins = np.full(len(n), 2)
    place = {word: i for i, word in enumerate(names.to_pylist())} if hot else {}
    pairs = [tuple(place.get(w, -1) for w in pair.split(" ")) for pair in hot]
    is_hot = np.isin(parts[0] << 32 | parts[1], np.array([a << 32 | b for a, b in pairs if a >= 0 and b >= 0], dtype=np.int64))
    if is_hot.any():
        rows = [[p[~is_hot] for p in (*parts, n, begins)]]
        for depth in range(2, longest + 1):
            mine = is_hot & (parts[depth - 1] >= 0)
            prefix = [p[mine] if i < depth else np.full(mine.sum(), -1) for i, p in enumerate(parts)]
            table = pa.table({str(i): p for i, p in enumerate([*prefix, n[mine]])})
            keys = [str(i) for i in range(longest)]
            table = table.group_by(keys).aggregate([(str(longest), "sum")])
            rows.append([*(table.column(k).to_numpy() for k in keys), table.column(f"{longest}_sum").to_numpy(),
                         np.full(len(table), depth)])
        *parts, n, begins = (np.concatenate(column) for column in zip(*rows))
    order = np.lexsort(tuple(reversed(parts)))
    parts, n, begins = [p[order] for p in parts], n[order], begins[order]
    route = np.zeros(len(n), dtype=np.uint64)
    for place, p in enumerate(parts):
        used = (p >= 0) & ((begins > 2) | (place < 2))
        route += np.where(used, hashes[np.maximum(p, 0)] * PLACES[place], 0).astype(np.uint64)
    words = [names.take(pa.array(p, mask=p < 0)) for p in parts]
    suffix = pc.binary_join_element_wise(*words, " ", null_handling="skip")
    table = pa.table({"suffix": suffix, "n": pa.array(n.astype(np.int64)), "begins": pa.array(begins.astype(np.int32))})
    return table, route ^ (route >> np.uint64(32))


_SUFFIXES = pa.schema([("lang", pa.string()), ("suffix", pa.string()), ("n", pa.int64()), ("begins", pa.int32())])


def _packed(rows: pa.Table, part: np.ndarray) -> pa.RecordBatch:
    """(part, rows): the rows of each part as one compressed table."""
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)), part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
    tables = []
    for at, end in zip(starts, np.append(starts[1:], len(part))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _SUFFIXES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(at, end - at).cast(_SUFFIXES))
        tables.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(tables, pa.binary())], ["part", "rows"])


def _suffixes(
    docs: DataFrame, frequent: DataFrame, hot: set[tuple[str, str]], longest: int, block_chars: int, n_parts: int
) -> DataFrame:
    """(part, rows): suffixes of all documents, packed for the parts they are routed to."""
    tagged = frequent.select(F.xxhash64(F.concat_ws("\t", "lang", "word")).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast((filter_of(tagged, "h"), hot))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_pairs = shared.value
        for block in _blocks(batches, block_chars):
            for lang, words in block.items():
                if not words.words:
                    continue
                names, codes, last = words.coded()
                hashes = _hash(lang, names.cast(pa.binary()).to_pylist())
                mine = {p for l, p in hot_pairs if l == lang}
                rows, route = suffix_rows(names, codes, last, held(bits, hashes), mine, longest, hashes)
                rows = rows.add_column(0, "lang", pa.array([lang] * len(rows), pa.string()))
                yield _packed(rows, (route % np.uint64(n_parts)).astype(np.int64))

    return docs.mapInArrow(each, "part int, rows binary")


def equal_partitions(
    columns: list[np.ndarray], weight: np.ndarray, begins: np.ndarray, least: int
) -> Iterator[tuple[int, int, int]]:
    """(row, depth, count) of each prefix that weighs ``least`` or more, by three-way multikey quicksort.

    ``columns``: the code at each depth, -1 after the end. A row counts for prefixes of ``begins`` or more columns.
    """
    stack = [(np.arange(len(weight)), 0)]
    while stack:
        rows, depth = stack.pop()
        if weight[rows].sum() < least:
            continue
        key = columns[depth][rows]
        pivot = np.sort(key[[0, len(key) // 4, len(key) // 2, 3 * (len(key) // 4), -1]])[2]
        equal = rows[key == pivot]
        if len(equal) < len(rows):
            stack += [(rows[key < pivot], depth), (rows[key > pivot], depth)]
        if pivot < 0:
            continue
        weights = weight[equal]
        if weights.sum() < least:
            continue
        count = int(weights[begins[equal] <= depth + 1].sum())
        if count >= least:
            yield int(equal[0]), depth + 1, count
        if depth + 1 < len(columns):
            stack.append((equal, depth + 1))


def phrase_counts(suffixes: DataFrame, least: int, longest: int, n_parts: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of two or more words that occur ``least`` times or more."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(r.as_buffer()).read_all() for b in batches for r in b.column("rows")]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        split = pc.split_pattern(table.column("suffix").combine_chunks(), " ")
        ends = split.offsets.to_numpy()
        codes = split.values.dictionary_encode().indices.to_numpy()
        columns = [langs.indices.to_numpy()]
        for place in range(longest):
            at = ends[:-1] + place
            columns.append(np.where(at < ends[1:], codes[np.minimum(at, len(codes) - 1)], -1))
        # One more column, the language, comes before the words.
        begins = table.column("begins").to_numpy() + 1
        found = [x for x in equal_partitions(columns, table.column("n").to_numpy(), begins, least) if x[1] > 2]
        rows = pa.array([row for row, _, _ in found], pa.int64())
        suffix = table.column("suffix").take(rows).to_pylist()
        phrases = [" ".join(s.split(" ")[: depth - 1]) for s, (_, depth, _) in zip(suffix, found)]
        yield pa.RecordBatch.from_arrays([
            table.column("lang").take(rows).combine_chunks(), pa.array(phrases, pa.string()),
            pa.array([count for _, _, count in found], pa.int64()),
        ], ["lang", "phrase", "f"])

    return suffixes.repartitionById(n_parts, "part").mapInArrow(sort, "lang string, phrase string, f long")


def _side(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each phrase of two or more words with its weakest cut.

    A single word may be a side of very many phrases: those joins are salted.
    """
    salts = F.when(F.instr("phrase", " ") > 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(15)))
    sides = counts.select("lang", F.col("phrase").alias("side"), "f", F.explode(salts).alias("salt"))
    phrases = counts.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    for name, (start, length) in {"l": (F.lit(1), F.col("k")), "r": (F.col("k") + 1, size - F.col("k"))}.items():
        salt = F.when(length == 1, F.pmod(F.xxhash64("phrase"), F.lit(16))).otherwise(0).cast("int")
        mine = cuts.withColumns({"side": _side(F.col("words"), start, length), "salt": salt})
        cuts = mine.join(sides.withColumnRenamed("f", name), ["lang", "side", "salt"]).drop("side", "salt")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(weakest)
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_inside_longer(candidates: DataFrame, percent: int) -> DataFrame:
    """Those candidates that no longer candidate contains with ``percent`` of their count or more."""
    size = F.size("words")
    longer = candidates.filter(size > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("lang", "words", "a", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
    inside = longer.select("lang", _side(F.col("words"), F.col("at"), F.col("k")).alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = "cast({} as decimal(19,0)) * {}"
    stays = F.col("most").isNull() | (F.expr(wide.format("most", 100)) < F.expr(wide.format("a", percent)))
    return candidates.join(most, ["lang", "phrase"], "left").filter(stays).drop("most")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2_000, percent: int = 80,
    lang_col: str = "lang", text_col: str = "text", task_words: int = 1_500_000, block_chars: int = 1 << 23, n_hot: int = 2_048,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    a, l, r: counts of the phrase and of both sides of its cut; n: all words. ``task_words`` bounds the suffixes of a
    task, ``block_chars`` the texts that are counted at a time, ``n_hot`` the leading pairs that are dealt out.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = written(word_counts(docs, block_chars, n_hot).filter((F.col("n") >= least) | F.col("word").isNull() | F.col("pair")))
    totals = counts.filter(F.col("word").isNull()).select("lang", "n")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    frequent = counts.filter(F.col("word").isNotNull() & ~F.col("pair")).select("lang", "word", F.col("n").alias("f"))
    # Each of these pairs holds at least an ``n_hot``-th of all words, so there are no more than that.
    hot = counts.filter(F.col("pair") & (F.col("n") * n_hot >= n_words)).select("lang", "word")
    n_parts = 1 + n_words // task_words
    suffixes = _suffixes(docs, frequent, {(r["lang"], r["word"]) for r in hot.toLocalIterator()}, longest, block_chars, n_parts)
    phrases = phrase_counts(suffixes, least, longest, n_parts)
    both = written(phrases.unionByName(frequent.withColumnRenamed("word", "phrase")))
    candidates = written(scored(both))
    # Ranked in salted parts of a language first, so that its last task sees no more than ``top`` rows of each.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    stays = not_inside_longer(candidates, percent).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        stays = stays.withColumn("rank", rank).filter(F.col("rank") <= top)
    ranked = stays.drop("salt")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
