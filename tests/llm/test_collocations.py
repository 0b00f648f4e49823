import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from latewise.llm import collocations as C


def brute(rows, least, top, percent=80, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i : i + k])] += 1
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    out = []
    for (lang, words), a in found.items():
        inside = [
            f for (other, longer), f in found.items()
            if other == lang and len(longer) > len(words)
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        ]
        if inside and 100 * max(inside) >= percent * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    rows, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "w") for r in rows], "lang string, text string, n int, word string")
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def corpus(seed, n=60):
    random.seed(seed)
    words = ["the", "of", "a", "New", "york", "city", "hall", "É", "x\x1cy", "\xa0", "z"] + [f"r{i}" for i in range(200)]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(random.randint(0, 120)):
            text.append(random.choice(["new york city hall", "of the", " ".join(random.choices(words[:11], k=3)), random.choice(words)]))
            text.append(random.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "!"]))
        rows.append((random.choice(["en", "de", None, "und", ""]), "".join(text)))
    return rows


def test_phrases_equal_brute_force(spark):
    rows = corpus(5)
    for least, top in ((5, 2_000), (3, 7)):
        assert found(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_hot_pairs_and_many_tasks(spark):
    rows = corpus(6) + [("en", "hot pair " + " ".join(f"w{i % 7} hot pair" for i in range(300)))] * 3
    want = brute(rows, 4, 2_000)
    assert found(spark, rows, least=4, task_words=200) == want
    # Few texts a block, so every block has hot pairs of its own.
    assert found(spark, rows, least=4, task_words=200, block_chars=100, n_hot=40) == want


def test_odd_rows(spark):
    long = "one two three four five " * 60_000
    rows = [("en", None), (None, ""), ("en", " \t.,"), ("de", long), ("de", "One TWO"), ("en", "a b"), ("en", "a b")]
    assert found(spark, rows, least=2) == brute(rows, 2, 2_000)
    assert found(spark, [("en", None)]) == found(spark, []) == []


def test_scores_pass_64_bits(spark):
    big = 6_000_000_000_000_000_000
    counts = spark.createDataFrame(
        [("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)], "lang string, phrase string, f long"
    )
    row = C.scored(counts).collect()[0]
    assert row.score == 2_000_000 * (big - 2) // (2 * big - 1)
    assert C.not_inside_longer(C.scored(counts), 80).count() == 1


def test_quicksort_counts_prefixes():
    draw = np.random.default_rng(8)
    codes = draw.integers(0, 4, size=(500, 3))
    codes[draw.random(500) < 0.3, 2] = -1
    weight, begins = draw.integers(1, 5, size=500), np.where(draw.random(500) < 0.2, 3, 1)
    got = {(tuple(codes[row, :depth]), n) for row, depth, n in C.equal_partitions(list(codes.T), weight, begins, 25)}
    want = Counter()
    for row, w, b in zip(codes, weight, begins):
        for depth in range(b, 4):
            if (row[:depth] >= 0).all():
                want[tuple(row[:depth])] += int(w)
    assert got == {(key, n) for key, n in want.items() if n >= 25}


def test_suffixes_stop_at_rare_words_and_pieces():
    names = pa.array(["a", "b", "rare"])
    codes, last = np.array([0, 1, 0, 2, 0, 1, 0]), np.array([0, 0, 0, 0, 0, 1, 1], dtype=bool)
    hashes = np.arange(3, dtype=np.uint64)
    rows, route = C.suffix_rows(names, codes, last, np.array([True, True, False]), set(), 4, hashes)
    assert len(set(route[:2].tolist())) == 1 and len(route) == 3  # by the two leading words
    assert sorted(zip(rows.column("suffix").to_pylist(), rows.column("n").to_pylist())) == [("a b", 1), ("a b a", 1), ("b a", 1)]
