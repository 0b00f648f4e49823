import random
import re

import numpy as np
import pytest

from latewise.llm import decontaminate
from latewise.llm.decontaminate import find_passages
from latewise.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    found = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - width + 1)) if own else ():
            found.setdefault(tuple(own[k : k + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for n in {len(w) for w in found}:
            for k in range(len(own) - n + 1):
                if here := found.get(tuple(own[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= here
        out.append((doc, len(own), len(hit), sorted(names)))
    return out


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 300):
        text = np.append(rng.integers(0, 4, n), 0)
        ends = np.cumsum(text == 0)
        # Each end is a symbol of its own, below all others.
        symbols = [(0, int(ends[i])) if s == 0 else (1, int(s)) for i, s in enumerate(text)]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])
        index = FMIndex(text, 4, sample=5)
        for pattern in ([1], [2, 3], [1, 1], [3, 2, 1]):
            low, high = index.search(np.array([pattern]))
            got = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
            assert got == [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]


@pytest.mark.parametrize(("block", "part"), [(1000, 128), (10, 128), (1000, 3)])
def test_equal_brute_force(spark, monkeypatch, block, part):
    random.seed(8)
    docs = [(i % 50 if i % 7 else None, random.choice([" ", ", ", "\n"]).join(
        random.choice(["a", "b", "C", "é1", "zz"]) for _ in range(random.choice([0, 3, 30, 200])))) for i in range(90)]
    docs += [(1, None), (2, ""), docs[4], docs[4]]
    items = [(i, " ".join(random.choice(["a", "b", "c", "é1", "yy"]) for _ in range(random.choice([0, 1, 4, 6]))))
             for i in range(25)] + [(5, None), (7, "...")]
    monkeypatch.setattr(decontaminate, "PART", part)
    got = find_passages(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int"),
        spark.createDataFrame(items, "item_id long, text string"), width=4, block=block, shard_words=100,
    ).join(spark.createDataFrame(docs, "i long, t string").selectExpr("xxhash64(t) content", "t").distinct(), "content")
    got = got.collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.id, r.n_words, sum(s.end - s.start for s in r.word_spans), list(r["items"])) for r in got), key=key) \
        == sorted(brute(docs, items, 4), key=key)
    for r in got:  # the spans in characters hold the same words
        assert sum(len(words(r.t[s.start : s.end])) for s in r.spans) == sum(s.end - s.start for s in r.word_spans)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_passages(docs.limit(0), items).count() == 0
    row = find_passages(docs, items.limit(0)).first()
    assert (row.n_words, row.spans, row["items"]) == (3, [], [])
