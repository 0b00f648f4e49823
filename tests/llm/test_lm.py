import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from latewise.llm import gru
from latewise.llm.lm import build_lexicon, count_words, fit, held_out, score_documents


def _loss(p, shape, x, y):
    states = gru._steps(p, x, shape.begin, np.zeros((x.shape[1], shape.hidden)), None).astype(np.float64)
    return -gru._log_shares(p, shape, states.reshape(-1, shape.hidden), y.ravel()).sum()


def test_gradients_equal_differences():
    shape, rng = gru.Shape(3, 2, 4, 3), np.random.default_rng(0)
    start = gru.initial(shape, np.array([0.3, 0.2, 0.1, 0.1, 0.05, 0.05]), 0.2)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in start.items()}
    x = np.array([[9, 9], [1, 2], [7, 0], [9, 3]])
    y = np.array([[1, 2], [7, 0], [0, 3], [5, 8]])
    trainer, seen = gru.Trainer(p, shape, n_lanes=2, steps=4), {}
    trainer.p, trainer._step = p, lambda name, at, g: seen.update({name: (at, g)})
    trainer._window(x, y, np.ones_like(x, dtype=bool), np.zeros((2, 4)))
    for name, value in p.items():
        at, g = seen[name]
        full = np.zeros_like(value)
        full[at] = g * 8
        for _ in range(10):
            i = tuple(int(rng.integers(0, s)) for s in value.shape)
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][i] += 1e-2
            down[name][i] -= 1e-2
            assert abs((_loss(up, shape, x, y) - _loss(down, shape, x, y)) / 2e-2 - full[i]) < 1e-3, name


def test_windows_and_lanes_do_not_change_a_score():
    shape, rng = gru.Shape(4, 4, 5, 8), np.random.default_rng(1)
    p = gru.initial(shape, np.full(16, 1 / 20), 0.2)
    p["to_class"] += rng.normal(0, 1, p["to_class"].shape).astype(np.float32)
    texts = [rng.integers(0, 24, n).astype(np.int32) for n in (1, 2, 50, 7, 1, 33)]
    one = gru.score_texts(p, shape, texts, n_lanes=1, steps=64)
    for lanes, steps in ((3, 4), (6, 1), (2, 16)):
        assert np.allclose(gru.score_texts(p, shape, texts, lanes, steps), one, atol=1e-3)


def scalar_score(p, shape, text):
    """The log probability of one text, number by number."""
    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    n, total = shape.hidden, 0.0
    h, given = [0.0] * n, shape.begin
    for y in text.tolist():
        row = p["table"][given].tolist()
        g = [sum(h[i] * float(p["recur"][i, j]) for i in range(n)) for j in range(3 * n)]
        z = [sigmoid(row[j] + g[j]) for j in range(n)]
        r = [sigmoid(row[n + j] + g[n + j]) for j in range(n)]
        new = [math.tanh(row[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
        h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(n)]

        def share(weights, bias, at):
            logits = [sum(h[i] * float(w[i]) for i in range(n)) + float(b) for w, b in zip(weights, bias)]
            return logits[at] - math.log(sum(map(math.exp, logits)))

        c = min(y // shape.members, shape.classes)
        total += share(p["to_class"].T, p["class_bias"], c)
        if c < shape.classes:
            total += share(p["to_word"][c], p["word_bias"][c], y - c * shape.members)
        given = y
    return total


def test_scores_equal_a_scalar_forward_pass():
    shape, rng = gru.Shape(4, 3, 5, 8), np.random.default_rng(7)
    p = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in gru.initial(shape, np.full(12, 1 / 15), 0.2).items()}
    texts = [rng.integers(0, 20, n).astype(np.int32) for n in (1, 40, 3, 17)]
    got = gru.score_texts(p, shape, texts, n_lanes=3, steps=4)
    assert np.allclose(got, [scalar_score(p, shape, t) for t in texts], atol=1e-3)


def test_own_words_grow_with_the_distinct_ones():
    sides = [gru.Shape.of(n, 10**12).classes for n in (0, 1, 100, 2_000, 2_304, 10**9)]
    assert sides == [4, 4, 10, 45, 48, 48] and gru.Shape.of(2_000, 10**12).words >= 2_000
    # Few tokens to learn from: fewer own words.
    assert gru.Shape.of(10**9, 50_000).words == 100


def _corpus():
    random.seed(3)
    words = [[f"{a}{i}" for i in range(30)] for a in "ab"]
    rows = []
    for i in range(300):
        own = words[i % 2]
        rows.append((i, " ".join(random.choice(own) for _ in range(random.randint(5, 60))) + f" Rare{i % 97}"))
    return rows


def test_counts_and_scores(spark):
    rows = [*_corpus(), (None, None), (7, ""), (8, "NEW words \x1c é"), (8, "NEW words \x1c é"), (9, "a1 " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    training = df.filter(~held_out(F.col("doc_id")))
    counts = count_words(training)
    lexicon = build_lexicon(counts, known=40, shape=gru.Shape(8, 8, 8, 16))
    got = score_documents(df, counts, lexicon, fit(training, lexicon, rounds=2)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = sorted((len(w), sum(c[x] > 0 for x in w), round(sum(
        math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)) for w in (tokens(t) for _, t in rows))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert lexicon.total == total
    flags = df.select("doc_id", held_out(F.col("doc_id")).alias("h")).distinct().collect()
    assert all(r.h == held(r.doc_id) for r in flags)
    twins = [r.score for r in got if r.id == 8 and r.n_tokens == 5]
    assert len(twins) == 2 and abs(twins[0] - twins[1]) < 1e-3


def test_model_learns_what_counts_cannot(spark):
    """Texts use one of two word sets; knowing the words so far halves the choice."""
    rows = [(i, t) for k in range(8) for i, t in ((1000 * k + j, t) for j, t in _corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    training = df.filter(~held_out(F.col("doc_id")))
    counts = count_words(training)
    lexicon = build_lexicon(counts, shape=gru.Shape(8, 8, 8, 16))
    scored = score_documents(df, counts, lexicon, fit(training, lexicon, 2, n_lanes=16)).filter(held_out(F.col("id")))
    row = scored.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (row[0] - row[1]) / row[2] > 0.1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], none.schema)
    counts = count_words(none)
    lexicon = build_lexicon(counts)
    params = fit(none, lexicon)
    assert score_documents(none, counts, lexicon, params).count() == 0
    row = score_documents(some, counts, lexicon, params).first()
    assert (row.n_tokens, row.n_known, row.base_score) == (3, 0, 0.0) and row.score < 0


def test_targets_of_a_class_are_one_slice():
    """Rows of a class lie together, so that no class gathers its own; others than own words are in none."""
    shape = gru.Shape(classes=3, members=4, hidden=2, hashed=5)
    y = np.array([11, 0, 5, 14, 3, 5, 12, 8], dtype=np.int32)
    group, order, parts = gru._by_class(shape, y)
    assert group.tolist() == [2, 0, 1, 3, 0, 1, 3, 2]
    assert {c: (y[order[at]].tolist(), member.tolist()) for c, at, member in parts} == {
        0: ([0, 3], [0, 3]), 1: ([5, 5], [1, 1]), 2: ([11, 8], [3, 0])}


def test_exponentials_take_no_second_matrix():
    logits = np.array([[0.0, 1.0], [2.0, 90.0]], dtype=np.float32)
    e, total = gru._exp(logits)
    assert e is logits and np.allclose(total, np.exp([[0, 1], [2, 60]]).sum(axis=1))
