import random
import re

import numpy as np

from latewise.llm import minhash


def brute_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=85):
    """(id, size of set, component) by comparing all pairs."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return sorted(((own, len(sets[i]), least.get(root(i)) if sets[i] else own) for i, (own, _) in enumerate(rows)), key=str)


def found(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, digest string")
    return sorted(((r.id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **bounds).collect()), key=str)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"e{random.random()}"
    return " ".join(words)


def corpus():
    """Copies of a few texts with none to many words changed: many similarities around the limit."""
    rows = []
    for _ in range(6):
        base = [f"w{random.randrange(500)}" for _ in range(random.choice([12, 60, 150]))]
        rows += [edited(base, random.choice([0, 0, 1, 1, 2, 3, 4])) for _ in range(25)]
    return [(i, t) for i, t in enumerate(random.sample(rows, len(rows)))]


def test_shingles_equal_brute_force():
    random.seed(4)
    for _ in range(80):
        text = "".join(random.choice(["A", "bc", "É", " ", "\n", "\x1c", "\xa0", "d e "]) for _ in range(random.randint(0, 60)))
        assert len(minhash.shingle_sets([text], 5, minhash.WordHashes())[0]) == len(brute_set(text))


def test_bands_agree_in_proportion_to_similarity():
    random.seed(7)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] + [edited(base, 6) for _ in range(40)]
    sets = minhash.shingle_sets(texts, 5, minhash.WordHashes())
    bands = minhash.band_values(sets)
    got, want = [], []
    for s, row in zip(sets[1:], bands[1:]):
        common = len(np.intersect1d(sets[0], s))
        got.append((row == bands[0]).mean())
        want.append((common / (len(s) + len(sets[0]) - common)) ** 5)
    assert abs(np.mean(got) - np.mean(want)) < 0.05
    assert (minhash.band_values([sets[0][:0]]) == 0).all()


def test_components_equal_brute_force(spark):
    random.seed(11)
    rows = corpus()
    want = brute(rows)
    assert found(spark, rows) == want
    # Crowded buckets are dealt again and then go by blocks, with the same result.
    assert found(spark, rows, max_weight=400, max_nodes=4) == want


def test_links_between_parts():
    random.seed(2)
    sets = minhash.shingle_sets([t for _, t in corpus()], 5, minhash.WordHashes())
    names = [minhash.digest(s) for s in sets]
    kept = minhash.links_between(names, sets, 85)
    assert len(kept) < len(sets)
    for i, j in kept:
        common = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common)
    assert minhash.links_between(names[:1] * 3, sets[:3], 85) == []


def test_odd_rows(spark):
    words = [f"w{i}" for i in range(300)]
    long = " ".join(f"v{i % 7919}" for i in range(120_000))
    rows = [(5, " ".join(words)), (2, edited(words, 1)), (9, " ".join(words)), (7, None), (3, ""), (3, ""), (None, " ".join(words)),
            (11, "short text"), (11, "Short  TEXT"), (12, "short texts"), (None, "alone in null"), (None, None), (20, long), (21, long + " end")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    only_empty = [(1, ""), (2, None)]
    assert found(spark, only_empty) == brute(only_empty)
