import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from latewise.llm import simhash
from latewise.llm.components import components


def brute(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    random.seed(3)
    for _ in range(60):
        text = "".join(random.choice(["A", "bc", "É", " ", "\n", "\x1c", "\xa0", "d e "]) for _ in range(random.randint(0, 60)))
        assert simhash.fingerprint(text, 4) == brute(text, 4), repr(text)


def brute_components(ids, fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(fps))]


def _links(spark, fps, **options):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    tree = {r.u: r.v for r in components(simhash.near_links(df, 4, **options)).collect()}
    return [tree.get(s, s) for s in (int(np.uint64(f).view(np.int64)) for f in fps)]


def _same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_links_equal_brute_force(spark):
    random.seed(6)
    fps = []
    for _ in range(60):
        center = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 3, 8])):
            center ^= sum(1 << random.randrange(64) for _ in range(random.randint(0, 5)))
            fps.append(center)
    center = random.getrandbits(64)  # a crowd
    fps += [center ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(150)]
    want = brute_components(range(len(fps)), fps, 4)
    assert _same_parts(_links(spark, fps), want)
    # Crowded deals are dealt again and give the same.
    assert _same_parts(_links(spark, fps, dense=5), want)


def test_near_duplicates_with_odd_rows(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:200], "other", *words[201:]]
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (7, None), (3, ""), (None, " ".join(words)),
            (11, "short text"), (11, "short text"), (None, "alone in null"), (20, "x " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute(t or "", 4) for _, t in rows]
    assert got == sorted(zip([i for i, _ in rows], brute_components([i for i, _ in rows], fps, 4)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    shown = df.limit(1).select(simhash.fingerprint_hex(F.lit(-1).cast("long")).alias("h")).first().h
    assert shown == "f" * 16


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = {r.u: r.v for r in components(chain.orderBy(F.rand(1))).collect()}
    assert got == {i: 0 for i in range(1, 200)}
