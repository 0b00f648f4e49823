import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from latewise.llm.quality import N_BUCKETS, base_counts, buckets, fit_ratio, fit_threshold, nth_smallest, score_quality, trusted_ids, wrongly_passed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_base_counts():
    random.seed(4)
    for _ in range(400):
        text = "".join(random.choice(["a", "b", "é ", " ", "\n", "\n\n", "#", "|", "\x0b", "\x1c", "\xa0", "c d "])
                       for _ in range(random.randint(0, 80)))
        assert base_counts(text.encode()) == brute_counts(text), repr(text)


def brute_score(docs, trusted, prior=500_000):
    counts = np.zeros((2, N_BUCKETS))
    for i, text in docs:
        got = buckets(np.frombuffer((text or "").encode(), dtype=np.uint8))
        np.add.at(counts[0], got, 1)
        if i in trusted:
            np.add.at(counts[1], got, 1)
    raw = (counts[0] + 1) / (counts[0].sum() + N_BUCKETS)
    ratio = np.log((counts[1] + prior * raw) / (counts[1].sum() + prior) / raw)
    out = []
    for _, text in docs:
        got = buckets(np.frombuffer((text or "").encode(), dtype=np.uint8))
        out.append(float(ratio[got].mean()) if len(got) else 0.0)
    return out


def test_scores_equal_brute_force(spark):
    docs = [(i, ("good words here " * 20 if i % 3 else "jun*** k$$$ " * 30) + str(i)) for i in range(60)]
    docs += [(None, None), (100, ""), (101, "abc"), (102, "é" * 5000), (5, docs[5][1])]
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (3, None, 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {r[0] for r in trusted_ids(lab, 1000).collect()}
    assert trusted == {i for i in range(40) if i % 3 and i != 1}
    out = score_quality(df, fit_ratio(df, lab)).select("record.doc_id", "record.text", "score", "kept", "base_failed")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", round(r.score, 9)) for r in out.collect())
    want = sorted((d is None, d or 0, t or "", round(s, 9)) for (d, t), s in zip(docs, brute_score(docs, trusted)))
    assert got == want
    # With so little trusted text only a small prior tells junk apart.
    sharp = score_quality(df, fit_ratio(df, lab, prior=100)).select("record.doc_id", "score")
    assert all((r.score > -0.15) == (r.doc_id % 3 > 0) for r in sharp.filter("doc_id < 60 and doc_id != 5").collect())


def test_no_labels_and_no_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not fit_ratio(none, lab).any()
    assert score_quality(none, fit_ratio(none, lab)).count() == 0
    some = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "a b " * 40)], none.schema)
    kept = {r[0]: r[1] for r in score_quality(some, fit_ratio(some, lab)).select("record.doc_id", "kept").collect()}
    assert kept == {1: True, 2: False}


def _rejected(spark, folder):
    """op3 as registered, over a small corpus: (clean, toxic, junk) ids that the ratio alone rejects."""
    from latewise.llm.registered.quality import op3

    random.seed(8)
    stems = {"clean": "bcdfg", "toxic": "vwxzq", "junk": "#$%&*"}

    def text(kind):
        return " ".join("".join(random.choice(stems[kind]) + random.choice("aeiou") for _ in range(3)) for _ in range(80))

    kinds = ["clean"] * 120 + ["toxic"] * 30 + ["junk"] * 10
    docs = [(i, text(kind)) for i, kind in enumerate(kinds)]
    # Half of each kind has labels; toxic documents are of quality 1.
    labels = [(i, int(kind != "junk"), int(kind == "toxic")) for i, kind in enumerate(kinds) if i % 2]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = op3(spark, str(folder)).filter("not base_failed and not kept").select("doc_id").collect()
    return [{r.doc_id for r in out if kinds[r.doc_id] == kind} for kind in stems]


def test_toxic_documents_are_not_trusted(spark, tmp_path):
    lab = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0), (3, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in trusted_ids(lab, 10).collect()] == [1]
    clean, toxic, _ = _rejected(spark, tmp_path)
    assert toxic == set(range(120, 150)) and len(clean) <= 12


def test_little_trusted_text_rejects_junk_with_the_production_parameters(spark, tmp_path):
    clean, _, junk = _rejected(spark, tmp_path)
    assert junk == set(range(150, 160)) and len(clean) <= 12


def test_threshold_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fit_threshold(some, lab, fit_ratio(some, lab, hold_out=True)) == -0.15


def test_every_trusted_document_counts(spark):
    lab = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert trusted_ids(lab).count() == 20_500
    some = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    assert fit_ratio(some, lab).any()


def test_nth_smallest_without_collecting_all(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=800), np.full(300, 0.25), [1e9, -1e9]])
    scores = spark.createDataFrame([(float(v),) for v in values], "score double")
    for place in (0, 11, 400, 600, len(values) - 1):
        assert nth_smallest(scores, place, most=20, cells=10) == np.sort(values)[place]


def test_texts_stay_where_they_are_read(spark):
    from latewise.llm.membership import filter_of
    from latewise.llm.quality import _hashed

    docs = [(i, f"text number {i} " * 5) for i in range(400)] + [(None, "no id"), (7, "again"), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 4)], "doc_id int, quality int, toxic int")
    hashed, ids = _hashed(df, trusted_ids(lab))
    moved = wrongly_passed(hashed, ids, filter_of(ids, "hash", 25), 25).count()
    assert moved < 5  # all 403 texts were shuffled where ids were too many to broadcast
    # Filters that let nearly everything through, or nothing wrong, give the same counts and the same threshold.
    ratios = [fit_ratio(df, lab, prior=100, hold_out=True, bits=bits) for bits in (15, 25)]
    packed = filter_of(ids, "hash", 15)
    packed[:] = 255
    assert wrongly_passed(hashed, ids, packed, 15).count() == 302
    assert ratios[0].any() and np.array_equal(*ratios)
    assert fit_threshold(df, lab, ratios[0], bits=15) == fit_threshold(df, lab, ratios[0])
