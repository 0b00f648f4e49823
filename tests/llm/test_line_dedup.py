import random

import pytest
from pyspark.sql import functions as F

from latewise.llm.line_dedup import dedup_lines, probes, segments, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(text, edits, letters):
    text = list(text)
    for _ in range(edits):
        kind, at = random.choice("ids"), random.randrange(len(text) + 1)
        if kind == "i":
            text.insert(at, random.choice(letters))
        elif text and kind == "d":
            text.pop(min(at, len(text) - 1))
        elif text:
            text[min(at, len(text) - 1)] = random.choice(letters)
    return "".join(text)


def test_banded_distance():
    random.seed(5)
    for _ in range(3000):
        letters = random.choice(["ab", "abcdefghé"])
        a = "".join(random.choice(letters) for _ in range(random.randint(0, 25)))
        b, most = changed(a, random.randint(0, 4), letters), random.choice([0, 1, 2, 3])
        assert within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_near_lines_share_a_key():
    random.seed(6)
    for _ in range(2000):
        most = random.choice([1, 2, 3])
        a = "".join(random.choice("ab") for _ in range(random.randint(4, 30)))
        b = changed(a, random.randint(0, most), "ab")
        if len(b) < 4:
            continue
        (ia, pa), (ib, pb) = (
            ({(len(s), i, s[at : at + n]) for i, (at, n) in enumerate(segments(len(s), most))},
             {(n, i, s[at : at + size]) for n, i, at, size in probes(len(s), most)}) for s in (a, b))
        assert ia & ib or ia & pb or ib & pa, (a, b)


def brute(docs, most, min_chars):
    seen, out = [], {}
    for doc, content, text in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        keep, equal, near = [], 0, 0
        lines = [] if text is None else text.split("\n")
        for line in lines:
            if len(line) < min_chars:
                keep.append(line)
                continue
            if line in seen:
                equal += 1
                continue
            if any(distance(s, line) <= most for s in seen if abs(len(s) - len(line)) <= most):
                near += 1
            else:
                keep.append(line)
            seen.append(line)
        out[doc, content] = None if text is None else "\n".join(keep), len(lines), equal, near
    return out


@pytest.mark.parametrize("dense", [50_000, 5])
def test_equal_brute_force(spark, dense):
    random.seed(7)
    base = ["".join(random.choice("abcd ") for _ in range(random.randint(5, 14))) for _ in range(25)]
    rows = []
    for i in range(90):
        lines = [changed(random.choice(base), random.choice([0, 0, 1, 2, 3]), "abcd ") for _ in range(random.randint(0, 6))]
        rows.append((i % 70 if i % 9 else None, "\n".join(lines)))
    rows += [(3, None), (3, ""), rows[5], rows[5], (80, "\n".join(["x" * 900, "x" * 899, "y", "x" * 900]))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kept_text int")
    hashed = df.select("doc_id", F.xxhash64("text").alias("content"), "text").collect()
    want = brute([tuple(r) for r in hashed], 2, 8)
    out = dedup_lines(df, 2, 8, dense=dense).withColumn("content", F.xxhash64("record.text")).collect()
    assert sorted(r.record.kept_text for r in out) == list(range(len(rows)))
    for r in out:
        assert want[r.record.doc_id, r.content] == (r.kept_text, r.n_lines, r.n_equal, r.n_near)
    assert sum(r.n_near for r in out) > 20


def test_a_crowd_of_alike_lines(spark):
    rows = [(i, f"the same long line with the number {i:04d} in it") for i in range(500)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r.record.doc_id for r in out if r.kept_text}
    # Four digits differ in at most two places from an earlier number, unless the number is the first.
    want = {i for i in range(500) if not any(distance(f"{i:04d}", f"{j:04d}") <= 2 for j in range(i))}
    assert kept == want


def test_short_copies_go_in_the_query_and_the_stage(spark, tmp_path):
    import corpus_pipeline
    from latewise.llm.registered.line_dedup import op2

    rows = [(1, "Les.\n\nAnd ornd."), (2, "Les.\n\nown\nLes."), (3, "  \n\nLes!\nAnd ornd."), (4, None)]
    given = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # Blank lines stay, and a short line that differs by an edit does.
    want = {1: "Les.\n\nAnd ornd.", 2: "\nown", 3: "  \n\nLes!", 4: None}
    out = corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == want
    counts = {r.doc_id: (r.n_lines, r.n_equal, r.n_near) for r in op2(spark, str(tmp_path)).collect()}
    assert counts == {1: (3, 0, 0), 2: (4, 2, 0), 3: (4, 1, 0), 4: (0, 0, 0)}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
