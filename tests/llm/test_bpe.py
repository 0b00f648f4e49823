import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from latewise.llm.bpe import Encoder, Tokenizer, read_ranks

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_equal_the_library():
    random.seed(1)
    encoder = Encoder(RANKS, PATTERN)
    for _ in range(300):
        text = "".join(random.choice("ab \n\t'sreé1.  z\x1c\xa0😀") for _ in range(random.randint(0, 400)))
        assert encoder(text).tolist() == LIBRARY.encode_ordinary(text), repr(text)
    for text in ("ab" * 5000 + "x" * 3000, " " * 5000 + "a", "1" * 4000, "<|endoftext|>", "thisisoneverylongword" * 9):
        assert encoder(text).tolist() == LIBRARY.encode_ordinary(text)


def _rows():
    random.seed(2)
    rows = []
    for i in range(60):
        letters = random.choice(["ab \n\t'sreé1.  z", "ab", " \n", "a'", "abc  \n\n're"])
        rows.append((i % 40, "".join(random.choice(letters) for _ in range(random.choice([0, 5, 60, 200, 1000])))))
    return [*rows, (None, None), (7, ""), (8, "x" * 500), (8, "x" * 500)]


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 20), (64, 9), (32_768, 1_024)])
def test_stitched_chunks_equal_the_library(spark, chunk, overlap):
    rows = _rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    coder = Tokenizer(RANKS, PATTERN, chunk, overlap)
    got = coder.decode(coder.encode(df)).withColumn("back", F.decode("decoded", "UTF-8")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.id, list(r.ids), r.back) for r in got), key=key) == sorted(
        ((i, LIBRARY.encode_ordinary(t or ""), t or "") for i, t in rows), key=key)


def test_empty_table_and_bad_overlap(spark):
    coder = Tokenizer(RANKS, PATTERN)
    assert coder.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        Tokenizer(RANKS, PATTERN, 10, 10)


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 20), (32_768, 1_024)])
def test_round_trip_in_one_worker(spark, chunk, overlap):
    """Ids and bytes as of both operators one after the other; a text of one chunk passes through one worker only."""
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Tokenizer(RANKS, PATTERN, chunk, overlap).round_trip(df)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.id, list(r.ids), bytes(r.decoded)) for r in found.collect()), key=key) == sorted(
        ((i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("MapInArrow encode")[1].count("MapInArrow decode") <= 1 and "MapInArrow decode" not in plan.split("MapInArrow encode")[0].split("Union")[0]
