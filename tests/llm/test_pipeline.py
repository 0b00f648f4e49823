import hashlib
import random
from functools import partial

import corpus_pipeline
import public_tokenizers
import tiktoken
from latewise.llm.bpe import read_ranks
from latewise.llm.quality import fit_ratio
from latewise.llm.work import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    random.seed(9)
    stems = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "io", "ou", "an", "er")]

    def line(n=12):
        return " ".join(random.choice(stems) + random.choice(stems) for _ in range(n))

    def clean(lines=8):
        return "\n".join(line() for _ in range(lines))

    passage, shared = line(30), line(60)
    docs = {i: clean() for i in range(60)}
    docs[60] = " ".join(w + random.choice(["***", "$$$", "###"]) for w in line(100).split())
    docs[61] = "too short"
    docs[62] = "\n".join([clean(4), passage, clean(4)])
    docs[63], docs[64] = docs[5], docs[5].replace(docs[5].split()[30], "other")
    docs[65], docs[66] = clean(5) + "\n" + shared, shared + "\n" + clean(6)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(70, None, None, None, None), (None, "", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i != 60), 0) for i in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, shared


def test_stages(spark, tmp_path, monkeypatch):
    # So little trusted text says enough only where the raw shares weigh little.
    monkeypatch.setattr(corpus_pipeline, "fit_ratio", partial(fit_ratio, prior=1000))
    docs, shared = _tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, table, str(tmp_path)))
        assert out.columns == table.columns and out.dtypes == table.dtypes
        kept.append({r.doc_id: r for r in out.collect()})
        table = out
    quality, lines, near, clean = kept
    assert set(quality) == set(docs) - {60, 61}
    assert set(lines) == set(quality)
    assert shared in lines[65].text and shared not in lines[66].text and lines[63].text == ""
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert all(lines[i].text == docs[i] for i in range(60))
    assert 5 in near and 63 in near and set(range(60)) <= set(near)
    assert set(clean) == set(near) - {62}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in final} == set(clean)
    for r in final:
        ids = library.encode_ordinary(clean[r.doc_id].text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest()


def test_copies_leave_one_document(spark, tmp_path):
    docs, _ = _tables(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 70")
    table = table.unionByName(table.filter("doc_id = 7"))
    out = corpus_pipeline.simhash_near_dedup(spark, table, str(tmp_path))
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 63 not in ids and set(range(60)) <= set(ids)


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path)
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
