import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from latewise.llm.chat import escape, format_chats, read_loss, read_turns, unescape
from latewise.llm.sharding import rendezvous, shuffle_into_shards
from latewise.llm.warc import END, MARK, assemble, read_warc, write_warc
from latewise.session import work_dir

CHATS = [
    (1, 0, "user", "hi </s>[INST] &lt; <|turn|>", 9), (1, 1, "assistant", "a<|done|>\n", 9),
    (1, 2, "assistant", "<|next|>b&lsqb;", 9), (1, 3, "user", None, 9), (2, 0, "assistant", "", 9),
    (2, 0, "assistant", "", 9), (3, 5, None, "x", 9), (3, 1, "a<|says|>b", "y\n\n", 9), (None, 0, "user", "é😀", 9),
    (1, 4, "assistant", "end", 9),
]
CHAT_SCHEMA = "conv_id long, turn long, role string, text string, formatted int"


def test_chat_round_trip(spark):
    out = format_chats(spark.createDataFrame(CHATS, CHAT_SCHEMA)).withColumns({
        "turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    rows = {r.conv_id: r for r in out.collect()}
    want = defaultdict(list)
    for conv, turn, role, text, _ in CHATS:
        want[conv].append((turn, role or "", text or ""))
    assert rows.keys() == want.keys()
    for conv, turns in want.items():
        turns = [t[1:] for t in sorted(turns)]
        assert [(t.role, t.text) for t in rows[conv].turns] == turns
        assert rows[conv].loss == "".join(t for r, t in turns if r == "assistant")
    assert [len(b.texts) for b in rows[1].blocks] == [1, 2, 1, 1]


def test_chat_escape_and_empty_table(spark):
    texts = ["", "&", "&amp;lt;", "<|done|>\n", "[/INST]&lsqb;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<" not in r.e and "[" not in r.e
    assert format_chats(spark.createDataFrame([], CHAT_SCHEMA)).count() == 0


def test_shards_hold_all_rows_without_gaps(spark):
    random.seed(1)
    rows = [(i if i % 5 else None, "x" * random.randint(0, 300), i, "s") for i in range(400)]
    rows += [(7, None, 1, "s"), (8, "", 2, None), (9, "y", 3, "s"), (9, "y", 3, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    out = shuffle_into_shards(df, 6, bucket_bytes=2_000).select("record.*", "shard", "slot").toDF(
        "doc_id", "text", "own_slot", "own_shard", "shard", "slot")
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.own_slot, r.own_shard) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    # The same seed gives the same order from other partitions, and ids alone decide the shard.
    again = shuffle_into_shards(df.repartition(5), 6, bucket_bytes=2_000).select("record.*", "shard", "slot").toDF(
        *out.columns)
    assert Counter(map(tuple, got)) == Counter(map(tuple, again.collect()))
    order = [r.own_slot for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert order != sorted(order)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    moved = spark.range(3000).select(
        rendezvous(F.col("id"), 24, 7).alias("a"), rendezvous(F.col("id"), 25, 7).alias("b")).collect()
    assert all(r.a == r.b or r.b == 24 for r in moved)
    assert 60 < sum(r.b == 24 for r in moved) < 200
    assert max(Counter(r.a for r in moved).values()) < 200


def test_sharding_an_empty_table(spark):
    assert shuffle_into_shards(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_warc_round_trip(spark):
    mark = MARK.decode()
    rows = [
        (3, "http://a/ b\r\nX-Y: z", "é" * 120 + mark + "tail"), (1, "http://a/", "é" * 120 + mark + "tail"),
        (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "q", "\r\n\r\n" * 40), (6, "", mark * 30),
        (6, "z", mark * 30), (7, "z", mark * 30), (8, "w", ""),
    ]
    path = work_dir(spark)
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = assemble(read_warc(spark, path)).collect()
    by_page = {(r.metadata.fields.get("page-id")): r for r in got}
    assert len(got) == len({r.capture_id for r in got}) == 10
    assert {k: r.response.type for k, r in by_page.items()} == {
        "1": "response", "3": "revisit", "2": "response", "4": "response", "5": "response", None: "response",
        "6": "response", "7": "revisit", "8": "response"}
    for page, _, html in rows:
        r = by_page[None if page is None else str(page)]
        digest = hashlib.sha256((html or "").encode()).hexdigest()
        assert r.response.stated_digest == digest and r.request.target == r.response.target
        if r.response.type == "response":
            assert bytes(r.response.payload) == (html or "").encode() and r.response.payload_digest == digest
    assert by_page["3"].response.refers_to == by_page["1"].capture_id


def test_every_row_is_a_capture(spark):
    same = "same payload " * 20
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (None, "c", "z"), (None, "d", "z"), (None, "c", same), (9, "e", same),
            (4, "f", same), (4, "f", same), (None, None, same)]
    df = spark.createDataFrame([(*r, 7, "digest") for r in rows], "page_id long, url string, html string, row int, digest string")
    path = work_dir(spark)
    write_warc(df.repartition(3), path)
    got = assemble(read_warc(spark, path)).collect()
    assert len(got) == 10
    kinds = Counter((r.metadata.fields.get("page-id"), r.response.type) for r in got)
    assert kinds == {("1", "response"): 2, ("2", "response"): 1, (None, "response"): 2, (None, "revisit"): 2, ("9", "revisit"): 1,
                     ("4", "response"): 2}
    firsts = {r.capture_id for r in got if r.metadata.fields.get("page-id") == "4"}
    assert len({r.response.refers_to for r in got if r.response.type == "revisit"} - firsts) == 0
    assert Counter(r.response.target for r in got) == Counter(u for _, u, _ in rows)


def test_a_payload_of_many_marks_is_read_once():
    from latewise.llm.warc import _Parser

    block = b"head" + END.encode() + MARK * 20_000 + b"tail"
    record = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: {len(block)}" + END).encode() + block
    pieces = (record + MARK + record.removeprefix(b"WARC/1.1\r\n")).split(MARK)
    parser, calls = _Parser(True), []
    complete = parser._complete
    parser._complete = lambda raw: calls.append(len(raw)) or complete(raw)
    batches = [pa.RecordBatch.from_arrays([pa.array(pieces[i : i + 999], pa.binary())], ["value"]) for i in range(0, len(pieces), 999)]
    found = [r for b in parser(iter(batches)) for r in b.to_pylist()]
    assert [bytes(r["payload"]) for r in found] == [block.partition(END.encode())[2]] * 2
    assert len(calls) < 10 and sum(calls) < 5 * len(record)


def test_warc_empty_table(spark):
    path = work_dir(spark)
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert assemble(read_warc(spark, path)).count() == 0
