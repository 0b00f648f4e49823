"""WARC: archives of page captures, written and read by Spark, and transactions assembled from their records.

Writing: each page becomes a request, a response (or a revisit of the response with the same payload) and a metadata
record; request and metadata name the capture in ``WARC-Concurrent-To``. Of equal payloads of ``min_bytes`` or more,
the one with the smallest page id is the response. Records are built as strings and written by the text writer, whose
line separator is the blank line that ends a record; files are gzip streams.

Reading: the text reader streams the files and cuts them where a record's end meets a version line. A payload can
hold those bytes too: a piece shorter than its Content-Length takes the following pieces until it is complete.

Assembly: requests and metadata are joined to captures by their concurrent-to identifier; one nested row each.

Null payloads are empty ones, null urls leave out the target; null page ids have no page-id field and come after any
other id. Every row is a capture with record ids of its own, also rows that repeat others or have no page id; rows that
repeat the page id of a response are responses too, and revisits refer to the first of them. An empty table gives no
rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latewise.llm.work import written

VERSION, CRLF, END = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where a record ends and the next begins.
MARK = (END + VERSION + CRLF).encode()
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _record_id(*parts: Column | str) -> Column:
    """A name-based identifier in the usual grouping."""
    name = F.md5(F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """Header lines and block; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, length), F.lit(END), block)


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 100, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 30_000,
) -> None:
    body = F.coalesce(F.col(payload), F.lit(""))
    # What could end a header line, or was never allowed in a target, is percent-encoded.
    target = F.col(url)
    for bad, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        target = F.replace(target, F.lit(bad), F.lit(code))
    # Row numbers are written with the rows, so that a number stays the same whoever reads it.
    base = written(pages.select(
        F.col(page_id).alias("page_id"), target.alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"),
        F.monotonically_increasing_id().cast("string").alias("row"),
    ))
    first = F.min_by(F.struct("page_id", "row"), F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("first")
    repeated = written(
        base.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    page = F.col("page_id").cast("string")
    rows = base.join(repeated, "digest", "left").withColumns({
        "again": F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")),
        "capture": _record_id("capture", page, F.col("digest"), F.col("row")),
    })
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    again = F.col("again")
    capture = _record([
        ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("capture")), *common,
        ("WARC-Refers-To", F.when(
            again, _record_id("capture", F.col("first.page_id").cast("string"), F.col("digest"), F.col("first.row"))
        )),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("Content-Type", "application/http; msgtype=response"),
    ], F.when(again, http).otherwise(F.concat(http, F.col("body"))))
    request = _record([
        ("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", page, F.col("digest"), F.col("row"))), *common,
        ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", "application/http; msgtype=request"),
    ], F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1" + END)))
    metadata = _record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", page, F.col("digest"), F.col("row"))), *common,
        ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", "application/warc-fields"),
    ], F.concat(F.coalesce(F.concat(F.lit("page-id: "), page, F.lit(CRLF)), F.lit("")),
                F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF)))
    (
        rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


RECORDS = (
    "record_id string, type string, target string, concurrent_to string, refers_to string, stated_digest string, "
    "payload binary, payload_bytes long, payload_digest string, fields map<string,string>"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records; ``payloads=False`` keeps size and digest of each payload, not its bytes."""
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(_Parser(payloads), RECORDS)


class _Parser:
    """Pieces between version lines in, records out."""

    def __init__(self, payloads: bool) -> None:
        self.payloads = payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *((n, pa.string()) for n in ("record_id", "type", "target", "concurrent_to", "refers_to", "stated_digest")),
            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("fields", pa.map_(pa.string(), pa.string())),
        ])
        held: list[bytes] = []
        have = need = 0
        for batch in batches:
            out = []
            for piece in batch.column(0).to_pylist():
                have += len(piece) + (len(MARK) if held else 0)
                held.append(piece)
                # A long payload with many marks is joined once, when all its pieces are there.
                if have >= need:
                    found, rest, need = self._complete(held[0] if len(held) == 1 else MARK.join(held))
                    out += found
                    held, have = ([rest], len(rest)) if rest else ([], 0)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            raise ValueError(f"a record ends before its Content-Length: {held[0][:200]!r}")

    def _complete(self, raw: bytes) -> tuple[list[dict], bytes, int]:
        """The complete records at the begin, what is left of an incomplete one, and the length that would complete it.

        The reader can miss a mark where its buffer ends amid blank lines, so a piece can hold several records.
        """
        found = []
        while raw:
            head, _, block = raw.removeprefix(MARK[len(END) :]).partition(END.encode())
            header = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split(CRLF))
            length = int(header["Content-Length"])
            if len(block) < length:
                return found, raw, len(raw) - len(block) + length
            found.append(self._record(header, block[:length]))
            raw = block[length:].removeprefix(END.encode())
        return found, raw, 0

    def _record(self, header: dict[str, str], block: bytes) -> dict:
        kind, payload, fields = header["WARC-Type"], None, None
        if kind == "response":
            payload = block.partition(END.encode())[2]
        elif kind == "metadata":
            fields = [tuple(x.split(": ", 1)) for x in block.decode("utf-8", "replace").split(CRLF) if x]
        return {
            "record_id": header["WARC-Record-ID"], "type": kind, "target": header.get("WARC-Target-URI"),
            "concurrent_to": header.get("WARC-Concurrent-To"), "refers_to": header.get("WARC-Refers-To"),
            "stated_digest": header.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
            "payload": payload if self.payloads else None,
            "payload_bytes": None if payload is None else len(payload),
            "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(), "fields": fields,
        }


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, response, request, metadata)."""
    captures = records.filter(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"])

    def beside(kind: str) -> DataFrame:
        return (
            records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
            .dropDuplicates(["concurrent_to"])
            .select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target", "fields").alias(kind))
        )

    nested = captures.select(F.col("record_id").alias("capture_id"), F.struct(
        "type", "target", "refers_to", "stated_digest", "payload", "payload_bytes", "payload_digest"
    ).alias("response"))
    return nested.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")
