"""WARC archives: writing with revisit records, and reading by boundary chains.

Archives are plain WARC/1.0 files. The text writer ends each record with the two line
breaks that the format asks for. The text reader splits files of any size at the version
line; such a line may also stand inside a payload, so every occurrence is a candidate
only. A candidate names its successor by its content length, and pointer jumping from
the start of the file keeps the candidates that are reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, pick

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MOST_PER_FILE = 20_000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", smallest: int = 1000, records_per_file: int = MOST_PER_FILE) -> None:
    """Write one record per row to WARC files under ``path``.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least
    ``smallest`` bytes the one with the largest id is a response, the others revisit it;
    rows that repeat the largest id are all responses, as are rows with a null id. Other
    columns are ignored. Texts with a hot payload are found by a grouped maximum of the
    digest and joined back as ids only.
    """
    rows = pick(pages, id=id_column, url=url_column, html=html_column).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    scratch = Scratch(pages.sparkSession)
    groups = rows.filter(F.col("bytes") >= smallest).groupBy("digest").agg(F.max("id").alias("first"), F.min("id").alias("least"))
    groups = scratch.keep(groups.filter("first <> least").select("digest", "first"))
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") < F.col("first"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page:none>"))),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")), F.lit("")),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Payload-Length", F.col("bytes")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _line("WARC-Refers-To", urn(F.col("first"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _scanned(read: DataFrame, payloads: bool, whole: bool) -> DataFrame:
    """Each piece between version lines with its place in the split, header, length, and digest.

    Where the whole record lies in the piece its payload is digested here, so that payloads
    are not shuffled. ``rest`` keeps the pieces of records that go on beyond theirs (or, with
    ``whole``, all pieces).
    """
    kind = "file string, block long, local long, size long, header string, head long, length long, digest string, payload_bytes long, rest string, payload string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, goes_on = 0, None, 0
        for batch in batches:
            rows = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != place:
                    at, place, goes_on = 0, (file, block), 0
                raw = value.encode()
                size = len(raw) + len(MAGIC)
                header, head, length, digest, n, rest, payload = _parsed(raw, payloads)
                if length is not None and head + len(END) + length > len(raw):
                    goes_on = max(goes_on, at + head + len(END) + length)
                if whole or at < goes_on:
                    rest = raw.decode()
                rows.append((file, block, at, size, header, head, length, digest, n, rest, payload))
                at += size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in kind.split(", ")]
    return read.mapInArrow(run, kind)


def _parsed(raw: bytes, payloads: bool) -> tuple:
    """header, head, length, digest, payload_bytes, rest, payload of a piece; a false record may end inside a character."""
    head = raw.find(END.encode())
    found = re.search(rb"(?:^|\r\n)Content-Length: (\d{1,15})(?:\r\n|$)", raw[:head]) if head >= 0 else None
    if not found:
        return None, None, None, None, None, raw.decode(), None
    length = int(found[1])
    block = raw[head + len(END) : head + len(END) + length]
    header = raw[:head].decode()
    if len(block) < length:
        return header, head, length, None, None, raw.decode(), None
    digest, size, payload = _payload(header, block, payloads)
    # a quoted record inside a payload is followed by more than the two line breaks of its end
    rest = None if raw[head + len(END) + length :] in (END.encode(), b"") else raw.decode()
    return header, head, length, digest, size, rest, payload


def _payload(header: str, block: bytes, payloads: bool) -> tuple:
    if "WARC-Type: response" not in header:
        return None, None, None
    body = block.partition(END.encode())[2]
    return hashlib.sha1(body).hexdigest(), len(body), body.decode(errors="replace") if payloads else None


def candidates(spark: SparkSession, path: str, scratch: Scratch, payloads: bool = False, whole: bool = False) -> DataFrame:
    """Every version line of the archives with its offset and that of its successor.

    Offsets are sums of the bytes before: of the pieces in a split, then of the splits of a
    file. ``next`` is null where no header with a content length follows.
    """
    read = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = scratch.keep(_scanned(read, payloads, whole))
    splits = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    held = splits.groupBy("file").agg(F.collect_list(F.struct("block", "bytes")).alias("held"))
    earlier = lambda x: F.aggregate(F.filter("held", lambda y: y["block"] < x["block"]), F.lit(0).cast("long"), lambda n, y: n + y["bytes"])
    starts = held.select("file", F.explode(F.transform("held", lambda x: F.struct(x["block"].alias("block"), earlier(x).alias("before")))).alias("s")).select("file", "s.*")
    # a piece begins after a version line, so its record begins that line earlier
    offset = F.col("before") + F.col("local") - len(MAGIC)
    placed = pieces.join(scratch.keep(starts), ["file", "block"]).withColumn("offset", offset).filter("offset >= 0")
    block_at = F.col("offset") + len(MAGIC) + F.col("head") + len(END)
    return placed.withColumn("next", block_at + F.col("length") + len(END)).drop("block", "before", "local")


def reached(points: DataFrame, scratch: Scratch) -> DataFrame:
    """``file, offset`` of the candidates on the chain from offset 0, by pointer jumping.

    Each round doubles the length of every jump and passes the mark along it, so the
    number of rounds is the logarithm of the longest chain.
    """
    chain = scratch.keep(points.select("file", "offset", "next", (F.col("offset") == 0).alias("mark")))
    longest = chain.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while True:
        to = chain.select("file", F.col("next").alias("offset")).where("mark and next is not null").distinct().withColumn("hit", F.lit(True))
        far = chain.select("file", F.col("offset").alias("next"), F.col("next").alias("beyond"))
        new = chain.join(to, ["file", "offset"], "left").join(far, ["file", "next"], "left")
        new = scratch.keep(new.select("file", "offset", F.col("beyond").alias("next"), (F.col("mark") | F.coalesce("hit", F.lit(False))).alias("mark")))
        scratch.drop(chain)
        chain = new
        steps *= 2
        if steps > longest:
            return chain.filter("mark").select("file", "offset")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The verified records: ``file, offset, record_type, id, url, digest, payload_bytes, refers_to, payload``.

    Payloads that hold version lines are put together from their pieces. A revisit's
    payload is null; its length and digest are those of the record it refers to. Without
    ``payloads`` the texts stay in the tasks that read them and the column is null.
    """
    scratch = Scratch(spark)
    pieces = scratch.keep(candidates(spark, path, scratch, payloads))
    true = scratch.keep(reached(pieces, scratch).withColumn("on_chain", F.lit(True)))
    marked = scratch.keep(pieces.join(true, ["file", "offset"], "left"))
    heads = marked.filter("on_chain")
    # records that a version line cuts: their other pieces lie before the next record
    spans = heads.filter("rest is not null and next is not null").select("file", F.col("offset").alias("record"), "next")
    cut = F.struct(F.lit(0).alias("order"), F.col("record"), F.col("next")).alias("own")
    others = marked.filter("on_chain is null").select("file", "offset")
    run = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    belongs = (
        others.withColumn("own", F.lit(None).cast("struct<order:int,record:bigint,next:bigint>"))
        .unionByName(spans.select("file", F.col("record").alias("offset"), cut))
        .withColumn("last", F.last("own", ignorenulls=True).over(run))
        .filter("own is null and last is not null and offset < last.next")
        .select("file", "offset", F.col("last.record").alias("record"))
    )
    tails = marked.filter("on_chain is null").join(scratch.keep(belongs), ["file", "offset"])
    tails = scratch.keep(tails.select("file", "record", "offset", "rest"))
    if not tails.filter("rest is null").isEmpty():
        # a quoted record in a split after the one where its payload begins: read again
        again = candidates(spark, path, scratch, whole=True).select("file", "offset", F.col("rest").alias("again"))
        tails = tails.join(again, ["file", "offset"], "left").select("file", "record", "offset", F.coalesce("rest", "again").alias("rest"))
    first = heads.join(spans.select("file", F.col("record").alias("offset")), ["file", "offset"]).select("file", F.col("offset").alias("record"), "offset", "rest")
    whole = first.union(tails).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "rest"))).alias("p"))
    whole = whole.select("file", F.col("record").alias("offset"), F.array_join(F.transform("p", lambda x: x["rest"]), MAGIC).alias("raw"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_parsed(raw.encode(), payloads) for raw in batch.column("raw").to_pylist()]
            parts = [pa.array([r[k] for r in rows], t) for k, t in ((3, pa.string()), (4, pa.int64()), (6, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("offset"), *parts], ["file", "offset", "digest2", "bytes2", "payload2"])

    mended = whole.mapInArrow(assemble, "file string, offset long, digest2 string, bytes2 long, payload2 string")
    records = heads.filter("next is not null").join(mended, ["file", "offset"], "left")

    def field(pattern: str) -> Column:
        found = F.regexp_extract("header", rf"(?:^|\r\n){pattern}(?:\r\n|$)", 1)
        return F.when(found != "", found)

    return records.select(
        "file",
        "offset",
        field("WARC-Type: ([a-z]+)").alias("record_type"),
        field("WARC-Record-ID: <urn:page:(-?[0-9]+)>").cast("long").alias("id"),
        field("WARC-Target-URI: ([^\r\n]*)").alias("url"),
        F.coalesce("digest", "digest2", field("WARC-Payload-Digest: sha1:([0-9a-f]+)")).alias("digest"),
        F.coalesce("payload_bytes", "bytes2", field("WARC-Payload-Length: ([0-9]+)").cast("long")).alias("payload_bytes"),
        field("WARC-Refers-To: <urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.coalesce("payload", "payload2").alias("payload"),
    )
