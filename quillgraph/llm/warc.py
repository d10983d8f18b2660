"""WARC archives with revisit records for repeated payloads (operator 10).

Only headers (page id, url, payload digest and size) are shuffled to find the first page of every payload, and revisit
records are made of them alone.  Responses are the pages left when the revisits' page ids and digests are taken out:
these are broadcast up to a checked number; beyond it, that one join moves the payloads.  Archives are written by Spark's
text writer, whose line separator is the blank line pair that ends a WARC record, compressed by file.  A running sum of
the records' sizes in each task tells when a file is full, so no file grows beyond its bytes, however sizes are spread;
they are read back as streams, following each record's Content-Length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_ROWS, null_to_empty, shared_path, table, written

VERSION = "WARC/1.1"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of blocks that are read before their rows are passed on.
BATCH_BYTES = 16 << 20
READ_SCHEMA = (
    "record_id string, page_id long, record_type string, target_uri string, refers_to_record string, refers_to long, "
    "payload_digest string, payload_bytes long, payload string"
)


def resolve_revisits(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """The original of every payload held by several records: ``payload_digest`` and the smallest ``page_id``.

    ``headers``: page_id, payload_digest, payload_bytes.  Payloads under ``least_bytes`` have no original.  The
    aggregation combines before it shuffles, so a payload with a third of all records is no burden.
    """
    return (
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )


def record_id(page_id: Column, digest: Column) -> Column:
    """A URN that the page and its payload decide."""
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def warc_record(kind: str, date: str, refers: Column, block: Column) -> Column:
    """A record of the columns ``page_id``, ``url`` and ``payload_digest``, without its closing blank lines."""
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "),
        record_id(F.col("page_id"), F.col("payload_digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nX-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        refers,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    ).alias("value")


def page_headers(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` (without line ends), ``body``, ``payload_digest`` and ``payload_bytes``."""
    body = null_to_empty("html")
    return pages.select(
        "page_id",
        F.regexp_replace(null_to_empty("url"), "[\r\n]+", " ").alias("url"),
        body.alias("body"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def warc_records(pages: DataFrame, least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """WARC records (strings without their closing blank lines), one for each row of ``pages`` (page_id, url, html).

    The smallest page_id with a payload of at least ``least_bytes`` bytes is the response; rows with the same payload
    and another page_id (or none) are revisits of it.  Rows that repeat the smallest page_id are responses too, as are
    payloads whose page_ids are all null.  A null html is an empty payload; line ends in a url become spaces; a null url
    is empty; other columns are ignored.
    """
    full = page_headers(pages)
    headers = written(full.drop("body"), "warc-headers")
    joined = headers.join(resolve_revisits(headers, least_bytes), "payload_digest")
    revisits = written(joined.where("NOT page_id <=> original"), "warc-revisits", fewer=4)
    gone = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
    if gone.count() <= SENT_ROWS:
        gone = F.broadcast(gone)
    else:
        gone = gone.distinct()
    responses = full.join(gone, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left_anti")
    refers = F.concat(
        F.lit("\r\nWARC-Refers-To: "),
        record_id(F.col("original"), F.col("payload_digest")),
        F.lit("\r\nX-Refers-To-Page-Id: "),
        F.col("original").cast("string"),
        F.lit(f"\r\nWARC-Profile: {PROFILE}"),
    )
    records = responses.select(warc_record("response", date, F.lit(""), F.concat(F.lit(HTTP), "body")))
    return records.union(revisits.select(warc_record("revisit", date, refers, F.lit(HTTP))))


def file_numbers(file_bytes: int, records_per_file: int):
    """A column function from the records' sizes to the number of their file among those of their task.

    A file is full before it holds more than ``file_bytes`` (a larger record has a file of its own) or ``records_per_file``.
    Only sizes go to Python; the records wait beside.
    """

    @F.pandas_udf("int")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        file = held = count = 0
        for sizes in batches:
            out = []
            for size in sizes.tolist():
                if count and (held + size > file_bytes or count == records_per_file):
                    file, held, count = file + 1, 0, 0
                held, count = held + size, count + 1
                out.append(file)
            yield pd.Series(out, dtype="int32")

    return number.asNondeterministic()


def write_archives(pages: DataFrame, path: str, file_bytes: int = 128 << 20, records_per_file: int = 10_000, **options) -> None:
    """Write ``pages`` as gzipped WARC files below ``path``, of ``records_per_file`` records and ``file_bytes`` bytes
    (before compression) at most; a record of more bytes has a file of its own.

    A file is one gzip member and has no warcinfo record: Spark's writer, which can lose an executor, knows no file ends.
    """
    number = file_numbers(file_bytes, records_per_file)
    records = warc_records(pages, **options).withColumn("file", number(F.octet_length("value") + 4))
    records.write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def unzipped(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, about ``size`` at a time."""
    while content:
        member = zlib.decompressobj(wbits=31)
        while not member.eof and (content or member.unconsumed_tail):
            yield member.decompress(content, size)
            content = member.unconsumed_tail
        content = member.unused_data


def parse_archive(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive that comes in parts."""
    data, parts = bytearray(), iter(parts)

    def more() -> bool:
        part = next(parts, None)
        data.extend(part or b"")
        return part is not None

    while data or more():
        while (stop := data.find(b"\r\n\r\n")) < 0 and more():
            pass
        if stop < 0 and not data.strip():
            return
        first, *lines = bytes(data[: max(stop, 0)]).decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"no WARC record at {bytes(data[:80])!r}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        end = stop + 4 + int(headers["content-length"])
        while len(data) < end + 4 and more():
            pass
        if len(data) < end:
            raise ValueError("the archive ends within a record")
        yield headers, bytes(data[stop + 4 : end])
        del data[: end + 4]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; ``payload`` is null for revisits (and unless ``payloads``).

    A response's digest and size are those of the payload read, not of its headers.
    """

    def row(h: dict[str, str], block: bytes) -> tuple:
        payload = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
        return (
            h["warc-record-id"],
            int(h["x-page-id"]) if h["x-page-id"] else None,
            h["warc-type"],
            h["warc-target-uri"],
            h.get("warc-refers-to"),
            int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None,
            h["warc-payload-digest"].removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest(),
            None if payload is None else len(payload),
            payload.decode() if payload is not None and payloads else None,
        )

    def frames(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")], dtype=object)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for h, block in parse_archive(unzipped(content)):
                    rows.append(row(h, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield frames(rows)
                        rows, size = [], 0
                yield frames(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInPandas(parse, READ_SCHEMA)


def with_originals(records: DataFrame) -> DataFrame:
    """Records with the payload size (and payload) of revisits filled in from the responses they refer to.

    Responses aren't moved, but for those referred to.  ``records`` are read several times: store them first.
    """
    revisits = records.where("record_type = 'revisit'")
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("payload_bytes").alias("_bytes"), F.col("payload").alias("_payload")
    )
    originals = originals.join(revisits.select("refers_to_record").distinct(), "refers_to_record", "left_semi").dropDuplicates(["refers_to_record"])
    filled = revisits.drop("payload_bytes", "payload").join(originals, "refers_to_record", "left")
    return records.where("record_type <> 'revisit'").unionByName(filled.withColumnsRenamed({"_bytes": "payload_bytes", "_payload": "payload"}))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = written(read_archives(spark, path, payloads=False), "warc-read")
    return with_originals(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""
