"""WARC archives: writing with revisit records for repeated payloads, reading, and resolving revisits."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import column

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:record:"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base 32 of a 40-digit hex string: four letters for each five digits."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, 1))
    return F.concat(*letters)


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(id, url, payload, sha1, n_bytes)``; a null payload counts as empty."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("sha1", F.unhex(F.sha1(F.col("payload").cast("binary")))).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))


def mark_revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` and ``refers_url`` to the rows of ``payloads``: null for responses, else id and URL of the response.

    Headers alone (digest, length, id) are shuffled by digest to find the smallest id of each payload of
    ``min_bytes`` or more, one row a payload and task; the rows then meet their payload's first id in an
    equi-join, which splits where one payload is very common. Null ids never win against others; rows that repeat the
    first id are responses, too.
    """
    firsts = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(
        F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"))
    marked = rows.join(firsts, ["sha1", "n_bytes"], "left")
    other = ~F.col("id").eqNullSafe(F.col("first"))
    return marked.withColumns({"refers_to": F.when(other, F.col("first")), "refers_url": F.when(other, F.col("first_url"))}).drop("first", "first_url")


def uri(url: Column) -> Column:
    """A URL as a header can hold it: blanks and line ends in percent form, other control characters as ``_``."""
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return F.regexp_replace(url, r"[\x00-\x1f\x7f]", "_")


def record(date: str) -> Column:
    """The whole record of a row of ``mark_revisits``, as text without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    refers = F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(f">{CRLF}"),
                      line("WARC-Refers-To-Target-URI", uri(F.col("refers_url"))), F.lit(f"WARC-Refers-To-Date: {date}{CRLF}"))
    return F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <{URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"), line("WARC-Target-URI", uri(F.col("url"))), F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.hex("sha1")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF * 2), block,
    )


def write_archives(marked: DataFrame, path: str, date: str | None = None, max_records: int = 20_000) -> None:
    """Writes the rows of ``mark_revisits`` as gzipped WARC files below ``path``.

    A record ends with two line ends, so the text writer with that separator writes the format itself, to any store. A file is
    what one task holds, cut after ``max_records``: Spark sizes tasks by bytes, so files stay far below the 2 GB that the
    reader takes unless one payload is that long. A file is one gzip member. ``date`` is the time of the records, now unless
    given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    marked.select(record(date).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of the records of a stream of bytes; blocks are cut by their stated length."""
    data, more = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(data) < n:
            got = next(more, None)
            if got is None:
                return False
            data.extend(got)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill(len(data) + 1):
                if data.strip():
                    raise ValueError("a WARC record is cut off in its headers")
                return
        head = data[:end].decode().lstrip(CRLF).split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {head[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        stop = end + 4 + int(headers["content-length"])
        if not fill(stop):
            raise ValueError("a WARC record is cut off in its block")
        yield headers, bytes(data[end + 4 : stop])
        fill(stop + 4)
        del data[: stop + 4]


def _unzipped(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The plain bytes, piece by piece; a file may hold any number of gzip members, or none. The content is fed in slices, so
    no tail of it is ever copied: the work grows with the file's length."""
    if content[:2] != b"\x1f\x8b":
        for lo in range(0, len(content), step):
            yield content[lo : lo + step]
        return
    unzip, fed = zlib.decompressobj(31), False
    for lo in range(0, len(content), step):
        data = content[lo : lo + step]
        while data:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            piece = unzip.decompress(data, 4 * step)
            data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if piece:
                yield piece
        fed = True
        while not unzip.eof and (piece := unzip.decompress(b"", 4 * step)):
            yield piece
    if fed and not unzip.eof:
        raise ValueError("a gzip member is cut off")


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(id, record_type, url, digest, refers_to, payload)`` of every record in the WARC files below ``path``.

    ``payload`` is the body after the HTTP header of the block, null for revisits. Files are unzipped and parsed
    as streams; a task holds one file and a few thousand records' payloads at a time.
    """

    def number(v: str | None):
        text = (v or "").strip("<>").removeprefix(URN)
        return text or None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "record_type", "url", "digest", "refers_to", "payload"]
        kinds = [pa.string()] * 5 + [pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            for item in column(batch, "content"):
                for h, block in parse(_unzipped(item.as_buffer().to_pybytes())):
                    body = None if h["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                    rows.append((number(h.get("warc-record-id")), h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h.get("warc-refers-to")), body))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(run, "id string, record_type string, url string, digest string, refers_to string, payload binary")
    return parsed.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def resolve(records: DataFrame) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)``: revisits get length and digest of the response.

    Digests of responses are those of the payloads as read. Headers alone are shuffled, by digest and
    id; a revisit whose response is in no archive keeps its own digest and a null length.
    """
    heads = materialize(records.select(
        "id", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(base32_of_hex(F.upper(F.sha1("payload")))).alias("payload_digest"),
    ), "warc-heads")
    responses = heads.where("record_type <> 'revisit'")
    firsts = responses.groupBy(F.col("payload_digest"), F.col("id").alias("refers_to")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = heads.where("record_type = 'revisit'").join(firsts, ["payload_digest", "refers_to"], "left")
    columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).union(revisits.withColumn("payload_bytes", F.col("full_bytes")).select(columns))


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + CAST(
      (CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
