"""WARC archives: written through Spark's text writer, read back, and assembled to one row per capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm.common import cut, shared_dir, sized

#: A reader holds one archive file in memory: it has so many captures, or fewer if payloads of the mean size would make it
#: larger than this.
CAPTURES_PER_FILE, FILE_BYTES = 2_048, 1 << 27
CRLF = "\r\n"
END = CRLF + CRLF
WHEN = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexes: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: three of them are twelve bits, so digits are converted 15 at a time."""
    part = lambda at, n: F.lpad(F.conv(F.substring(hexes, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record): the request, response or revisit, and metadata records of each row of pages.

    Only (page_id, SHA-1) is grouped, and only digests that stand twice are joined again: payloads stay where they are
    if these are few, and move once if not, when a popular payload's rows can be split. Of rows with equal payloads of
    min_bytes or more, those with the smallest page_id are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha1(payload).alias("sha1"))
    first = rows.groupBy(F.col("sha1").alias("d")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("times"))
    first = cut(first.where("times > 1").drop("times"))
    rows = rows.join(sized(first), F.col("sha1") == F.col("d"), "left").drop("d")
    revisit = F.coalesce((F.col("n") >= min_bytes) & (F.col("page_id") > F.col("first_id")), F.lit(False))
    rows = rows.select("*", revisit.alias("revisit"), base32(F.col("sha1")).alias("digest"), F.expr("uuid()").alias("u"))

    def record(kind: Column | str, header: list, block: Column, mime: str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {WHEN}"), F.lit(f"Content-Type: {mime}"), *header]
        return F.concat(F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)

    urn = lambda part: F.concat(F.lit("<urn:uuid:"), F.col("u"), F.lit(f":{part}>"))
    named = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    target = named("WARC-Target-URI", url)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    refers = F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Page: "), F.col("first_id").cast("string"), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    request = record("request", [named("WARC-Record-ID", urn("request")), named("WARC-Concurrent-To", urn("response")), target], F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{END}")), "application/http; msgtype=request")
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    response = record(F.when(F.col("revisit"), "revisit").otherwise("response"), [named("WARC-Record-ID", urn("response")), target, digest, refers], block, "application/http; msgtype=response")
    metadata = record("metadata", [named("WARC-Record-ID", urn("metadata")), named("WARC-Concurrent-To", urn("response")), target], F.concat(F.lit("page_id: "), page), "application/warc-fields")
    return rows.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, captures_per_file: int | None = None) -> None:
    """Write the records of pages as gzipped WARC files under path, which all executors share."""
    if captures_per_file is None:
        mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
        captures_per_file = max(1, min(CAPTURES_PER_FILE, int(FILE_BYTES // (mean + 1024))))
    out = records(pages, min_bytes).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, by the lengths stated."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = data[at:end].decode("utf-8", errors="replace").split(CRLF)
        header = {"version": head[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        n = int(header["content-length"])
        yield header, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record: ids, type, target, page_id (metadata), payload's stated and measured length and digest, and the payload."""
    schema = "record_id string, record_type string, concurrent_to string, target string, page_id string, refers_to long, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block in parse(gzip.decompress(data)):
                    row = [h.get("warc-record-id"), h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), None, None, None, None, None, None, None]
                    if h["warc-type"] == "metadata":
                        row[4] = block.decode().removeprefix("page_id:").strip()
                    elif h["warc-type"] in ("response", "revisit"):
                        http, _, body = block.partition(b"\r\n\r\n")
                        row[5] = int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None
                        row[6] = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        row[7] = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response":
                            row[8], row[9] = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                            row[10] = body if payload else None
                    rows.append(row)
                    held += len(block)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


_TYPES = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["record_id", "record_type", "concurrent_to", "target", "page_id", "refers_to", "stated_bytes", "stated_digest", "payload_bytes", "payload_digest", "payload"]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _TYPES]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def captures(found: DataFrame) -> DataFrame:
    """(capture): one nested row for each response or revisit record, with the request and metadata concurrent to it.

    A capture whose request or metadata is missing has null there. Payload length and digest are measured for
    responses; a revisit has those it states, which are those of the response it refers to.
    """
    key = lambda t, name: found.where(F.col("record_type") == t).select(F.col("concurrent_to").alias("to"), F.struct("record_id", "target", "page_id").alias(name))
    main = found.where(F.col("record_type").isin("response", "revisit"))
    digest, n = F.coalesce("payload_digest", "stated_digest"), F.coalesce("payload_bytes", "stated_bytes")
    intact = F.col("record_type").eqNullSafe("revisit") | ((F.col("payload_digest") == F.col("stated_digest")) & (F.col("payload_bytes") == F.col("stated_bytes")))
    main = main.select(F.col("record_id").alias("id"), F.struct("record_id", "record_type", "target", "refers_to", n.alias("payload_bytes"), digest.alias("payload_digest"), intact.alias("intact"), "payload").alias("response"))
    out = main.join(key("request", "request"), F.col("id") == F.col("to"), "left").drop("to")
    out = out.join(key("metadata", "metadata"), F.col("id") == F.col("to"), "left").drop("to")
    return out.select(F.struct("request", "response", "metadata").alias("capture"))


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): write pages as archives, read them back.

    A null html is an empty payload, a null url an empty target; a null page_id comes back null and is always a
    response. Rows that repeat a page_id and payload are captures of one type; an empty table gives an empty one; other
    columns are ignored. Without a path the archives go to a new folder in the shared one.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    kind = pages.schema["page_id"].dataType
    c = captures(read_records(spark, path, payload=False)).select("capture.*")
    page_id = F.when(F.col("metadata.page_id") != "", F.col("metadata.page_id")).cast(kind)
    return c.select(page_id.alias("page_id"), *[F.col(f"response.{x}").alias(x) for x in ("payload_bytes", "payload_digest", "record_type", "refers_to", "intact")])


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform(range(0, 4), lambda j:
        substr('{BASE32}', ((('0x' || substr(x, (k * 5 + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to, true AS intact FROM f
"""
