"""WARC archives with revisit records for repeated payloads.

1. Every page gets a header row (page_id, url, payload digest, length); payloads stay where they are. The headers are
   grouped by digest to find, for each repeated payload, the capture that stays as the response.
2. Headers of the other captures join their response on the digest; that join carries no payload, and Spark's
   adaptive skew handling splits a digest that many pages share.
3. Pages meet their decision on (page_id, digest); a short list of revisits is broadcast, so that no payload moves.
   Each record is built anew: a response with its payload, or a revisit with fresh headers and none.
4. A task fills an archive, which a warcinfo record opens, up to ``archive_bytes`` and starts the next; only a record
   that is longer by itself makes a longer archive. Spark's text sink writes each as one row into one file; the row
   end it adds, CR LF, is the last line end of the last record, so the files are plain WARC/1.1. Reading follows
   Content-Length, whatever payloads contain, and a task holds one archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import broadcast_if_small, shared_folder, table, written

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its last CR LF."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + END + END + block + END


def opening(first: bytes) -> bytes:
    """The warcinfo record of the archive whose first record is given."""
    block = b"software: gridspark\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, "archive:" + hashlib.sha1(first).hexdigest())
    kind = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
    return _record(kind, block)


def target(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url or "about:blank")


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One record without its last CR LF; a revisit names its response and keeps the payload's length and digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("WARC-Refers-To-Target-URI", target(refers_url)),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ]
    return _record(headers, http if revisit else http + payload)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END + END, at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != END + END:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, data[start:stop]
        at = stop + 4


def _payload(html) -> F.Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the captures that become revisits; each once.

    Of captures with equal payloads of at least ``least_bytes`` the one with the largest page_id is the response.
    """
    payload = _payload(F.col("html"))
    headers = pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    headers = written(headers.where(F.col("bytes") >= least_bytes).select("page_id", "url", "digest"), "headers")
    last = F.max(F.struct("page_id", "url"))  # a null page_id is less than any
    shared = headers.groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"))
    found = headers.select("page_id", "digest").join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to", "refers_url").distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 16 << 20) -> None:
    """Writes page_id, url, html as deduplicated archives below ``path``."""
    revisits = written(resolve(pages, least_bytes), "revisits")
    rows = pages.select("page_id", "url", "html", F.sha1(_payload(F.col("html"))).alias("digest"))
    told = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", "refers_url", F.lit(True).alias("revisit"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    joined = rows.join(broadcast_if_small(told, 250_000), same, "left")
    dealt = joined.select(
        "page_id",
        "url",
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        "refers_to",
        F.coalesce("revisit", F.lit(False)).alias("revisit"),
        "refers_url",
    )

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            whole = END.join([opening(held[0]), *held])
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.large_binary()).cast(pa.binary())], names=["archive"])

        for batch in batches:
            for page, url, html, refers, again, refers_url in zip(*(batch.column(k) for k in range(6))):
                record = build(page.as_py(), url.as_py(), html.as_py().encode("utf-8"), refers.as_py(), again.as_py(), refers_url.as_py())
                if held and size + len(record) > archive_bytes:
                    yield closed()
                    held, size = [], 0
                held.append(record)
                size += len(record) + 2
        if held:
            yield closed()

    made = dealt.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits) of every capture.

    Length and digest of a response are taken from its payload, those of a revisit from its headers.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["content"]:
                for headers, block in parse(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(END + END)
                    number = lambda k: int(headers[k]) if headers.get(k) else None
                    if headers["WARC-Type"] == "response":
                        known = (len(payload), base32_sha1(payload), None, payload)
                    else:
                        length = next(int(x.partition(b":")[2]) for x in head.split(END) if x.lower().startswith(b"content-length:"))
                        known = (length, headers["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page-ID"), None)
                    rows.append((number("X-Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], *known))
            made = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kind = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return files.mapInPandas(records, kind)


def deduplicated_archives(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the archives and reads them back; one row per row of ``pages``.

    A null html is the empty payload. Rows that repeat a page_id and a payload are captures of their own of the
    same kind: all responses, or all revisits. A null page_id is never the one that others revisit, unless no
    capture of the payload has an id; then all are responses. A null url becomes about:blank. Other columns are
    not read. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/gridspark-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM hashed
), chunks AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS twenty FROM ranked
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((twenty[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM chunks
"""
