"""WARC archives: writing, reading back, and revisit resolution.

``write_archives`` writes one record per page with Spark's text writer: a record is its header, an empty
line and the payload, and the writer's own line end completes the two line ends that close a record. Archives
are gzip files in the folder all executors share. ``read_archives`` cuts files by ``Content-Length``, never by
searching the payload, and computes digest and length from the payload itself.

``resolve`` shuffles headers only, by payload digest: of the responses the one with the largest id stays, all other
records of that digest revisit it, also those that were revisits before; a revisit without any response stays a
revisit, with the reference it had; payloads shorter than ``min_bytes`` all stay responses. Payloads of equal
digest and length count as equal. ``write_deduplicated`` then writes archives again: responses whole, revisits
without payload, both with fresh headers (own length, date, reference to the original).

Defined cases: a null payload is an empty one; two rows with one id and one payload are one response and one
revisit of it; a null url becomes ``about:blank``; line breaks in a url are dropped; payloads may hold any
text, also whole WARC records. Rows with a null id are written, resolved after all others and returned with
a null id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

VERSION = "WARC/1.1"
END = b"\r\n\r\n"
#: Records a file holds at most; a file is read by one task.
RECORDS_PER_FILE = 1000
RECORD_FIELDS = "record_no bigint, page_id bigint, record_type string, url string, refers_to bigint, declared_digest string, payload_digest string, payload_bytes bigint"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, record_no) -> str:
    """The same id whenever the record is written again, so that a task may be run twice."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'textsieve:{page_id}:{record_no}')}>"


def header(fields: list[tuple[str, object]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def _record(record_no: int, page_id, url, payload: str, kind: str, date: str, original, payload_digest: str, payload_bytes: int) -> str:
    body = payload if kind == "response" else ""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, record_no)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", "", url or "") or "about:blank"),
        ("X-Record-No", record_no),
        ("X-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Payload-Length", payload_bytes),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("X-Refers-To-Page-ID", original if kind == "revisit" else None),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", len(body.encode("utf-8", "replace"))),
    ]
    return header(fields) + body + "\r\n\r"


def _write(records: DataFrame, folder: str) -> str:
    writer = records.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textsieve-{name}-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2020-01-01T00:00:00Z") -> str:
    """A response record for every row; returns the folder."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("record_no"),
        pages[f"`{page_id}`"].cast("long").alias("page_id"),
        pages[f"`{url}`"].cast("string").alias("url"),
        F.coalesce(pages[f"`{payload}`"].cast("string"), F.lit("")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for no, page, link, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                out.append(_record(no, page, link, text, "response", date, None, digest(raw), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return _write(rows.mapInArrow(run, "value string"), folder)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        end = raw.index(END, at)
        first, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = end + len(END)
        size = int(fields["content-length"])
        yield fields, raw[begin : begin + size]
        at = begin + size
        if raw[at : at + len(END)] != END:
            raise ValueError(f"record at byte {at} has no end")
        at += len(END)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record: its headers, digest and length of its payload, and the payload if asked for.

    ``payload_digest`` and ``payload_bytes`` come from the block of a response and from the header of a revisit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")

    def number(fields: dict[str, str], name: str):
        return int(fields[name]) if fields.get(name, "None") != "None" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(zlib.decompress(content.as_py(), 31)):
                    whole = fields["warc-type"] == "response"
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    rows.append(
                        (
                            number(fields, "x-record-no"), number(fields, "x-page-id"), fields["warc-type"], fields["warc-target-uri"], number(fields, "x-refers-to-page-id"),
                            declared, digest(block) if whole else declared, len(block) if whole else number(fields, "x-payload-length"),
                            *((block.decode("utf-8", "replace"),) if with_payload else ()),
                        )
                    )
                    held += len(block) if with_payload else 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.string()], strict=False)], names=[*names, "payload"][: len(rows[0])])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.string()], strict=False)], names=[*names, "payload"][: len(rows[0])])

    return files.mapInArrow(run, RECORD_FIELDS + (", payload string" if with_payload else ""))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``record_no``, ``kind`` and ``original`` of every record, from headers alone.

    Only a response can be an original. The original of a digest is one aggregate row, so a digest that a third of
    all records share costs one partial maximum per task; the join back is an equi-join whose large partitions Spark
    may split. A revisit stays one: it refers to the response of its digest, or without any to what it referred to.
    """
    lead = F.struct(F.col("page_id"), F.col("record_no"))
    whole = F.col("record_type") == "response"
    originals = headers.where(whole).groupBy("payload_digest", "payload_bytes").agg(F.max(lead).alias("lead"))
    originals = originals.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("lead.page_id").alias("lead_page"), F.col("lead.record_no").alias("lead_no"))
    # a revisit need not tell the length of its payload
    same = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes").isNull() | (F.col("payload_bytes") == F.col("b")))
    met = headers.select("record_no", "record_type", "refers_to", "payload_digest", "payload_bytes").join(originals, same, "left")
    again = F.col("lead_no").isNotNull() & (F.col("lead_no") != F.col("record_no")) & (F.col("payload_bytes") >= min_bytes)
    original = F.when(whole & again, F.col("lead_page")).when(~whole, F.when(F.col("lead_no").isNotNull(), F.col("lead_page")).otherwise(F.col("refers_to")))
    return met.select("record_no", F.when(~whole | again, "revisit").otherwise("response").alias("kind"), original.alias("original"))


def write_deduplicated(records: DataFrame, decisions: DataFrame, folder: str, date: str = "2020-01-02T00:00:00Z") -> str:
    """Archives with every payload once; ``records`` as read with payload, ``decisions`` from ``resolve``."""
    rows = records.join(decisions, "record_no").select(
        "record_no", "page_id", "url", F.when(F.col("kind") == "response", F.col("payload")).otherwise("").alias("payload"), "kind", "original", "payload_digest", "payload_bytes"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                _record(no, page, link, text, kind, date, original, hashed, size)
                for no, page, link, text, kind, original, hashed, size in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return _write(rows.mapInArrow(run, "value string"), folder)


def deduplicate(pages: DataFrame, min_bytes: int = 0, **columns: str) -> tuple[str, DataFrame]:
    """Write archives of pages, read them, resolve revisits, write again: the folder, and its records read back."""
    spark = pages.sparkSession
    first = write_archives(pages, new_folder(spark, "warc"), **columns)
    decisions = resolve(read_archives(spark, first), min_bytes)
    second = write_deduplicated(read_archives(spark, first, with_payload=True), decisions, new_folder(spark, "warc-deduplicated"))
    return second, read_archives(spark, second)
