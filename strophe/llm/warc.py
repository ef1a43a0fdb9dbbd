"""Legacy ARC archives, their conversion to WARC, and WARC files written and read through Spark's own file systems."""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, new_path, table

#: Fixed values of the two ARC versions: the fields of a record's header line, as the version block declares them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PAGE_DATE = "20000101000000"
RECORD_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
LEAST_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4000  # a file is parsed whole when it is read back
RECORD = "page_id long, url string, date string, mime string, payload binary, payload_bytes long, payload_digest string, record_id string"


class ArcError(ValueError):
    """An archive that isn't what its header lines declare."""


def arc_header(version: int, url: str, mime: str, length: int, page_id: int | None, status: int = 200) -> bytes:
    """One record's header line. Version 2 carries the page's number as its Location, version 1 in the URL's fragment."""
    name = "-" if page_id is None else str(page_id)
    if version == 1:
        fields = [f"{url}#page={name}", "0.0.0.0", PAGE_DATE, mime, str(length)]
    else:
        fields = [url, "0.0.0.0", PAGE_DATE, mime, str(status), "-", f"page={name}", "0", "pages.arc", str(length)]
    return " ".join(fields).encode() + b"\n"


def arc_start(version: int) -> bytes:
    """The version block that opens an archive: its own header line, version line and list of fields."""
    body = f"{version} 0 Example\n{' '.join(ARC_FIELDS[version])}\n".encode()
    own = ["filedesc://pages.arc", "0.0.0.0", PAGE_DATE, "text/plain"] + (["200", "-", "-", "0", "pages.arc"] if version == 2 else [])
    return " ".join([*own, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of an ARC archive of version 1 or 2.

    The version block tells which fields a header line has; a payload is as long as its line declares, so it may
    hold anything. Fields are taken from the line's end, since an old URL may contain spaces.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records are parted by a line end
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no line end after byte {at}")
        line = data[at:end].decode()
        try:
            length = int(line.rpartition(" ")[2])
        except ValueError:
            raise ArcError(f"no length in {line[:80]!r}") from None
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ArcError(f"{len(body)} of {length} bytes after {line[:80]!r}")
        at = end + 1 + length
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ArcError("no version block")
            version, *_ = body.split(b" ", 1)
            fields = ARC_FIELDS.get(int(version))
            if fields is None:
                raise ArcError(f"version {version!r}")
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) < len(fields):
            raise ArcError(f"{len(values)} fields in {line[:80]!r}")
        yield dict(zip(fields, values)), body


def converted(fields: dict[str, str], payload: bytes) -> tuple:
    """The WARC record that an ARC record amounts to: number, URL, WARC timestamp, type, payload, digest, identifier."""
    url, number = fields["URL"], fields.get("Location", "")
    if "Location" not in fields:
        url, _, number = url.rpartition("#")
    page = int(number[5:]) if re.fullmatch(r"page=-?\d+", number) else None
    date = datetime.datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    digest = hashlib.sha256(payload).hexdigest()
    record = f"urn:uuid:{uuid.uuid5(RECORD_NAMESPACE, f'{page} {url} {date} {digest}')}"
    return page, url, date, fields["Content-type"], payload, len(payload), digest, record


def header_value(text: str | None, otherwise: str) -> str:
    """A text as one field of a header line: white space and controls are percent-encoded."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or otherwise


def to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """ARC archives (column `archive`), one per few MB of pages, of version 1 and 2 by turns."""
    out = pa.schema([("archive", pa.binary())])

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            made, size = [], 0
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                version = 1 + turn % 2
                payload = (html or "").encode()
                made = made or [arc_start(version)]
                made += [arc_header(version, header_value(url, "urn:none"), "text/html", len(payload), page), payload, b"\n"]
                size += len(payload)
                if size > 4 << 20:
                    yield batch(out, [[b"".join(made)]])
                    made, size, turn = [], 0, turn + 1
            if made:
                yield batch(out, [[b"".join(made)]])
                turn += 1

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(archives, "archive binary")


def convert_arc(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row per record of the ARC archives, as a WARC record would have it (RECORD). gzip-ed archives are unpacked."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [converted(*r) for r in parse_arc(unpacked(data))]
                for k in range(0, len(rows), 500):
                    yield batch(out, [list(x) for x in zip(*rows[k : k + 500])])

    return archives.select(column).where(F.col(column).isNotNull()).mapInArrow(records, RECORD)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The converted records of ARC files at a path of any file system that Spark reads."""
    return convert_arc(spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive")))


def with_types(records: DataFrame) -> DataFrame:
    """record_type and refers_to: of equal payloads of LEAST_REVISIT_BYTES at least, that with the smallest page_id
    (then record) is the response, the others revisit it. A null page_id comes last."""
    large = F.col("payload_bytes") >= LEAST_REVISIT_BYTES  # shorter payloads find no lead
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    leads = records.where(large).groupBy("payload_digest").agg(F.min(first).alias("lead"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "lead")
    revisit = F.col("lead").isNotNull() & (F.col("lead.record_id") != F.col("record_id"))
    joined = records.join(leads, "payload_digest", "left")
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("lead.page_id"))).withColumn("refers_to_record", F.when(revisit, F.col("lead.record_id"))).drop("lead")


def warc_text():
    """A record as WARC 1.1 text; the text sink adds the last line end. A revisit has headers only."""
    pair = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), pair("Content-Type", F.col("mime")), pair("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(is_response, F.concat(http, F.col("payload").cast("string"))).otherwise("")  # the cast keeps any bytes
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        pair("WARC-Type", F.col("record_type")),
        pair("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        pair("WARC-Date", F.col("date")),
        pair("WARC-Target-URI", F.col("url")),
        pair("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.coalesce(pair("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_record", F.lit(">"))), F.lit("")),
        F.coalesce(pair("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        pair("Content-Type", F.lit("application/http; msgtype=response")),
        pair("Content-Length", F.when(is_response, F.octet_length(http) + F.col("payload_bytes")).otherwise(0).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    ).alias("value")


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """gzip-ed WARC files by Spark's text sink, so on any file system that it writes; no shuffle."""
    text = records.select(warc_text()).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file)
    text.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of a file of one or many gzip members, or as they are."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts) if parts else data


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, length = end + 4, int(headers["Content-Length"])
        block = data[start : start + length]
        if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a block at byte {start} isn't as long as declared")
        at = start + length + 4
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record of WARC files: record_id, page_id, url, type, refers_to_record, payload_bytes, payload_digest (SHA-256
    of the payload as read), declared_digest, payload. write_warc bounds its files, so each is parsed whole."""
    kinds = "record_id string, page_id long, url string, type string, refers_to_record string, payload_bytes long, payload_digest string, declared_digest string, payload binary"
    out = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in kinds.split(", "))])

    def row(h: dict[str, str], block: bytes) -> tuple:
        page, payload = h.get("X-Page-Id"), block.partition(b"\r\n\r\n")[2]
        return h["WARC-Record-ID"][1:-1], page and int(page), h["WARC-Target-URI"], h["WARC-Type"], h.get("WARC-Refers-To", "")[1:-1] or None, len(payload), hashlib.sha256(payload).hexdigest(), h["WARC-Payload-Digest"].partition(":")[2], payload

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                some = []
                for h, block in parse_warc(unpacked(data.as_py())):
                    some.append(row(h, block))
                    if len(some) == 500:
                        yield batch(out, [list(x) for x in zip(*some)])
                        some = []
                if some:
                    yield batch(out, [list(x) for x in zip(*some)])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, kinds)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as legacy ARC archives, converted to WARC, written, and read back.

    Returns per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty
    payload, a null URL reads urn:none, a null page_id stays null and is never preferred as a response. Rows that
    repeat in full are one record and share its type; an empty table gives no rows. What is returned of a response
    is measured on its payload as read; a revisit has that of the record that it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    numbered = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    write_warc(with_types(convert_arc(to_arc(numbered))), path)
    records = table(read_warc(spark, path).drop("payload", "url"), "read")
    responses = records.where("type = 'response'")
    full = responses.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = records.where("type = 'revisit'").select("page_id", "refers_to_record").join(full, "refers_to_record")
    found = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return found.union(revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to"))
