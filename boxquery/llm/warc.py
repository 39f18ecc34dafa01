"""WARC archives: written with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own. The index has a row a record (file,
offset, length, URL, digest, type) and is written first-class, as a table; a
reader selects index rows, sorts them by place, joins near ranges into one read
and parses the records in it. Archives and index lie in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import table, written
from boxquery.llm.anchors import bitmap
from boxquery.sources.scratch import fresh_path

#: Payloads of so many bytes or more are stored once.
MIN_REVISIT_BYTES = 0
FILE_BYTES = 64 << 20
#: Reads of nearby records are joined across gaps of GAP bytes, up to READ bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
WARC_DATE = "2000-01-01T00:00:00Z"
GZIP_LEVEL = 4
_NO_ID = (1 << 63) - 1
_URN = "urn:boxquery:page:"

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _uri(url: str | None) -> str:
    """A URL as a header value: white space and controls are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def _record(page: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record, unpacked: a response with its payload, or a revisit with none."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page is None else page}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one unpacked record; a response's size and digest come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda urn: int(x) if (x := urn.strip("<>").removeprefix(_URN)) else None
    found = {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"]}
    if found["record_type"] == "revisit":
        return found | {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields["WARC-Refers-To"]), "payload": None}
    return found | {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "refers_to": None, "payload": payload}


#: Names that Hadoop has for stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gcs", "abfs": "abfss"}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path in it, in a Python worker; hdfs and viewfs need libhdfs there."""
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}" if sep else uri)


def _packed(pages: DataFrame) -> DataFrame:
    """_id, url, digest, size and the packed response record of each page; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for page, url, html in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    payload = (html or "").encode()
                    digest = base32_sha1(payload)
                    rows.append((page, url, digest, len(payload), _member(_record(page, url, digest, len(payload), payload, None))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "url", "digest", "size", "member"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, digest string, size long, member binary")


def write_archives(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page; the index of all records, itself a table in the shared folder.

    Of equal payloads of ``min_revisit_bytes`` or more that of the smallest page_id is a
    response and the others revisit it (a null id comes last; repeated rows of the
    smallest id are responses each). A null html is the empty payload. A task that runs
    again writes files of other names; only the index says which count.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    packed = written(_packed(pages), "warc-members").withColumn("_id", F.coalesce("page_id", F.lit(_NO_ID)))
    first = packed.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    again = written(packed.select("_id", "digest", "size").join(first, ["digest", "size"]).where("_id > _first").select("_id", "digest", "_first").distinct(), "revisits")
    # only pages that may revisit another (by a bitmap) are shuffled to what they revisit
    sieve = bitmap(again.select(F.xxhash64("_id", "digest").alias("place")))
    sent = spark.sparkContext.broadcast(sieve)
    placed = packed.withColumn("place", F.xxhash64("_id", "digest"))
    where = len(placed.columns) - 1

    def part(want: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.has(batch.column(where).to_numpy()) == want))

        return placed.mapInArrow(pick, placed.schema).drop("place")

    if sieve is None:  # too many for a bitmap
        both = packed.join(again, ["_id", "digest"], "left")
    else:
        both = part(True).join(again, ["_id", "digest"], "left").unionByName(part(False).withColumn("_first", F.lit(None).cast("long")))
    rows = both.select("page_id", "url", "digest", "size", F.when(F.col("_first").isNull(), F.col("member")).alias("member"), F.col("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page, url, digest, size, member, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = member if member is not None else _member(_record(page, url, digest, size, None, refers))
                    out.write(data)
                    index.append((page, url, f"{folder}/{name}", at, len(data), digest, size, "response" if member is not None else "revisit", refers))
                    at += len(data)
                if index:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), kinds, strict=True)], names=[p.split()[0] for p in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, payload: bool = False, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the index rows name, parsed from the archives (payload: with the payload's bytes).

    Rows are dealt out by file and stretch of ``most`` bytes, sorted by place, and read range by range.
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [p.split()[0] for p in schema.split(", ")]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        file, spans = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if spans and (name != file or offset > spans[-1][0] + spans[-1][1] + gap or offset + length - spans[0][0] > most):
                    yield file, spans
                    spans = []
                file = name
                spans.append((offset, length))
        if spans:
            yield file, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        opened, handle = None, None
        for file, spans in ranges(batches):
            if file != opened:
                if handle is not None:
                    handle.close()
                system, path = _store(file)
                opened, handle = file, system.open_input_file(path)
            start = spans[0][0]
            stretch = handle.read_at(max(o + n for o, n in spans) - start, start)
            found = [parse_record(zlib.decompress(stretch[o - start : o - start + n], 31)) for o, n in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds[p.split()[1]]) for n, p in zip(names, schema.split(", "), strict=True)], names=names)
        if handle is not None:
            handle.close()

    # tasks by the bytes that they will read, which the index's own size says nothing of
    total = index.agg(F.sum("length")).first()[0] or 0
    placed = index.select("file", "offset", "length").repartition(1 + total // most, "file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, schema)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_records(write_archives(table(spark, sf_dir, "pages")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, h FROM p),
bits AS (SELECT *, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i])] for i in range(1, 41)], '') AS b FROM d),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT b.page_id, payload_bytes,
  array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5*k+1]::INT + 8 * b[5*k+2]::INT + 4 * b[5*k+3]::INT + 2 * b[5*k+4]::INT + b[5*k+5]::INT] for k in range(0, 32)], '') AS payload_digest,
  CASE WHEN b.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits b JOIN f USING (h)
"""
