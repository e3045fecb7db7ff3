"""WARC archives: writing with revisits and segments, reading with reassembly and chunked decoding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_min, new_path, small_batches

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an HTTP message that one record holds; the rest goes into continuation records.
SEGMENT_BYTES = 16 << 10
#: Bytes of a chunk of the chunked transfer coding.
CHUNK_BYTES = 4096
#: Records of one archive file; with SEGMENT_BYTES this bounds a file at about 32 MB before compression.
FILE_RECORDS = 2000
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in the chunked transfer coding."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def record_id(key: object, sha: str, copy: int = 1, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}#{sha}#{copy}#{segment}')}>"


def header(fields: list[tuple[str, object]]) -> bytes:
    """Header lines; line breaks in a value become %0D and %0A, absent values leave their line out."""
    line = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return VERSION + "".join(f"{k}: {line(v)}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records(key: object, url: str | None, payload: bytes, refers_to: object, copy: int = 1, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page without the blank lines after each: a revisit, or a response and its continuations."""
    sha = digest(payload)
    own = record_id(key, sha, copy)
    common: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", key), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield header([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to, sha)), ("WARC-Refers-To-Page-ID", refers_to), *common, ("Content-Length", len(http))]) + http
        return
    block = http + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        segment: list[tuple[str, object]] = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        if k > 1:
            segment += [("WARC-Segment-Origin-ID", own)]
        if k == len(parts) > 1:
            segment += [("WARC-Segment-Total-Length", len(block))]
        kind = "response" if k == 1 else "continuation"
        yield header([("WARC-Type", kind), ("WARC-Record-ID", record_id(key, sha, copy, k)), *(common if k == 1 else common[:1]), *segment, ("Content-Length", len(part))]) + part


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, plain or gzipped."""
    data, at = gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive, 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(END, at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes gzipped archives under ``path``, one record (and its continuations) for each page.

    Of pages with equal payloads of ``least_bytes`` or more, that with the smallest key is the response and the others
    revisit it. A null payload is empty; a null url or key leaves its line out. Repeated rows are
    archived as often as they occur, rows of one key with different payloads each for themselves.
    """
    small_batches(pages.sparkSession)
    page = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    page = group_min(page.withColumn("sha", F.sha1(F.col("html").cast("binary"))), "sha", "key", "first", salt_on="key")
    revisit = (F.col("first") < F.col("key")) & (F.octet_length("html") >= least_bytes)
    copy = F.row_number().over(Window.partitionBy("sha", "_salt", "key").orderBy("url"))
    page = page.select("key", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), copy.alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for k, u, h, to, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in records(k, u, h.encode(), to, n, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer puts the two blank lines after each record
    lines = page.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives under ``path``: key (string), url, record_type, payload binary (null for a revisit),
    payload_bytes, payload_digest, refers_to (string), valid.

    Continuation records are grouped by their origin, put in order of segment number and checked against the total
    length; then the chunked framing is decoded and the digest taken from the decoded payload. ``valid`` is false
    where the length, the framing or the digest does not hold; such pages stay, with what the header says.
    """
    small_batches(spark, 16)  # an archive file is a row here
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "type string, id string, url string, key string, digest string, n long, refers_to string, segment int, total long, block binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type", "id", "url", "key", "digest", "n", "refers_to", "segment", "total", "block"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows: list[list] = []
                for f, block in parsed(content.as_py()):
                    number = lambda x, f=f: int(f[x]) if x in f else None
                    rows.append([f["WARC-Type"], f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f.get("WARC-Page-ID"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number("WARC-Payload-Length"), f.get("WARC-Refers-To-Page-ID"), number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), block])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = files.mapInArrow(split, schema)
    # an array of blocks for each page, joined once in the task that decodes it
    whole = found.where(F.col("segment").isNull()).withColumns({"last": F.lit(1), "blocks": F.array("block")}).drop("segment", "block", "id")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = found.where(F.col("segment").isNotNull()).groupBy("id").agg(
        *[first(c) for c in ("type", "url", "key", "digest", "n", "refers_to")], F.max("total").alias("total"), F.max("segment").alias("last"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")
    )
    parts = parts.withColumns({"total": F.coalesce("total", F.lit(-1).cast("long")), "blocks": F.col("parts.block")})
    both = whole.unionByName(parts.select(*whole.columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            payload, size, sha, valid = [], [], [], []
            for kind, blocks, n, said, total, last in zip(x["type"], x["blocks"], x["n"], x["digest"], x["total"], x["last"], strict=True):
                body, block = None, b"".join(blocks)
                ok = len(blocks) == last and (total is None or total == len(block))
                if kind == "response":
                    try:
                        head, _, rest = block.partition(END)
                        body = unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                        ok = ok and len(body) == n and digest(body) == said
                    except ValueError:
                        ok = False
                payload.append(body)
                size.append(n if body is None else len(body))
                sha.append(said if body is None else digest(body))
                valid.append(bool(ok))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), b.column("type"), pa.array(payload, pa.binary()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), b.column("refers_to"), pa.array(valid, pa.bool_())], ["key", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "valid"])

    return both.mapInArrow(decode, "key string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, valid boolean")


def archive_round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads them back. Very long pages go in segments; an empty
    table gives an empty result."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, key, **options)
    return read_warc(pages.sparkSession, path)
