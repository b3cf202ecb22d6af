"""A content-addressed web archive: payload bytes once, exact record headers apart, original records by a join.

An archive is a folder of two parts. ``records`` holds WARC files: a response record with its payload, or a revisit record
that refers to the response with the same payload. ``headers`` holds, as Parquet, the exact header of every original response
record and the SHA-256 of its payload. Joining both restores the original records.

A file is named ``.warc.gz``, begins with a warcinfo record and has a gzip member for each record, so that tools can seek to
any of them. Spark's text writer stores the files, so that tasks that fail or run twice leave none behind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.sources.storage import rename_endings

CRLF = "\r\n"
#: Payloads below this size are stored again: a revisit would not be smaller.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Characters a header line can't hold, and their escapes.
UNSAFE = {"\r": "%0D", "\n": "%0A", "\t": "%09", " ": "%20"}
#: Bytes of records in a file, before they are zipped, but for a larger record that has a file alone; bytes that are unpacked at a time.
FILE_BYTES, STEP = 64 << 20, 1 << 14


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))


def _header(kind: str, row: dict[str, Column], more: list[Column], block_bytes: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"),
        line("WARC-Record-ID", _urn(row["id"], row["url"], row["sha256"])),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", row["url"]),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), row["sha256"])),
        *more,
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
    )


def _urn(record: Column, url: Column, sha256: Column) -> Column:
    """An id that different rows never share, also where they share their key."""
    key = F.coalesce(record.cast("string"), F.lit("null"))
    for char, code in UNSAFE.items():
        key = F.replace(key, F.lit(char), F.lit(code))
    return F.concat(F.lit("<urn:page:"), key, F.lit(":"), F.substring(F.sha2(F.concat(sha256, url), 256), 1, 32), F.lit(">"))


def _member(record: bytes) -> bytes:
    zipped = zlib.compressobj(wbits=31)
    return zipped.compress(record) + zipped.flush()


def _about(name: str) -> bytes:
    """The warcinfo record that a file begins with."""
    text = f"software: strandline{CRLF}format: WARC File Format 1.1{CRLF}"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(text)}", "", text]
    return (CRLF.join(lines) + CRLF + CRLF).encode()


def _files(records: Iterator[bytes], name: str, file_bytes: int) -> Iterator[bytes]:
    """Whole files of gzip members, but for a last byte that is 0 and that the writer adds as the end of its line."""
    members, size, number = [], 0, 0

    def file() -> bytes:
        # a member ends with its length, lowest byte first: from 16 MiB on the last byte may not be 0, and an empty member ends the file
        return b"".join(members if members[-1][-1] == 0 else [*members, _member(b"")])[:-1]

    for record in records:
        if size and size + len(record) > file_bytes:
            yield file()
            members, size, number = [], 0, number + 1
        if not members:
            members.append(_member(_about(f"{name}:{number}")))
        members.append(_member(record))
        size += len(record)
    if members:
        yield file()


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes an archive of all rows.

    Among rows with equal payloads (by SHA-256 and length) of at least ``least_bytes``, the largest key is the response and the
    others are revisits of it; smaller payloads are responses all. A null payload is empty, a null url too; rows with null keys
    refer to others but are not referred to; rows that are equal in all three columns are one record, written as often; other
    columns are ignored; an empty table gives an archive without records. Payloads are shuffled once, by key; what is grouped by
    payload are digests, which Spark can split where many rows share one. A task cuts its files by their records' bytes.
    """
    safe = F.coalesce(F.col(url), F.lit(""))
    for char, code in UNSAFE.items():
        safe = F.replace(safe, F.lit(char), F.lit(code))
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("record_id"), safe.alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    facts = materialize(rows.select("record_id", "url", "sha256", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    first = facts.filter(F.col("bytes") >= least_bytes).groupBy("sha256", "bytes").agg(
        F.max(F.when(F.col("record_id").isNotNull(), F.struct("record_id", "url"))).alias("first")
    )
    first = first.select("sha256", "bytes", F.col("first.record_id").alias("first_id"), F.col("first.url").alias("first_url"))
    known = facts.join(first, ["sha256", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    row = {"id": F.col("record_id"), "url": F.col("url"), "sha256": F.col("sha256")}
    http = _http(F.col("bytes"))
    known = known.select(
        "record_id", "url", "sha256", "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, _urn(F.col("first_id"), F.col("first_url"), F.col("sha256"))).alias("refers_to_record"),
        F.concat(_header("response", row, [], F.octet_length(http) + F.col("bytes")), http).alias("header"),
    )
    known.write.parquet(f"{path}/headers")
    headers = pages.sparkSession.read.parquet(f"{path}/headers")
    responses = headers.filter("record_type = 'response'").select("record_id", "url", "sha256", "header").dropDuplicates(["record_id", "url", "sha256"])
    same = [rows[c].eqNullSafe(responses[c]) for c in ("record_id", "url")] + [rows["sha256"] == responses["sha256"]]
    full = rows.join(responses, same).select(F.concat("header", "payload").alias("value"))
    more = [F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), F.col("refers_to_record"), F.lit(CRLF)]
    short = headers.filter("record_type = 'revisit'").select(F.concat(_header("revisit", row, more, F.octet_length(http)), http).alias("value"))
    records = full.unionByName(short).select(F.concat("value", F.lit(CRLF + CRLF)).cast("binary").alias("value"))
    name = quote(path.rstrip("/").rsplit("/", 1)[-1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = (value.as_py() for batch in batches for value in batch.column(0))
        for file in _files(values, f"{name}:{TaskContext.get().partitionId()}", file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], names=["value"])

    # a row is a file; Spark keeps the bytes of a string as they are
    files = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(f"{path}/records")
    rename_endings(pages.sparkSession, f"{path}/records", ".txt", ".warc.gz")


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Headers and blocks of the records in a stream of bytes. What is read is left behind by an offset, and dropped now and then."""
    held, at = bytearray(), 0
    for chunk in chunks:
        if at > 1 << 20 or at == len(held):
            del held[:at]
            at = 0
        held += chunk
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            if len(held) - at >= 5 and held[at : at + 5] != b"WARC/":
                raise ValueError(f"no WARC record: {bytes(held[at : at + 80])!r}")
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = bytes(held[at:end])
            size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
            if size is None:
                raise ValueError(f"a WARC record without a length: {head[:80]!r}")
            if len(held) < end + 4 + size:
                break
            at = end + 4 + size
            yield head, bytes(held[end + 4 : at])
    if at < len(held):
        raise ValueError(f"a WARC file ends within a record: {bytes(held[at : at + 80])!r}")


def _unzipped(content: bytes, step: int = STEP) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of a plain one, in pieces."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield from (view[i : i + (1 << 20)] for i in range(0, len(view), 1 << 20))
        return
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while not unzip.eof and at < len(view):
            out = unzip.decompress(view[at : at + step])
            at = min(len(view), at + step) - len(unzip.unused_data)
            yield out
        if not unzip.eof:
            raise ValueError("a gzip member is cut short")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below a path: ``record_type``, ``record_id``, ``target_uri``, ``refers_to``, ``header``, ``http_header``, ``payload``, ``sha256``.

    The SHA-256 is computed from the payload; a response whose header says another fails the job. Files may be plain or of gzip
    members; a file is the unit that has to fit into a task. A path without files gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "target_uri", "refers_to", "header", "http_header", "payload", "sha256"]
        kinds = [pa.string()] * 6 + [pa.binary(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for head, block in _records(_unzipped(content.as_py())):
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
                    cut = block.find(b"\r\n\r\n") + 4 if fields.get("content-type", "").startswith("application/http") else 0
                    payload, kind = block[cut:], fields.get("warc-type", "")
                    digest = hashlib.sha256(payload).hexdigest() if kind != "revisit" else None
                    told = fields.get("warc-payload-digest", "")
                    if digest and told.startswith("sha256:") and told[7:] != digest:
                        raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
                    out.append((kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), head.decode() + "\r\n\r\n", block[:cut].decode("latin-1"), payload, digest))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    schema = "record_type string, record_id string, target_uri string, refers_to string, header string, http_header string, payload binary, sha256 string"
    return files.select("content").mapInArrow(run, schema)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The original records of an archive: ``record_id``, ``record_type``, ``refers_to``, ``header`` (exact bytes before the payload), ``payload_bytes``, ``payload_sha1``, ``payload``, ``sha256``.

    ``concat(header, payload)`` is the original response record. Payloads come from the WARC files, verified; each is stored
    once from ``least_bytes`` on. The payload is joined only where it is asked for: size and SHA-1 are taken before the join.
    """
    stored = read_warc(spark, f"{path}/records").filter("record_type = 'response'")
    stored = stored.groupBy("sha256").agg(
        F.max(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.max(F.sha1("payload")).alias("payload_sha1"), F.any_value("payload").alias("payload")
    )
    headers = spark.read.parquet(f"{path}/headers").select("record_id", "record_type", "refers_to", "header", "sha256")
    return headers.join(stored, "sha256")
